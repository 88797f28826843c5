"""Pages and sections of acts by hand: each branch of the rules."""

from quillon.operators import acts as a


def one(spark, f, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r.v for r in df.select("id", f(df).alias("v")).orderBy("id").collect()]


def test_target_page(spark):
    filler = " words of no weight" * 15
    page = lambda name, short: lambda df: a.target_page(df["t"], a.F.lit(name), a.F.lit(short))
    penal = page("Indian Penal Code 1860", "IPC")
    assert one(spark, penal, "The penal laws of 1860" + filler, "penal" + filler, "penal 1860", None) == [True, False, False, False]
    assert one(spark, penal, "penal 1860, petitioner" + filler, "penal 1860, petitioner, code of" + filler, "A vs B, High Court, penal 1860" + filler, "penal 1860 A vs B" + filler) == [False, True, False, True]
    nyaya = page("Bharatiya Nyaya Sanhita 2023", "BNS")
    assert one(spark, nyaya, "bharatiya nyaya" + filler, "bharatiya nyaya 2023" + filler) == [False, True]  # three words for closely named acts
    assert one(spark, penal, "x " * 3100 + "penal 1860") == [False]  # beyond 6000 characters


def test_rank_candidates(spark):
    rows = [(0, "u1", "Indian Penal Code"), (1, "u2", None), (2, "u1", "Indian Penal Code 1860"), (3, "u3", "The Indian Penal Code, 1860"), (4, None, "Indian Penal Code 1860"), (5, "u4", "X vs Y"), (6, "u5", "Penal Code 1860")]
    df = spark.createDataFrame([("a", "Indian Penal Code 1860", "IPC", *r) for r in rows], "act string, name string, short string, pos int, url string, label string")
    got = sorted((r.place, r.url, r.score) for r in a.rank_candidates(df, "act", "name", "short", "pos", "url", "label", 4).collect())
    assert got == [(1, "u3", 28), (2, "u5", 28), (3, "u1", 18), (4, "u4", -30)]


def test_one_section(spark):
    rows = ["Section 138. Dishonour of cheque. Imprisonment for two years. More", "21. Protection of life", "12A - Of arms", "no number", "x" * 199 + " Section 5. A", "Sec 7: Of\nfines.\nThe fine is 5 rupees."]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in a.one_section(df["t"]).items()], "id").orderBy("id").collect()]
    assert [g[0] for g in got] == ["138", "21", "12A", "unknown", "unknown", "7"]
    assert [g[1] for g in got] == ["Dishonour of cheque", "21. Protection of life", "12A - Of arms", "no number", "A", "Of fines"]  # a title is looked for in 300 characters, a number in 200
    assert [g[2] for g in got] == ["Imprisonment for two years.", None, None, None, None, "fines."]


BODY = "This body is long enough to be a section by itself"


def sections(spark, text, expected=100):
    df = spark.createDataFrame([(1, text, expected)], "id int, t string, expected int")
    split = a.split_act(df, "id", "t")
    return sorted((r.idx, r.number, r.heading, r.section_text) for r in split.collect()), sorted((r.idx, r.number, r.title, r.section_text, r.punishment) for r in a.clean_sections(split, df, "id").collect())


def test_split_takes_the_kind_with_more_headings(spark):
    named = f"Section 1. One\n{BODY}\nSec. 2 Two\n{BODY}\narticle 3(a) - Three\n{BODY}\n4. not a heading here\n{BODY}"
    split, clean = sections(spark, named)
    assert [s[:3] for s in split] == [(0, "1", "One"), (1, "2", "Two"), (2, "3(a)", "Three")] and split[2][3].endswith("4. not a heading here\n" + BODY)
    assert [c[2] for c in clean] == ["One", "Two", "Three"]
    bare = f"Section 1. One\n{BODY}\n2. Two\n{BODY}\n3) Three\n{BODY}\n  4 - Four\n\n\n{BODY}"
    assert [s[:3] for s in sections(spark, bare)[0]] == [(0, "2", "Two"), (1, "3", "Three"), (2, "4", "Four")]
    assert sections(spark, f"Section 1. One\n{BODY}\nSection 2. Two\n{BODY}") == ([], [])  # two headings aren't an act


def test_cleanup_in_order(spark):
    chapter = "Section 5\nChapter II and what it holds, in few words"
    text = "\n".join([f"Section 1. {BODY}", "Section 2. short", f"Section 3. {BODY}", f"Section 3. {BODY}", f"Section 3. other {BODY}", chapter, f"Section 6. 12: Title; {'y' * 4000}", "Section 7. Whoever lies\nshall be punished with a fine. So it is."])
    split, clean = sections(spark, text)
    assert len(split) == 8
    got = {c[0]: c for c in clean}
    # 1 is short; of the three 3s the third is over the limit and the second begins like the first; 5 is a table of contents
    assert sorted(got) == [0, 2, 6, 7]
    assert got[6][3] == "12: Title; " + "y" * (3000 - 11) + "..." and got[6][2].startswith("Title; yyy") and len(got[6][2]) == 200 - 4
    assert got[7][4] == "shall be punished with a fine."
    assert [c[0] for c in sections(spark, text, expected=2)[1]] == [0, 2, 6]  # 2 * 1.2 are reached by the third
    assert len(sections(spark, "\n".join(f"Section {i}. {BODY} {i}" for i in range(1, 9)), expected=0)[1]) == 1


def test_numbered_sections(spark):
    body = "b" * 60
    ten = "\n".join(["Preamble", *(f"{i}. {body}" for i in range(1, 10)), f"10. {'t' * 151}\n{'z' * 3000}", "11. short"])
    df = spark.createDataFrame([(1, ten), (2, "\n".join(["P", *(f"{i}. {body}" for i in range(1, 10))]))], "id int, t string")
    got = sorted((r.id, r.pos, r.number, r.title, r.body, r.punishment) for r in a.numbered_sections(df, "id", "t").collect())
    assert [g[:3] for g in got] == [(1, i - 1, str(i)) for i in range(1, 11)]  # nine sections are 19 pieces, no such act
    assert got[0][3] == got[0][4] == body and got[9][3] == "t" * 147 + "..." and got[9][4] == ("t" * 151 + "\n" + "z" * 3000)[:3000] + "..."


def test_a_page_is_normalised_once(spark):
    """The sample isn't made again for each hint and mark."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Indian Penal Code 1860, an act of parliament " * 10, "Indian Penal Code 1860", "IPC"), (None, "Indian Penal Code 1860", "IPC")], "t string, n string, s string")
    out = df.select(a.target_page(F.col("t"), F.col("n"), F.col("s")).alias("v"))
    assert [r.v for r in out.collect()] == [True, False]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("6000") == 1


def test_acts_are_searched_once(spark):
    from quillon.operators import acts as a

    texts = spark.createDataFrame([(1, "Act\nSection 1. Name\nof it\n\nSection 2: Rest\n  Section 3\nlast"), (2, None), (3, "Section 1 alone")], "id long, t string")
    got = a.split_act(texts, "id", "t")
    assert [(r.idx, r.number, r.section_text) for r in sorted(got.collect())] == [(0, "1", "Name\nof it"), (1, "2", "Rest"), (2, "3", "last")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2  # once for either kind of heading
