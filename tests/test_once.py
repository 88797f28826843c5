"""Repeatable batches: crashes, repeats, near copies over triggers, late rows, bounded state."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.streaming import once

SCHEMA = "id long, text string, at timestamp, n int"
DAY = datetime(2024, 1, 10)


class Crash(Exception):
    pass


def put(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, folder, root, f, schema=SCHEMA, **kw):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    f(stream, str(root), **kw).awaitTermination()


def crash_at(batch, step):
    def crash(b, s):
        if (b, s) == (batch, step):
            raise Crash

    return crash


@pytest.mark.parametrize("step", ["results", "done"])
def test_resume_after_a_crash(spark, tmp_path, step):
    src, root = tmp_path / "in", tmp_path / "out"
    put(spark, src, [(i, f"t{i}", DAY, i) for i in range(5)] + [(2, "again", DAY, 9), (None, "no key", DAY, 0)])
    put(spark, src, [(i, f"t{i}", DAY, i) for i in range(3, 9)])
    work = lambda df: df.select("id", (F.col("n") * 10).alias("m"))
    once_of = lambda stream, root, **kw: once.each_once(stream, root, "id", work, **kw)
    with pytest.raises(Exception):
        run(spark, src, root, once_of, crash=crash_at(1, step))
    run(spark, src, root, once_of)
    got = once.results(spark, str(root)).collect()
    assert sorted(r.id for r in got) == list(range(9)) and all(r.m == r.id * 10 or r.id == 2 for r in got)
    put(spark, src, [(i, "late", DAY, i) for i in range(7, 12)])
    run(spark, src, root, once_of)
    assert sorted(r.id for r in once.results(spark, str(root)).collect()) == list(range(12))


def texts(seed, n, groups):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(2000)}" for _ in range(60)] for _ in range(groups)]
    out = []
    for _ in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 30])):
            t[rng.randrange(60)] = f"e{rng.randrange(9999)}"
        out.append(" ".join(t))
    return out


def greedy(batches, horizon, threshold=80):
    """The rule in plain Python, over all pairs."""
    kept = []
    for rows in batches:
        for r in sorted(rows, key=lambda r: (r[2], r[0])):
            w = (r[1] or "").lower().split()
            s = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            near = [k for k in kept if s and k[2] and abs(k[1] - r[2]) <= horizon and 100 * len(s & k[2]) >= threshold * len(s | k[2])]
            if not near:
                kept.append((r[0], r[2], s))
    return sorted(k[0] for k in kept)


def test_near_copies_over_triggers(spark, tmp_path):
    src, root = tmp_path / "in", tmp_path / "out"
    t = texts(3, 90, 6)
    batches = [[(100 * b + i, t[30 * b + i], DAY + timedelta(hours=(i * 7) % 24 + 24 * b), i) for i in range(30)] for b in range(3)]
    batches[1] += [(150, None, DAY, 0), (151, " ", DAY, 0), (152, "only four short words", DAY, 0), (153, "Only FOUR short words", DAY, 0)]
    for b in batches:
        put(spark, src, b)
    job = lambda stream, root, **kw: once.skip_near_copies(stream, root, key="id", text="text", time="at", **kw)
    with pytest.raises(Exception):
        run(spark, src, root, job, crash=crash_at(1, "results"))
    run(spark, src, root, job)
    got = once.results(spark, str(root))
    assert sorted(r.id for r in got.collect()) == greedy(batches, timedelta(days=90)) and got.columns == ["id", "text", "at", "n"]
    # once more: nothing comes in twice
    run(spark, src, root, job)
    assert got.count() == once.results(spark, str(root)).count()


def test_horizon_and_late_rows(spark, tmp_path):
    src, root = tmp_path / "in", tmp_path / "out"
    same = " ".join(f"w{i}" for i in range(20))
    put(spark, src, [(1, same, DAY, 0)])
    put(spark, src, [(2, same, DAY + timedelta(days=5), 0), (3, same, DAY + timedelta(days=40), 0), (None, same, DAY, 0), (9, same, None, 0)])
    put(spark, src, [(4, same, DAY + timedelta(days=35), 0), (5, same, DAY - timedelta(days=3), 0), (6, same, DAY - timedelta(days=60), 0)])
    run(spark, src, root, lambda s, r: once.skip_near_copies(s, r, key="id", text="text", time="at", horizon="30 days"))
    assert sorted(r.id for r in once.results(spark, str(root)).collect()) == [1, 3, 6]
    days = {r.day for r in once.results(spark, str(root), "kept").select("day").distinct().collect()}
    assert len(days) == 3  # the state is the kept rows' signatures, by day


def test_one_bucket_of_many_copies(spark, tmp_path):
    """A group that is most of a batch: each of its rows meets the leaders only."""
    src, root = tmp_path / "in", tmp_path / "out"
    base = [f"w{i}" for i in range(50)]
    put(spark, src, [(i, " ".join(base if i % 2 else [*base[:-1], f"x{i % 9}"]), DAY, 0) for i in range(2000)])
    run(spark, src, root, lambda s, r: once.skip_near_copies(s, r, key="id", text="text", time="at"))
    assert [r.id for r in once.results(spark, str(root)).collect()] == [0]


def steps(root, seen):
    """A crash hook that notes how many rounds a batch took."""
    return lambda batch, step: seen.append(len([p for p in (root / "work" / f"batch={batch}").iterdir() if p.name.startswith("open-")])) if step == "kept" else None


def test_a_bucket_of_texts_that_stay_takes_few_rounds(spark, tmp_path):
    """Rows that share bands without being similar were decided one a round."""
    src, root, seen, rng = tmp_path / "in", tmp_path / "out", [], random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        t = list(base)
        for k in rng.sample(range(12), 2):
            t[5 * k + 2] = f"e{rng.randrange(99999)}"
        rows.append((i, " ".join(t), DAY + timedelta(minutes=(i * 37) % 80), 0))
    rows += [(100 + i, rows[i][1] + " tail", DAY + timedelta(hours=3), 0) for i in range(0, 80, 9)]
    put(spark, src, rows)
    run(spark, src, root, lambda s, r: once.skip_near_copies(s, r, key="id", text="text", time="at", crash=steps(root, seen)))
    got = sorted(r.id for r in once.results(spark, str(root)).collect())
    assert got == greedy([rows], timedelta(days=90)) and len(got) > 60 and seen == [1]


@pytest.mark.parametrize("front", [1, 4])
def test_rounds_of_small_fronts(spark, tmp_path, monkeypatch, front):
    """Several rounds and blocks, with a horizon inside the batch, against the rule in plain Python."""
    monkeypatch.setattr(once, "FRONT", front)
    src, root, seen = tmp_path / "in", tmp_path / "out", []
    t = texts(5, 120, 5)
    batches = [[(100 * b + i, t[60 * b + i], DAY + timedelta(hours=(i * 7) % 60 + 30 * b), i) for i in range(60)] for b in range(2)]
    for b in batches:
        put(spark, src, b)
    run(spark, src, root, lambda s, r: once.skip_near_copies(s, r, key="id", text="text", time="at", horizon="20 hours", crash=steps(root, seen)))
    assert sorted(r.id for r in once.results(spark, str(root)).collect()) == greedy(batches, timedelta(hours=20)) and max(seen) > 2


def test_shingles_are_hashes_of_slices(spark):
    """What earlier versions wrote can be compared with."""
    df = spark.createDataFrame([("A b  c d e f g",), ("a b",), ("a b c d e a b c d e a",), (" ",), (None,)], "t string")
    words = F.array_remove(F.split(F.lower(F.coalesce("t", F.lit(""))), r"\s+"), "")
    want = F.when(F.size("w") == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 5)))))
    rows = df.withColumn("w", words).select(once.shingles(F.col("t")).alias("s"), want.alias("want")).collect()
    assert all(r.s == r.want for r in rows) and [len(r.s) for r in rows] == [3, 1, 5, 0, 0]


def test_shingles_split_a_text_once(spark):
    """The words aren't made again for each shingle: a text of 20,000 words took minutes."""
    import time

    words = [f"w{i % 7001}" for i in range(20_000)]
    df = spark.createDataFrame([(" ".join(words),), ("One two",), (None,)], "t string").select(once.shingles(F.col("t")).alias("s"))
    began = time.time()
    got = [len(r.s) for r in df.collect()]
    assert got == [len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}), 1, 0] and time.time() - began < 30
