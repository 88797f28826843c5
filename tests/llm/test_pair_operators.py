"""op11 and op13: odd rows, ties, copies, and brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import hard_negatives as hn
from quillon.llm import jaccard_join as jj
from tests.oracle import DATA, compare, duck

NAN = float("nan")


def mined(rows, positives=5, negatives=10, every=100, low=30, high=90):
    """Plain Python over (vec_id, embedding, label); rows' places stand in for the rows."""
    ok = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for p, (a, q, la) in enumerate(ok):
        if a is None or a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), last(i), i, lb) for j, (i, v, lb) in enumerate(ok) if j != p]
        scored.sort(key=lambda x: x[:2])
        for s, _, i, _ in [x for x in scored if x[3] == la][:positives]:
            fit = [x for x in scored if x[3] != la and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out.update((a, i, k + 1, x[2], -s, -x[0]) for k, x in enumerate(fit))
    return out


def rows_of(df):
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def some_vectors():
    rng = random.Random(5)
    rows = [(i, [round(rng.gauss(0, 0.4), 2) * rng.choice([0.2, 1, 3]) for _ in range(6)], rng.randrange(3)) for i in range(1, 260)]
    rows += [(300 + i, [0.5, 0.5, 0.5, 0.5, 0.0, 0.0], i % 3) for i in range(60)]  # ties
    rows += [(1000, None, 1), (1001, [1.0, NAN, 1.0], 1), (1002, [1.0, None], 1), (1003, [1.0, float("inf")], 2), (1004, [0.3] * 6, None), (1005, [], 1), (1006, [2.0], 2), (None, [0.5] * 6, 0), (None, [0.4] * 6, 1)]
    return rows + [rows[99], rows[199], (400, [0.0] * 6, 1), (-100, [0.4, 0.1, 0.3], 2), (500, [300.0, 200.0, 100.0], 1), (501, [250.0, 260.0, 0.0], 1), (502, [150.0, 60.0, 0.0], 0)]


@pytest.mark.parametrize("broadcast", [hn.MOST_BROADCAST, 0])
def test_negatives_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(hn, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(hn, "MATRIX_BYTES", 600)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    rows = some_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("norm", F.lit("clash")).withColumn("a", F.lit(1)).repartition(4)
    for kw in ({}, {"positives": 2, "negatives": 3, "every": 50, "low": 0, "high": 100}):
        want = mined(rows, **kw)
        assert rows_of(hn.hard_negatives(df, **kw)) == want and want


def test_negatives_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hn.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], schema)).count() == 0  # no anchors
    assert hn.hard_negatives(spark.createDataFrame([(100, [1.0], 1), (2, [0.5], 2)], schema)).count() == 0  # no positives
    assert hn.hard_negatives(spark.createDataFrame([(100, [1.0], 1), (2, [0.5], 2), (3, [1.0], 1)], schema)).collect()[0].asDict() == {"anchor_id": 100, "positive_id": 3, "rank": 1, "negative_id": 2, "positive_score": 65536, "negative_score": 32768}


def test_norms_prune(spark):
    """A bucket whose norms can't reach what an anchor wants isn't multiplied with it."""
    x = hn._Best({"a": np.array([1]).tobytes(), "labels": np.array([1]).tobytes(), "norms": np.array([2.0]).tobytes(), "windows": 1, "state": np.array([[[10]], [[99]], [[9]], [[hn.NONE]]]).tobytes(), "matrix": np.array([[2]], "i2").tobytes(), "kind": "i2", "dim": 1}, 2, False)
    ids, labels = np.array([5, 6, 7]), np.array([2, 2, 1])
    x.meet(ids, labels, 4.9, None)  # 2 * 4.9 < 10: the matrix isn't read
    x.meet(ids, labels, 9.0, np.array([[9], [7], [8]]))
    assert x.found().to_pylist() == [{"a": 1, "w": 0, "score": 18, "id": 5}, {"a": 1, "w": 0, "score": 14, "id": 6}]
    assert x.need[0] == pytest.approx(7.0)  # the kth score is 14 now


def test_negatives_sql(spark):
    compare(hn.op11_hard_negatives(spark, DATA), hn.OP11_SQL, duck())


def plain_sets(rows, of=3):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + of]) for i in range(len(w) - of + 1)} if len(w) >= of else {tuple(w)} if w else set())
    return sets


def joined(rows, threshold=90, of=3):
    """Rows (key, n, component) by comparing all pairs that share a shingle."""
    sets, seen, root = plain_sets(rows, of), defaultdict(list), [*range(len(rows))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in seen[g])
        for j, k in shared.items():
            if 100 * k >= threshold * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for g in s:
            seen[g].append(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows))


def classes(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def edited(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randrange(400)) if rng.random() < share else w for w in words]


def near_copies(seed, group, short):
    """Texts at all distances from each other, of sizes around the classes' ends, with a common passage and short texts."""
    rng = random.Random(seed)
    texts = []
    for size in [9, 10, 11, 12, 13, 20, 41, 42, 60, 61, 62, 93, 140, 211, 317, 480]:
        base = [f"w{rng.randrange(900)}" for _ in range(size)]
        for _ in range(group):
            t = edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.04, 0.1]))
            texts.append(" ".join(t[rng.randrange(2) :] + ["tail"] * rng.choice([0, 0, 1, 3])))
    passage = " ".join(f"common{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"own{i}x{j}" for j in range(rng.choice([1, 3, 6, 40]))) for i in range(short)]
    return texts + [None, "", "one", "One", "two words", "two  words", "a b c", "A b C", "a b c d"] + ["x y"] * 5


def test_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jj, "GROUP", 3)
    rows = list(enumerate(near_copies(3, 8, 60)))
    rows += [(None, rows[4][1]), (None, "null key of its own"), (rows[3][0], rows[3][1]), (rows[5][0], "another text under a known key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("keys", F.lit(1)).repartition(5)
    assert classes(jj.jaccard_classes(df)) == joined(rows)
    assert classes(jj.jaccard_classes(df, threshold=80, words=2)) == joined(rows, 80, 2)
    assert jj.jaccard_classes(df.filter("false")).count() == 0


def test_join_in_blocks(spark, monkeypatch):
    from quillon.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 20)
    monkeypatch.setattr(near_dedup, "LEADERS", 3)
    monkeypatch.setattr(jj, "MOST_BROADCAST", 0)
    rows = list(enumerate(near_copies(4, 70, 90)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert classes(jj.jaccard_classes(df)) == joined(rows)


def test_rows_beyond_the_broadcast_go_by_a_bitmap(spark, monkeypatch):
    """A million keys and fingerprints were broadcast, for which the driver's memory didn't do; the bitmap's size doesn't depend on the rows beyond its bound."""
    from quillon.llm import near_dedup

    assert near_dedup.MOST_BROADCAST <= 100_000
    every = spark.range(40_000).select("id", F.xxhash64("id").alias("h"))
    wanted = every.filter("id % 10 = 3").select("h")
    got = {r.id for r in every.filter(near_dedup.maybe(wanted, F.col("h"))).collect()}
    assert {i for i in range(40_000) if i % 10 == 3} <= got and len(got) < 4000 + 36_000 / near_dedup.BITS * 2
    assert not near_dedup.holds(near_dedup.bitmap(wanted.filter("false")), np.array([5, -7])).any()
    monkeypatch.setattr(near_dedup, "MOST_BITS", 1 << 15)
    bits = near_dedup.bitmap(wanted)
    assert len(bits) == 4096 and near_dedup.holds(bits, np.array([r.h for r in wanted.collect()])).all()


def test_matrix_keys_by_a_bitmap(spark):
    nodes = spark.createDataFrame([(1, [5, -6, 7]), (2, []), (3, [-6]), (4, [8, 9])], "id long, keys array<long>").coalesce(1)
    keys = spark.createDataFrame([(-6,), (9,)], "k long")
    assert {(1, -6), (3, -6), (4, 9)} == {tuple(r) for r in jj._held(nodes, keys).collect()}


@pytest.mark.parametrize("most", [0, 100])
def test_one_of_each_beyond_the_broadcast(spark, monkeypatch, most):
    from quillon.llm import near_dedup

    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", most)
    rows = list(enumerate(near_copies(6, 4, 20))) + [(None, "one text of many words that has no key at all"), (None, "one text of many words that has no key at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = near_dedup.one_of_each(df)
    want = {r.doc_id for r in near_dedup.near_duplicates(df.filter("doc_id IS NOT NULL"), threshold=near_dedup.LEAST).filter("kept").collect()} | {None}
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(want) and {*got} == want


def test_join_of_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert classes(jj.op13_jaccard_join(spark, DATA)) == joined([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_similar_sets_share_a_slice():
    """Every pair at the threshold has a key in common; the bound of the matrix lets it through."""
    rng = np.random.default_rng(8)
    for t in (jj.LEAST, 80, 90, 95):
        slices = jj.Slices(t)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, max(1, (100 - t) * len(x) // 100 + 1)))
            y = np.delete(x, rng.choice(len(x), min(drop, len(x) - 1), replace=False))
            room = (100 * len(y)) // t - len(x)
            if room > 0:
                y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, int(rng.integers(0, room + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= t * (len(x) + len(y) - both) and not np.array_equal(x, y):
                assert {*slices.keys(x).tolist()} & {*slices.keys(y).tolist()}, (t, len(x), len(y), both)
                assert 100 * jj.Matrix([x, y], [[0], [1]]).overlaps(x, 2)[1] >= t * len(x)
