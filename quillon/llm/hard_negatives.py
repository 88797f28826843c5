"""Hard-negative mining by a norm-bucketed search.

1. Rows are dealt to buckets by falling norm (equal norms are dealt on by a hash
   of the key, so that no norm fills a bucket) and packed into matrices.
2. Anchors are dealt to blocks and packed alike; a block meets a bucket in one
   matrix product. By Cauchy-Schwarz no score exceeds the product of the norms:
   a block isn't joined with a bucket, and an anchor is left out of a product,
   if that product is below what all the anchor's windows still want, the
   greater of a window's lower limit and its running kth score.
3. Every search has two waves: the first few buckets, then the others, which
   start from the kth scores that the first wave has found.
The positives are a search with one open window among rows of the same label;
each positive then is a window of the search among the other labels. A block's
state is k entries a window; what tasks found is ranked in one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import drop, ship, table, written

POSITIVES, NEGATIVES, EVERY = 5, 10, 100
#: A negative's score lies from LOW to HIGH per cent of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Anchors a block, bytes of a packed matrix of rows, bytes of packed anchors that are broadcast.
ANCHORS, MATRIX_BYTES, MOST_BROADCAST = 4096, 1 << 18, 16 << 20
#: The share of the buckets that a search's first wave takes.
FIRST = 8
NONE = np.iinfo(np.int64).max
WIDE = 1 << 62
EMPTY = -WIDE - 2
#: Rounding of norms and their product.
ROUND = 1 + 1e-9


def _packed(v: list[np.ndarray]) -> tuple[int, str, bytes]:
    """Whole-number vectors, shorter ones filled up with zeros: dimensions, type and bytes of their matrix."""
    dim = max(map(len, v), default=0)
    m = np.zeros((len(v), dim), np.int64)
    for i, x in enumerate(v):
        m[i, : len(x)] = x
    most = int(np.abs(m).max(initial=0))
    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"
    return dim, kind, m.astype(kind).tobytes()


def _ids(c: pa.Array) -> np.ndarray:
    return c.fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)


_BLOCKS = pa.schema([("bucket", pa.int32()), ("norm", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("dim", pa.int32()), ("kind", pa.string()), ("matrix", pa.binary())])


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, v, norm) by falling norm -> matrices of up to MATRIX_BYTES and of falling norm."""
    bucket = TaskContext.get().partitionId()
    ids, labels, v, norms = [], [], [], []

    def out():
        dim, kind, m = _packed(v)
        row = (bucket, max(norms), np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), dim, kind, m)
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    size = 0
    for b in batches:
        flat, ends = b.column(2).flatten().to_numpy(zero_copy_only=False), b.column(2).value_lengths().to_numpy(zero_copy_only=False).cumsum()
        for i, label, norm, end, n in zip(_ids(b.column(0)).tolist(), b.column(1).to_pylist(), b.column(3).to_pylist(), ends.tolist(), b.column(2).value_lengths().to_pylist(), strict=True):
            ids.append(i)
            labels.append(label)
            norms.append(norm)
            v.append(flat[end - n : end])
            size += 2 * n + 16
            if size >= MATRIX_BYTES:
                yield out()
                ids, labels, v, norms, size = [], [], [], [], 0
    if ids:
        yield out()


_ANCHORS = pa.schema([("block", pa.int64()), ("need", pa.float64()), ("a", pa.binary()), ("labels", pa.binary()), ("norms", pa.binary()), ("windows", pa.int32()), ("state", pa.binary()), ("dim", pa.int32()), ("kind", pa.string()), ("matrix", pa.binary())])


def _pack_anchors(t: pa.Table) -> pa.Table:
    """A block's (block, a, label, v, norm, lo, hi, score, id) as one row; state is lo, hi and the running kth score and id of each window."""
    windows = max(map(len, t["lo"].to_pylist()), default=0)
    fill = {"lo": WIDE, "hi": -WIDE, "score": WIDE, "id": NONE}
    state = np.array([[x + [f] * (windows - len(x)) for x in t[c].to_pylist()] for c, f in fill.items()], np.int64).reshape(4, t.num_rows, windows)
    norms = t["norm"].to_numpy()
    dim, kind, m = _packed([np.array(x, np.int64) for x in t["v"].to_pylist()])
    row = (t["block"][0].as_py(), float(_needs(norms, _wanted(state)).min(initial=np.inf)), t["a"].to_numpy().tobytes(), t["label"].to_numpy().astype(np.int64).tobytes(), norms.tobytes(), windows, state.tobytes(), dim, kind, m)
    return pa.table([pa.array([x], f.type) for x, f in zip(row, _ANCHORS, strict=True)], schema=_ANCHORS)


def _wanted(state: np.ndarray) -> np.ndarray:
    """The least score that any window of an anchor still takes."""
    return np.maximum(state[0], state[2]).min(axis=1, initial=WIDE)


def _needs(norms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The least norm with which a row may reach ``wanted``."""
    with np.errstate(divide="ignore"):
        return np.where(wanted <= 0, 0.0, wanted / (norms * ROUND))


class _Best:
    """The best k of each window of a block of anchors, and the products that still may change them."""

    def __init__(self, r: dict, k: int, same: bool):
        self.a, self.labels, self.norms = (np.frombuffer(r[c], t) for c, t in (("a", np.int64), ("labels", np.int64), ("norms", np.float64)))
        self.k, self.same, self.windows = k, same, r["windows"]
        self.lo, self.hi, self.score, self.id = np.frombuffer(r["state"], np.int64).reshape(4, len(self.a), self.windows).copy()
        self.m = np.frombuffer(r["matrix"], r["kind"]).reshape(len(self.a), r["dim"])
        n = len(self.a) * self.windows
        self.best = np.full((n, k), EMPTY, np.int64), np.full((n, k), NONE)
        self.need = _needs(self.norms, _wanted(np.stack([self.lo, self.hi, self.score, self.id])))

    def meet(self, ids: np.ndarray, labels: np.ndarray, norm: float, m: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            rows = np.flatnonzero(self.need <= norm)
            if not len(rows):
                return
            part = slice(at, at + max(32, at))  # few first, so that the running kth scores are high for the many
            self._add(rows, ids[part], labels[part], _scores(self.m[rows], m[part], float(self.norms[rows].max(initial=0)) * norm))
            at = part.stop

    def _add(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, s: np.ndarray) -> None:
        allowed = (self.labels[rows][:, None] == labels[None]) == self.same
        for w in range(self.windows):
            least = np.maximum(self.lo[rows, w], self.score[rows, w])
            hit = s >= least.astype(s.dtype)[:, None]
            hit &= s <= self.hi[rows, w].astype(s.dtype)[:, None]
            hit &= allowed
            i, j = np.divmod(np.flatnonzero(hit), len(ids))
            if not len(i):
                continue
            score, i = s[i, j].astype(np.int64), rows[i]
            better = (score > self.score[i, w]) | (ids[j] < self.id[i, w])
            if better.any():
                self._keep(i[better], w, score[better], ids[j[better]])

    def _keep(self, i: np.ndarray, w: int, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(i)
        key = touched * self.windows + w
        who = np.concatenate([np.repeat(touched, self.k), i])
        score, ids = np.concatenate([self.best[0][key].ravel(), score]), np.concatenate([self.best[1][key].ravel(), ids])
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        starts = np.searchsorted(who, touched)
        kept = starts[:, None] + np.arange(self.k)
        self.best[0][key], self.best[1][key] = score[kept], ids[kept]
        full = score[kept[:, -1]] > EMPTY
        t, last = touched[full], kept[full, -1]
        self.score[t, w], self.id[t, w] = score[last], ids[last]
        wanted = np.maximum(self.lo[t], self.score[t]).min(axis=1)
        self.need[t] = _needs(self.norms[t], wanted)

    def found(self) -> pa.RecordBatch:
        key, at = np.nonzero(self.best[0] > EMPTY)
        ids = self.best[1][key, at]
        a, w = np.divmod(key, self.windows) if self.windows else (key, key)
        return pa.RecordBatch.from_arrays([pa.array(self.a[a]), pa.array(w.astype(np.int32)), pa.array(self.best[0][key, at]), pa.array(ids, mask=ids == NONE)], schema=_FOUND)


def _scores(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Exact products: in floats where no partial sum, of at most ``most``, is rounded."""
    dim = min(x.shape[1], y.shape[1])
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    s = x[:, :dim].astype(kind) @ y[:, :dim].astype(kind).T
    return s if kind is not object else s.astype(np.int64)


_FOUND = pa.schema([("a", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def _search(blocks: DataFrame, buckets: list[tuple[int, float]], anchors: DataFrame, n_anchors: int, dim: int, k: int, same: bool, name: str) -> DataFrame:
    """The best k rows (a, w, score, id) of each window of ``anchors`` (a, label, v, norm, lo, hi) among the rows of the buckets, which fall by norm."""
    spark = blocks.sparkSession
    n_blocks, made, found = -(-n_anchors // ANCHORS), [], None
    first = -(-len(buckets) // FIRST)
    ranked = Window.partitionBy("a", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    for wave in filter(None, (buckets[:first], buckets[first:])):
        state = anchors
        if found is None:
            state = state.withColumn("score", F.transform("lo", lambda x: x - 1)).withColumn("id", F.transform("lo", lambda x: F.lit(int(NONE))))
        else:
            kth = found.filter(F.col("r") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("score", F.coalesce("id", F.lit(int(NONE))).alias("id"))))).alias("kth"))
            state = state.join(kth, "a", "left")
            running = lambda f, other: F.transform("lo", lambda x, i: F.coalesce(F.try_element_at("kth", i)[f], other(x)))  # noqa: E731, B023
            state = state.withColumn("score", running("score", lambda x: x - 1)).withColumn("id", running("id", lambda x: F.lit(int(NONE)))).drop("kth")
        packed = written(state.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(n_blocks))).groupBy("block").applyInArrow(_pack_anchors, "block long, need double, a binary, labels binary, norms binary, windows int, state binary, dim int, kind string, matrix binary"), "anchors")
        made.append(packed)
        which = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(x).alias("norm")) for b, x in wave])
        pairs = F.broadcast(packed.select("block", F.explode(F.transform(F.filter(which, lambda x: x["norm"] >= F.col("need")), lambda x: x["bucket"])).alias("bucket")))  # blocks times buckets, numbers only
        dealt = blocks.select("bucket", *[F.col(c).alias(f"r_{c}") for c in _BLOCKS.names[1:]]).join(pairs, "bucket")
        if n_anchors * (2 * dim + 32) <= MOST_BROADCAST:
            joined = dealt.join(F.broadcast(packed), "block")
        else:
            joined = dealt.join(packed.join(pairs, "block"), ["block", "bucket"])
        names = [*[f"r_{c}" for c in _BLOCKS.names[1:]], *_ANCHORS.names]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, _Best] = {}
            for b in batches:
                for r in b.to_pylist():
                    x = best.get(r["block"])
                    if x is None:
                        x = best[r["block"]] = _Best(r, k, same)
                    ids, labels = np.frombuffer(r["r_ids"], np.int64), np.frombuffer(r["r_labels"], np.int64)
                    x.meet(ids, labels, r["r_norm"], np.frombuffer(r["r_matrix"], r["r_kind"]).reshape(len(ids), r["r_dim"]))
            for x in best.values():
                yield x.found()

        some = joined.select(*names).mapInArrow(meet, "a long, w int, score long, id long")
        both = some if found is None else some.unionAll(found.drop("r"))
        found = written(both.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k), name)
        made.append(found)
    drop(*made[:-1])
    return found if found is not None else written(spark.createDataFrame([], "a long, w int, score long, id long, r int"), name)


def hard_negatives(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """Rows of (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null label, a null vector or a null or non-finite component
    take no part. Components become floor(scale * x); a score is the whole
    inner product, a shorter vector counting as filled up with zeros; one
    beyond 64 bits is an error. Anchors are rows whose key is divisible by
    ``every``, a null key none. An anchor's positives are its best
    ``positives`` other rows of its label, ties by the smaller key, null keys
    last; of several equal rows one counts as the anchor itself, the others
    are rows like any. For each positive the best ``negatives`` of other
    labels with low * positive <= 100 * negative <= high * positive follow.
    Repeated anchors give their rows each; an anchor without positives, or a
    positive without negatives, and an empty table give none. Other columns
    aren't read.
    """
    spark = rows.sparkSession
    ship(spark)
    given = rows.select(F.col(key).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.col(vector).alias("v"))
    valid = given.filter("label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND x > double('-Infinity') AND x < double('Infinity'))")
    whole = valid.withColumn("v", F.transform("v", lambda x: F.floor(scale * x.cast("double")))).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.repartitionByRange(parts, F.desc("norm"), F.xxhash64("id", "label", F.monotonically_increasing_id())).sortWithinPartitions(F.desc("norm"))
    blocks = written(dealt.mapInArrow(_pack_rows, "bucket int, norm double, ids binary, labels binary, dim int, kind string, matrix binary"), "norm_buckets")
    anchors = written(whole.filter(F.col("id") % every == 0).withColumn("a", F.monotonically_increasing_id()), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    buckets = [(r.bucket, r.norm) for r in blocks.groupBy("bucket").agg(F.max("norm").alias("norm")).orderBy("bucket").collect()]  # one number a bucket
    search = anchors.select("a", "label", "v", "norm")
    open_window = search.select("*", F.array(F.lit(-WIDE)).alias("lo"), F.array(F.lit(WIDE)).alias("hi"))
    near = _search(blocks, buckets, open_window, size.n, size.dim or 0, positives + 1, True, "positives")
    # the anchor itself is among them, if it is good enough
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    ordered = Window.partitionBy("a").orderBy("r")
    selves = near.join(anchors.select("a", F.col("id").alias("own_id"), own.alias("own_score")), "a").withColumn("self", (F.col("id") == F.col("own_id")) & (F.col("score") == F.col("own_score")))
    selves = selves.withColumn("selves", F.sum(F.coalesce(F.col("self"), F.lit(False)).cast("int")).over(ordered)).filter(~(F.coalesce(F.col("self"), F.lit(False)) & (F.col("selves") == 1)))
    positive = written(selves.withColumn("w", (F.row_number().over(ordered) - 1).cast("int")).filter(F.col("w") < positives).select("a", "w", "own_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = positive.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("w", "positive_score"))).alias("p"))
    windows = search.join(limits, "a")
    windows = windows.withColumn("lo", F.transform("p", lambda p: F.ceil(F.lit(low).cast("decimal(20,0)") * p["positive_score"] / 100).cast("long"))).withColumn("hi", F.transform("p", lambda p: F.floor(F.lit(high).cast("decimal(20,0)") * p["positive_score"] / 100).cast("long"))).drop("p")
    far = _search(blocks, buckets, windows, size.n, size.dim or 0, negatives, False, "negatives")
    drop(blocks, anchors, near)
    out = far.join(positive, ["a", "w"])
    return out.select(F.col("own_id").alias("anchor_id"), "positive_id", F.col("r").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose vec_id is divisible by 7 are moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
