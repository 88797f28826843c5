"""Near duplicates by b-bit MinHash, confirmed on whole shingle sets.

1. A pass over the texts makes each set of 5-word shingles, its fingerprint,
   96 minima, of which 4 low bits each are kept, packed, and band keys: 19 of 5
   minima, or 24 of 4 for thresholds below 85. Equal sets become one node, so that exact copies cost nothing more.
2. Nodes that share a band key meet. Inside such a bucket packed signatures are
   compared by bit counts, corrected for chance agreement; chains of estimates
   at or above least_estimate() give candidate links, at most one a node.
   A bucket of more than BUCKET nodes is linked whole, without comparing.
3. The candidate graph's components are found by contraction. They only gather
   what must be compared: in each, links are confirmed on the full sets, and no
   pair is tested that is joined already. Texts are fetched for candidates only.
4. A large component is dealt to blocks. A few leaders, of the whole component,
   stand in each block, so that most of a group of copies is joined in one pass,
   whatever its size. What isn't in the largest class after that is compared with
   every block; the rest needn't be.
At a threshold of 85 a pair is missed by all bands with probability 1.5e-5, of 80
with 3.2e-6.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import Bounded, drop, fresh, ship, table, worker_cache, written
from quillon.llm.lm_scoring import mixed

WORDS, HASHES, NIBBLE = 5, 96, 4
#: Linked if 100 * intersection >= threshold * union; op8's figure, and the least that the bands are made for.
THRESHOLD, LEAST = 85, 80
#: Standard deviations by which an estimate may fall below the threshold.
SLACK = 4.5
BUCKET, BLOCK_ROWS, BLOCK_BYTES, LEADERS = 2000, 1000, 24_000_000, 32
#: Rows of keys and fingerprints that are broadcast, which the driver holds several times over; of more a bitmap of
#: BITS bits a row, MOST_BITS in all, tells which rows a shuffle must move.
MOST_BROADCAST = 100_000
BITS, MOST_BITS = 32, 1 << 28
U = np.uint64
_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(0, 1 << 64, HASHES, U, endpoint=False)[:, None] | U(1)
_XOR = _rng.integers(0, 1 << 64, HASHES, U, endpoint=False)[:, None]


def shingles(text: str | None, words: Bounded, of: int = WORDS) -> np.ndarray:
    """Fingerprints of a text's distinct shingles of ``of`` words, sorted; of the whole sequence, if it is shorter."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.array([], U)
    h = np.fromiter(map(words.__getitem__, w), U, len(w))
    n = min(of, len(h))
    x = np.full(len(h) - n + 1, n, U)
    for i in range(n):
        x = mixed(x * U(0xD1342543DE82EF95) + h[i : len(h) - n + 1 + i])
    return np.unique(x)


def minima(x: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, ~U(0))
    for i in range(0, len(x), 1024):
        np.minimum(out, ((x[i : i + 1024] ^ _XOR) * _MULTIPLY).min(axis=1), out=out)
    return out


def packed(m: np.ndarray) -> bytes:
    low = ((m >> U(20)) & U(15)).astype(np.uint8)
    return (low[::2] | (low[1::2] << 4)).tobytes()


def band_keys(m: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    bands, of = (19, 5) if threshold >= 85 else (24, 4)
    rows = m[: bands * of].reshape(bands, of)
    k = np.arange(1, bands + 1, dtype=U)
    for i in range(of):
        k = mixed(k * U(0xD1342543DE82EF95) + rows[:, i])
    return k.view(np.int64)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a packed signature (6 words) and others, corrected for chance agreement of 4 bits."""
    x = many ^ one
    x |= x >> U(1)
    x |= x >> U(2)
    x &= U(0x1111111111111111)
    same = 1 - np.bitwise_count(x).sum(axis=1) / HASHES
    chance = 1 / (1 << NIBBLE)
    return (same - chance) / (1 - chance)


def least_estimate(threshold: int) -> float:
    """The estimate from which a pair is compared: SLACK standard deviations below the threshold."""
    t, chance = threshold / 100, 1 / (1 << NIBBLE)
    same = t + (1 - t) * chance
    return t - SLACK * math.sqrt(same * (1 - same) / HASHES) / (1 - chance)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes in the one column of a table, which holds() asks. It is put together in the tasks; the driver gets it in pieces of 4 KB, and no row."""
    (h,) = hashes.columns
    bits = min(MOST_BITS, 1 << max(15, (BITS * hashes.count()).bit_length()))
    at = F.col(h).bitwiseAND(F.lit(bits - 1)) + 1
    pieces = hashes.filter(F.col(h).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in pieces.toLocalIterator():
        out[r.i - 1] = np.frombuffer(r.b, np.uint8)
    return out.reshape(-1)


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bitmap: all that are, and of the others the share of its bits that are set."""
    at = h & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def maybe(hashes: DataFrame, h: Column) -> Column:
    """Whether a row's hash ``h`` may be among ``hashes``; other columns of the row stay where they are."""
    shared = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes))

    @F.pandas_udf("boolean")
    def asked(x: pd.Series) -> pd.Series:
        return pd.Series(holds(shared.value, x.to_numpy(np.int64)))

    return asked(h)


def _words() -> Bounded:
    import xxhash

    return worker_cache("lm words", lambda: Bounded(lambda w: xxhash.xxh3_64_intdigest(w), 400_000))


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Of ``docs`` the key, the text and a fingerprint of it."""
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"))


def _signatures(docs: DataFrame, threshold: int) -> DataFrame:
    """Of (key, text, mark) rows of (key, mark, n, node, sig, bands); node is null for a text without words."""
    schema = T.StructType([docs.schema["key"], T.StructField("mark", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words()
        for b in batches:
            n, nodes, sigs, bands = [], [], [], []
            for t in b.column(1).to_pylist():
                x = shingles(t, words)
                n.append(len(x))
                if len(x):
                    m = minima(x)
                    nodes.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    sigs.append(packed(m))
                    bands.append(band_keys(m, threshold))
                else:
                    nodes.append(None)
                    sigs.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, of rows that come sorted by them."""
    at, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = r[:keys], []
            rows.append(r[keys:])
    if rows:
        yield at, rows


def _within(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Candidate links of buckets: (k, node, n, sig), sorted by k."""
    least = least_estimate(threshold)
    a, b = [], []
    for _, rows in _groups(batches, 1):
        sig = np.frombuffer(b"".join(r[2] for r in rows), U).reshape(len(rows), -1)
        n = np.array([r[1] for r in rows])
        left = np.arange(len(rows))
        while len(left):
            queue, left = [left[0]], left[1:]
            for i in queue:
                if not len(left):
                    break
                near = (estimates(sig[i], sig[left]) >= least) & (100 * np.minimum(n[left], n[i]) >= threshold * np.maximum(n[left], n[i]))
                found = left[near]
                left = left[~near]
                a += [rows[i][0]] * len(found)
                b += [rows[j][0] for j in found]
                queue += list(found)
        if len(a) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=_LINKS)
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=_LINKS)


def components(links: DataFrame) -> DataFrame:
    """Rows of (node, root) for every node of the links (a, b): root is one node of its component, the same for all.

    Each round hooks every node to its least neighbour, shortens the paths, and
    contracts the links, until none is left. What a round makes is written to the
    shared folder.
    """
    made = [written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")]
    edges, labels = made[0], None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
        for _ in range(2):
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("q"))
            parents = written(parents.join(up, "p").select("a", F.col("q").alias("p")), "parents")
            made.append(parents)
        of_a, of_b = parents.select("a", F.col("p").alias("pa")), parents.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(of_a, "a").join(of_b, "b").filter("pa <> pb")
        edges = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        made.append(edges)
        if labels is None:
            labels = parents.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            to = parents.select(F.col("a").alias("root"), "p")
            labels = written(labels.join(to, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
            made.append(labels)
    out = written(labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
    drop(*made)
    return out


def _confirmed(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links of nodes to the least of theirs: (comp, i, j, node, n, sig, label, few, text), sorted by the first three.

    Rows of one label are joined already. Only pairs with a row that is one of the few are compared.
    """
    words, least = _words(), least_estimate(threshold)
    for _, rows in _groups(batches, 3):
        rows.sort(key=lambda r: (r[1], r[0]))
        sets = [shingles(r[5], words) for r in rows]
        n, few = np.array([len(x) for x in sets]), np.array([r[4] for r in rows])
        sig = np.frombuffer(b"".join(r[2] for r in rows), U).reshape(len(rows), -1)
        own = np.unique([r[3] for r in rows], return_inverse=True)[1]  # the class of each row so far
        for i in range(1, len(rows)):
            low = np.searchsorted(n[:i], -(-threshold * n[i] // 100))  # smaller sets can't reach it
            if low == i:
                continue
            e = estimates(sig[i], sig[low:i])
            e[(e < least) | (own[low:i] == own[i]) | ~(few[low:i] | few[i])] = -1
            for j in np.argsort(-e, kind="stable"):
                if e[j] < 0:
                    break
                j = low + int(j)
                if own[j] == own[i]:
                    continue
                x, y = sets[i], sets[j]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int(np.count_nonzero(x[at] == y))
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    own[own == own[i]] = own[j]
        first: dict[int, bytes] = {}
        for c, r in zip(own.tolist(), rows, strict=True):
            first[c] = min(first.get(c, r[0]), r[0])
        out = [(r[0], first[c]) for c, r in zip(own.tolist(), rows, strict=True) if first[c] != r[0]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], schema=_LINKS)


def classes_of(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, parts: int, confirm: Callable) -> DataFrame:
    """Of nodes (node, best, n, sig) and their candidate components (node, root): rows (node, root), root the same for all that are linked.

    ``confirm`` gets rows (root, i, j, node, n, sig, label, few, text) sorted by the first three and gives links (a, b) inside them.
    """
    info = candidates.join(nodes.select("node", "best", "n", "sig"), "node")
    counts = info.groupBy("root").agg(F.count("*").alias("size"), F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = written(info.join(counts, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "candidates")
    wanted = placed.select("node", F.col("best.key").alias("k"), F.col("best.mark").alias("m"))
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    else:
        docs = docs.filter(maybe(wanted.select(F.xxhash64("k", "m").alias("h")), F.xxhash64("key", "mark")))
    found = docs.join(wanted, docs["key"].eqNullSafe(wanted["k"]) & (docs["mark"] == wanted["m"])).select("node", "text")
    texts = written(found.groupBy("node").agg(F.first("text").alias("text")), "texts")  # one of rows with equal keys and texts

    def confirmed(tasks: DataFrame, name: str) -> DataFrame:
        dealt = tasks.select("root", "i", "j", "node", "n", "sig", "label", "few").join(texts, "node").select("root", "i", "j", "node", "n", "sig", "label", "few", "text")
        return written(dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(confirm, "a binary, b binary"), name)

    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    leads = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("size")) < LEADERS)
    once = placed.select("*", F.explode(F.when(leads, every).otherwise(F.array("own"))).alias("i"))
    links = confirmed(once.select("*", F.lit(0).alias("j"), F.col("node").alias("label"), F.lit(True).alias("few")), "confirmed")
    made = [placed, texts, links]
    split = placed.filter("blocks > 1")
    if split.isEmpty():
        stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:
        classes = components(links)
        labelled = split.join(classes.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        most = labelled.groupBy("root", "label").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
        labelled = written(labelled.join(most, "root").withColumn("few", F.col("label") != F.col("main")), "labelled")
        few = labelled.filter("few")
        chunks = few.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("chunks"))
        chunk = F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")
        sides = few.join(chunks, "root").select("*", F.explode(every).alias("i")).withColumn("j", chunk)
        others = labelled.join(chunks, "root").select("*", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
        # one of the few that stands in its own block comes once
        others = others.filter(~(F.col("few") & (F.col("j") == chunk))).withColumn("few", F.lit(False))
        rest = confirmed(sides.unionByName(others), "confirmed")
        made += [classes, labelled, rest]
        stars = components(links.unionAll(rest))
        made.append(stars)
    out = written(stars.unionAll(stars.select(F.col("root").alias("node"), "root")).distinct(), "classes")
    drop(*made)
    return out


def _linked(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (key, text, mark): the rows (key, mark, n, node), the nodes, and the nodes with links (node, root, key, best), root the same for all of a component.

    best is the least (key is null, key, mark) of a node's rows.
    """
    if not LEAST <= threshold <= 100:
        raise ValueError(f"threshold must be from {LEAST} to 100")
    spark = docs.sparkSession
    ship(spark)
    parts = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(_signatures(docs, threshold), "signatures")
    nodes = written(rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.min(F.struct(F.col("key").isNull().alias("null"), "key", "mark")).alias("best"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    member = nodes.select("node", "n", "sig", F.explode("bands").alias("k"))
    sizes = nodes.select("node", F.explode("bands").alias("k")).groupBy("k").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1")
    shared = written(member.join(sizes, "k"), "buckets")
    small = shared.filter(F.col("size") <= BUCKET).select("k", "node", "n", "sig").repartition(parts, "k").sortWithinPartitions("k")
    large = shared.filter((F.col("size") > BUCKET) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    candidates = components(small.mapInArrow(lambda b: _within(b, threshold), "a binary, b binary").unionAll(large))
    classes = classes_of(docs, nodes, candidates, parts, lambda b: _confirmed(b, threshold))
    linked = written(classes.join(nodes.select("node", "key", "best"), "node"), "linked")
    drop(shared, candidates, classes)
    return rows, nodes, linked


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD) -> DataFrame:
    """Per row: key, n_shingles, component_id, kept.

    A null or empty text has an empty set and is linked with nothing: its
    component is its own key. Rows with the same key are rows of their own; a
    component's id is its least key that isn't null, and null if all are. kept
    is key = component_id, false for a null key unless its row is alone.
    Rows are linked at a similarity of ``threshold`` per cent, LEAST or more.
    Texts are shingled whole. An empty table gives no rows; other columns aren't read.
    """
    rows, nodes, linked = _linked(_marked(docs, key, text), threshold)
    out, component, alone = component_ids(rows, nodes, linked)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, alone).alias("kept"))


def component_ids(rows: DataFrame, nodes: DataFrame, linked: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The rows (key, n, node) with their component's id, and whether they are alone, as columns of the frame given; drops nodes and linked."""
    ids_of = linked.groupBy("root").agg(F.min("key").alias("component_id"))
    named = linked.select("node", "root").join(ids_of, "root").select("node", "component_id")
    alone = nodes.filter("copies > 1").select("node", "key").join(linked.select("node"), "node", "left_anti")
    named = written(named.unionAll(alone.select("node", F.col("key").alias("component_id"))), "named")
    drop(nodes, linked)
    out = rows.select("key", "n", "node").join(named.withColumn("in", F.lit(True)), "node", "left")
    return out, F.when(F.col("in"), F.col("component_id")).otherwise(F.col("key")), F.col("in").isNull()


def one_of_each(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: int = LEAST) -> DataFrame:
    """The rows of ``docs`` with one of each component, all columns, unchanged: the least key, nulls last, and of those the least fingerprint of the text.

    Components are told apart by their texts, so keys may repeat or be null; of
    rows that are equal in both one stays. Up to MOST_BROADCAST keys of rows
    that go are broadcast, so that no text is shuffled; of more, few texts of
    rows that stay are.
    """
    rows, nodes, linked = _linked(_marked(docs, key, text), threshold)
    firsts = linked.groupBy("root").agg(F.min("best").alias("keep"))
    keep = linked.select("node", "root").join(firsts, "root").select("node", "keep")
    alone = nodes.filter("copies > 1").select("node", F.col("best").alias("keep")).join(linked.select("node"), "node", "left_anti")
    grouped = rows.select("key", "mark", "node").join(keep.unionAll(alone), "node")
    own = F.struct(F.col("key").isNull().alias("null"), "key", "mark")
    judged = written(grouped.groupBy("key", "mark").agg(F.bool_and(own == F.col("keep")).alias("first"), F.count("*").alias("rows")).filter("NOT first OR rows > 1"), "judged")
    drop(rows, nodes, linked)
    mark = fresh(docs, "mark")
    marked = docs.withColumn(mark, F.coalesce(F.xxhash64(text), F.lit(0)))
    n = judged.count()
    gone = judged.select(F.col("key").alias(fresh(marked, "k")), F.col("mark").alias(fresh(marked, "m")), "first")
    k, m, _ = gone.columns
    same = marked[key].eqNullSafe(gone[k]) & (marked[mark] == gone[m])
    if n <= MOST_BROADCAST:
        gone = F.broadcast(gone)
        out = marked.join(gone, same, "left_anti").select(*docs.columns)
    else:
        may = maybe(gone.select(F.xxhash64(k, m).alias("h")), F.xxhash64(key, mark))
        out = marked.filter(~may).unionAll(marked.filter(may).join(gone, same, "left_anti")).select(*docs.columns)
        marked = marked.filter(may)
    if judged.filter("first").isEmpty():
        return out
    several = marked.join(gone.filter("first"), same, "left_semi")
    return out.unionAll(several.groupBy(key, mark).agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
