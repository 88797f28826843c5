"""Language-model scores from a log-frequency Bloom filter.

Counting. Each task counts the words and word pairs of its training texts as
64-bit fingerprints and deals the sorted counts, packed, to shards by the
fingerprint's top bits. A shard adds them up and builds its own segment of the
filter: an n-gram of count c is entered as the events (n-gram, 1) to
(n-gram, q), q = 1 + floor(log2 c). The segments grow with what was counted.

Scoring. The filter is put together and broadcast while the words' part has at
most ``most_words_mb`` and the pairs' at most ``most_mb``. A larger one stays
where it is: the texts' distinct words and pairs are dealt to its shards, each
shard probes its own segment, and the answers are joined to the numbered tokens,
with the same scores. A count is read by repeated membership probes (n-gram, 1),
(n-gram, 2), ... until one fails, and stands for the middle of its range. A token's probability mixes
the pair's share of its history with the word's, by a weight that depends on the
history's quantised count and is fitted by leaving each token out, over all
training texts. Words' shares are of the sum of all words' read counts, and
pairs' of the sum of their history's, so that a history's probabilities, an
unknown word's with them, sum to 1 (but for false positives of the filter). The
histories' sums come from the shards: a pair's fingerprint holds 32 bits of its
history, behind SALT bits that split frequent ones. They are broadcast for the
``frequent`` most frequent words; a rarer history's pairs count with the least of
their range over the most of its own, so that they sum to less than 1.

The base score needs exact counts: those of the ``frequent`` most frequent
words are broadcast, those of the others are joined. A word that the filter
doesn't know needs no join; what is left is rare in training texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.common import drop, ship, small_batches, table, written

FOLDS, HELD_OUT = 5, 1
#: Bits of the filter an event, and probes an event, all in one 64-bit block.
BITS, PROBES = 12, 5
#: Most MB of the pairs' and of the words' filter that are broadcast; words whose counts are.
MOST_MB, MOST_WORDS_MB, FREQUENT = 256, 256, 1_000_000
#: Bits of a pair's fingerprint before those of its history.
SALT = 4
LEVELS = 48
GRID = np.concatenate([[0], np.geomspace(0.0003, 0.1, 16), np.linspace(0.13, 0.97, 29)])
_END = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that a task holds before it deals them, and counts that a shard holds before it adds them up.
_FLUSH, _WAITING = 750_000, 1_000_000
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def held_out(key) -> bool:
    """Whether a document is in the held-out fold: crc32 of its id as text; a null id's text is empty."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS == HELD_OUT


def _trained(ids: pa.Array) -> pa.Array:
    return pa.array([not held_out(x) for x in ids.to_pylist()], pa.bool_())


def encoded(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of whole texts, for ranges of them with about ``most`` bytes.

    Gives the range, the number of tokens of each text, the fingerprints of the
    range's words, lower-cased in A-Z, and last of an end, and each token's place
    in these. Each text ends with an end token. A null text is empty.
    """
    import xxhash

    hashed = xxhash.xxh3_64_intdigest
    texts = pc.fill_null(texts, "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).cumsum()
    start = done = 0
    while start < len(texts):
        end = min(len(texts), max(start + 1, int(np.searchsorted(size, done + most, side="right"))))
        done = int(size[end - 1])
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts[start:end]))
        at = lists.offsets.to_numpy().astype(np.int64)
        codes = lists.flatten().dictionary_encode()
        words = codes.dictionary.cast(pa.binary()).to_pylist()
        code = codes.indices.to_numpy()
        some = code != words.index(b"") if b"" in words else np.ones(len(code), bool)  # no words, but what surrounds white space at either end
        upto = np.concatenate([[0], np.cumsum(some)])
        n = upto[at[1:] - at[0]] - upto[at[:-1] - at[0]] + 1
        place = np.full(int(n.sum()), len(words), np.int32)
        word = np.ones(len(place), bool)
        word[np.cumsum(n) - 1] = False
        place[word] = code[some]
        yield start, end, n, np.array([*map(hashed, words), int(_END)], U), place
        start = end
    pa.default_memory_pool().release_unused()


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shards of fingerprints: their top bits, for a power of two of shards."""
    return (keys >> U(64 - shards.bit_length() + 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)


def pairs(t: np.ndarray) -> np.ndarray:
    """Fingerprints of each token with the one before it (the first's is an end)."""
    h = np.empty_like(t)
    h[0], h[1:] = _END, t[:-1]
    k = mixed(h * U(0xD1342543DE82EF95) + t)
    low = 32 - SALT
    return (k >> U(64 - SALT) << U(64 - SALT)) | (h >> U(32) << U(low)) | (k & U((1 << low) - 1))


def histories(keys: np.ndarray) -> np.ndarray:
    """The 32 bits of the history in pairs' fingerprints."""
    return keys << U(SALT) >> U(32)


def added(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts; without counts the keys are sorted where they are."""
    if counts is None:
        keys.sort()  # in place, as memory counts here
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
        return keys[first], np.diff(first, append=len(keys))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# ---------------------------------------------------------------- the filter


def quantised(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1]  # 1 + floor(log2 c)


#: The middle of a quantised count's range, its least and its most; 0 for none.
MEANS = np.array([0.0, *(1.5 * 2.0**j - 0.5 for j in range(LEVELS))])
LEASTS = np.array([0.0, *(2.0**j for j in range(LEVELS))])
MOSTS = np.array([0.0, *(2.0 ** (j + 1) - 1 for j in range(LEVELS))])


def _event(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the events (key, level): 32 bits that choose a block, and bits that choose the probes inside it."""
    a = mixed(keys + U(level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    return a >> U(32), a


def segment(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard's part of the filter."""
    q = quantised(counts)
    bits = max(64, -(-int(q.sum()) * BITS // 64) * 64)
    if bits >= 1 << 38:
        raise ValueError("a shard holds too much; use more shards")
    out = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        block, probes = _event(keys[q >= level], level)
        block = (block * U(bits // 64) >> U(32)) * U(64)
        for i in range(PROBES):
            out[block + (probes >> U(6 * i) & U(63))] = True
    return np.packbits(out, bitorder="little").tobytes()


class Filter:
    """The segments of the shards, put together; a shard without one holds nothing.

    With the ``sizes`` of the segments given, they may come one by one in any
    order, so that there is never more than one copy of them all.
    """

    def __init__(self, shards: int, segments: dict[int, bytes] | Iterable[tuple[int, bytes]], sizes: dict[int, int] | None = None):
        self.shards = shards
        self.start, self.size = np.zeros(shards, U), np.zeros(shards, U)
        if isinstance(segments, dict):
            segments, sizes = segments.items(), {k: len(x) for k, x in segments.items()}
        at = 0
        for k in sorted(sizes):
            self.start[k], self.size[k] = at, sizes[k] // 8
            at += sizes[k] // 8
        self.bits = bytearray(max(8, 8 * at))
        for k, x in segments:
            self.bits[8 * int(self.start[k]) : 8 * int(self.start[k] + self.size[k])] = x

    def levels(self, keys: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """Quantised counts, by probing one level after the other, up to ``most``."""
        blocks = np.frombuffer(self.bits, "<u8")
        q = np.zeros(len(keys), np.int64)
        shard = shard_of(keys, self.shards)
        start, size = self.start[shard], self.size[shard]
        live = np.flatnonzero(size > 0)
        for level in range(1, LEVELS):
            if most is not None:
                live = live[most[live] >= level]
            if not len(live):
                break
            block, probes = _event(keys[live], level)
            found = blocks[start[live] + (block * size[live] >> U(32))]
            want = U(1) << (probes & U(63))
            for i in range(1, PROBES):
                want |= U(1) << (probes >> U(6 * i) & U(63))
            live = live[found & want == want]
            q[live] = level
        return q


# ---------------------------------------------------------------- counting


def _count(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """Rows of (kind, shard, hashes, counts): kind 0 words, with counts; kind 1 segments of words', kind 2 of pairs' filter (in ``filter``); kind 3 histories, with twice the sum of their pairs' read counts.

    ``total`` has the words' tokens in kind 0, their number in kind 1, and twice the sum of their read counts in kind 4.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, counts, two, n = [], [], [], 0

        def flush():
            for kind in (0, 1):
                if kind == 0:
                    k, c = added(np.concatenate(kinds), np.concatenate(counts))
                else:
                    every = np.concatenate(two)
                    two.clear()
                    k, c = added(every)
                    del every
                c = c.astype(np.uint32)
                cuts = np.searchsorted(shard_of(k, shards), np.arange(shards + 1))
                some = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
                for i in range(0, len(some), 16):
                    part = some[i : i + 16]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array([memoryview(k[cuts[s] : cuts[s + 1]]).cast("B") for s in part], pa.binary()), pa.array([memoryview(c[cuts[s] : cuts[s + 1]]).cast("B") for s in part], pa.binary())], names=["kind", "shard", "keys", "counts"])

        for b in batches:
            for _, _, _, k, place in encoded(b.column(1).filter(_trained(b.column(0)))):
                c = np.bincount(place, minlength=len(k))
                kinds.append(k[c > 0])
                counts.append(c[c > 0])
                two.append(pairs(k[place]))
                n += len(place)
                if n >= _FLUSH:
                    yield from flush()
                    kinds, counts, two, n = [], [], [], 0
        if n:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("filter", pa.binary()), ("total", pa.int64())])
        at, keys, counts, waiting = None, [], [], 0

        def row(kind, shard, hashes, c, f, total):
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((kind, shard, hashes, c, f, total), schema, strict=True)], schema=schema)

        def done():
            k, c = added(np.concatenate(keys), np.concatenate(counts))
            kind, shard = at
            twice = (2 * MEANS[quantised(c)]).astype(np.int64)
            if kind == 0:
                for i in range(0, len(k), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    yield row(0, shard, k[s].view(np.int64), c[s], None, int(c[s].sum()))
                yield row(4, shard, None, None, None, int(twice.sum()))
            else:
                h = histories(k)
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                of, sums = h[first].view(np.int64), np.add.reduceat(twice, first)
                for i in range(0, len(of), 1 << 16):
                    yield row(3, shard, of[i : i + (1 << 16)], sums[i : i + (1 << 16)], None, 0)
            yield row(kind + 1, shard, None, None, segment(k, c), len(k))

        for b in batches:
            for kind, shard, k, c in zip(*b.columns, strict=True):
                kind, shard = kind.as_py(), shard.as_py()
                if (kind, shard) != at:
                    if at is not None:
                        yield from done()
                    at, keys, counts, waiting = (kind, shard), [], [], 0
                keys.append(np.frombuffer(k.as_buffer(), U).copy())  # lest it keep its batch
                counts.append(np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64))
                waiting += len(keys[-1])
                if waiting > _WAITING and len(keys) > 1:
                    m = added(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, waiting = [m[0]], [m[1]], 0
        if at is not None:
            yield from done()

    dealt = docs.select(key, text).mapInArrow(gather, "kind int, shard int, keys binary, counts binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "shard")
    return written(dealt.mapInArrow(merge, "kind int, shard int, hashes array<long>, counts array<long>, filter binary, total long"), "lm-counts")


def _filter(counted: DataFrame, kind: int, shards: int, most: int = 16_000_000) -> Filter:
    """The whole filter, brought to the driver in pieces of about ``most`` bytes."""
    rows = counted.filter(F.col("kind") == kind)
    sizes = dict(rows.select("shard", F.length("filter")).collect())

    def segments():
        first, waiting, last = 0, 0, max(sizes, default=0)
        for k in sorted(sizes):
            waiting += sizes[k]
            if waiting >= most or k == last:
                for r in rows.filter((F.col("shard") >= first) & (F.col("shard") <= k)).select("shard", "filter").collect():
                    yield r.shard, r.filter
                first, waiting = k + 1, 0

    return Filter(shards, segments(), sizes)


def _frequent(counted: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The count from which words are frequent, so that at most ``most`` are; those words' fingerprints, sorted, their counts, and the sums of the read counts of pairs that they begin."""
    each = counted.filter("kind = 0").select(F.explode("counts").alias("c"))
    by_bits = dict(each.groupBy(F.floor(F.log2("c")).alias("b")).count().collect())  # at most 64 rows
    bits, n = 64, 0
    while bits and n + by_bits.get(bits - 1, 0) <= most:
        bits -= 1
        n += by_bits.get(bits, 0)
    least = 1 << bits
    rows = counted.filter("kind = 0").select(F.arrays_zip("hashes", "counts").alias("z")).select(F.filter("z", lambda z: z["counts"] >= least).alias("z")).filter(F.size("z") > 0).select(F.col("z.hashes").alias("h"), F.col("z.counts").alias("c")).toArrow()
    keys = np.concatenate([np.array([], np.int64), *(np.asarray(x.values) for x in rows["h"])]).view(U)
    counts = np.concatenate([np.array([], np.int64), *(np.asarray(x.values) for x in rows["c"])])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    every = counted.filter("kind = 3").select(F.inline(F.arrays_zip("hashes", "counts"))).groupBy("hashes").agg(F.sum("counts").alias("n"))
    own = counted.filter("kind = 0").select(F.inline(F.arrays_zip("hashes", "counts"))).filter(F.col("counts") >= least).select(F.shiftrightunsigned("hashes", 32).alias("hashes")).distinct()
    found = every.join(own, "hashes").toArrow()  # no more than the frequent words
    at = found["hashes"].to_numpy().astype(U)
    by = np.argsort(at)
    at, n = at[by], found["n"].to_numpy()[by] / 2
    place = np.minimum(np.searchsorted(at, keys >> U(32)), max(0, len(at) - 1))
    sums = np.where(at[place] == keys >> U(32), n[place], 0.0) if len(at) else np.zeros(len(keys))
    return least, keys, counts, sums


# ---------------------------------------------------------------- scoring


class Model:
    """Probabilities out of read counts.

    ``top`` and ``sums`` are the frequent words' fingerprints, sorted, and the sums of
    the read counts of the pairs that they begin; ``norm`` is the words' sum with what smooths it.
    """

    def __init__(self, norm: float, top: np.ndarray, sums: np.ndarray):
        self.norm, self.top, self.sums = norm, top, sums

    def summed(self, kinds: np.ndarray) -> np.ndarray:
        """The sums of words that are frequent; 0 for others."""
        if not len(self.top):
            return np.zeros(len(kinds))
        at = np.minimum(np.searchsorted(self.top, kinds), len(self.top) - 1)
        return np.where(self.top[at] == kinds, self.sums[at], 0.0)

    def read(self, kinds: np.ndarray, place: np.ndarray, levels: np.ndarray, two: Callable[[np.ndarray, np.ndarray], np.ndarray], left_out: bool) -> tuple[np.ndarray, ...]:
        """For the tokens of whole texts in a row: the histories' levels, the pairs' shares, the words' probabilities, the words' levels.

        ``levels`` are those of the kinds; ``two`` gives pairs' levels up to a most.
        Each text ends with an end token, so that what stands before a text's first token is one.
        """
        before = np.empty(len(place), np.int64)
        level = levels[place]
        before[0], before[1:] = levels[-1], level[:-1]
        sums = self.summed(kinds)
        of = np.empty(len(place))
        of[0], of[1:] = sums[-1], sums[place[:-1]]
        pair = two(pairs(kinds[place]), np.minimum(level, before))  # a pair isn't more frequent than its words
        one, less = MEANS[levels], int(left_out)
        frequent = of > 0
        share = np.maximum(np.where(frequent, MEANS[pair], LEASTS[pair]) - less, 0) / np.maximum(np.where(frequent, of, MOSTS[before]) - less, 1)
        return before, np.minimum(1, share), ((np.maximum(one - less, 0) + 0.5) / self.norm)[place], level


def _dealt(docs: DataFrame, counted: DataFrame, shards: int) -> DataFrame:
    """Levels of all words and pairs of (key, text) rows, read by the shards: rows of (ids, n, kinds, place, answers).

    A row has a range of texts as encoded() gives it, its numbers written before
    they are dealt. answers are (kind, shard, levels), of the sorted fingerprints
    of its words (kind 1) and of its distinct pairs (kind 2).
    """
    schema = T.StructType().add("rid", "long").add("ids", T.ArrayType(docs.schema["key"].dataType)).add("n", "binary").add("kinds", "binary").add("place", "binary")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            for start, end, n, kinds, place in encoded(b.column(1)):
                ids = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), b.column(0)[start:end])
                yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in (n, kinds, place))], names=schema.names)
                rid += 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, kinds, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kinds, place = np.frombuffer(kinds, U), np.frombuffer(place, np.int32)
                for kind, keys in ((1, np.sort(kinds)), (2, np.unique(pairs(kinds[place])))):
                    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
                    some = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([rid] * len(some), pa.int64()), pa.array([keys[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())], names=["kind", "shard", "rid", "part"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for b in batches:
            out = []
            for kind, shard, rid, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (kind, shard) != at:
                    at, own = (kind, shard), Filter(shards, {})
                if rid < 0:  # the shard's own segment, before what is asked of it
                    own = Filter(shards, {shard: part})
                else:
                    out.append((kind, shard, rid, own.levels(np.frombuffer(part, U)).astype(np.uint8).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["kind", "shard", "rid", "levels"])

    numbered = written(docs.mapInArrow(number, schema), "lm-tokens")
    segments = counted.filter("kind IN (1, 2)").filter("filter IS NOT NULL").select("kind", "shard", F.lit(-1).cast("long").alias("rid"), F.col("filter").alias("part"))
    asked = numbered.select("rid", "kinds", "place").mapInArrow(deal, "kind int, shard int, rid long, part binary").unionAll(segments)
    answered = asked.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "shard", "rid").mapInArrow(probe, "kind int, shard int, rid long, levels binary")
    answers = answered.groupBy("rid").agg(F.collect_list(F.struct("kind", "shard", "levels")).alias("answers"))  # no more of a range than its own words and pairs
    out = written(numbered.join(answers, "rid").drop("rid"), "lm-levels")
    drop(numbered)
    return out


#: Bins of the log2 of a pair's share over its word's probability, for the fit; the first is for no pair.
_BINS, _LOWEST, _FINE = 512, -16, 8


def lm_scores(docs: DataFrame, *, text: str = "text", key: str = "doc_id", most_mb: float = MOST_MB, most_words_mb: float = MOST_WORDS_MB, frequent: int = FREQUENT) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token.

    Trained on the rows that aren't held out (see held_out). A null or empty
    text is its end token alone. Null keys count as the empty text for the fold;
    repeated rows each count and are each scored. Without training rows
    train_tokens is 0 and every base probability 1. A filter beyond ``most_mb`` or
    ``most_words_mb`` isn't broadcast but asked in its shards; the result is the
    same. Texts are read whole; other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shards = 8
    while shards < min(docs.rdd.getNumPartitions(), 1 << 16):
        shards *= 2
    counted = _count(docs, "key", "text", shards)
    sums = {r.kind: r for r in counted.groupBy("kind").agg(F.sum("total").alias("total"), F.sum(F.length("filter")).alias("bytes")).collect()}
    total, kinds = (int(sums[0].total), int(sums[1].total)) if 0 in sums else (0, 0)
    least, top, top_counts, top_sums = _frequent(counted, frequent)
    share = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    sc = spark.sparkContext
    read_norm = (sums[4].total / 2 if 4 in sums else 0) + 0.5 * (kinds + 1)
    small = all(k not in sums or sums[k].bytes <= mb * 1e6 for k, mb in ((1, most_words_mb), (2, most_mb)))
    shared = sc.broadcast({"top": top, "sums": top_sums, "logs": share(top_counts)} | ({"words": _filter(counted, 1, shards)} if small else {}))
    two = sc.broadcast(_filter(counted, 2, shards)) if small else None
    source = docs if small else _dealt(docs, counted, shards)

    def model() -> Model:
        return Model(read_norm, shared.value["top"], shared.value["sums"])

    def probed(batches: Iterator[pa.RecordBatch], left_out: bool):
        """Ranges of texts with the broadcast filter's counts: keys, tokens of each text, kinds, places, which tokens count, and what read() gives."""
        m, words = model(), shared.value["words"]
        for b in batches:
            ids, texts = b.columns
            if left_out:
                own = _trained(ids)
                ids, texts = ids.filter(own), texts.filter(own)
            for start, end, n, k, place in encoded(texts):
                yield ids[start:end].to_pylist(), n, k, place, slice(None), m.read(k, place, words.levels(k), two.value.levels, left_out)

    def answered(batches: Iterator[pa.RecordBatch], left_out: bool):
        """The same, with the shards' answers."""
        m = model()
        for b in batches:
            for ids, n, k, place, answers in zip(*b.columns, strict=True):
                ids, answers = ids.as_py(), sorted(answers.as_py(), key=lambda x: (x["kind"], x["shard"]))
                n, k, place = (np.frombuffer(x.as_buffer(), t) for x, t in ((n, np.int64), (k, U), (place, np.int32)))
                one, of_pairs = (np.frombuffer(b"".join(x["levels"] for x in answers if x["kind"] == i), np.uint8).astype(np.int64) for i in (1, 2))
                levels = np.empty(len(k), np.int64)
                levels[np.argsort(k)] = one
                own = np.repeat([not held_out(x) for x in ids], n) if left_out else slice(None)
                yield ids, n, k, place, own, m.read(k, place, levels, lambda p, most, q=of_pairs: np.minimum(q[np.unique(p, return_inverse=True)[1]], most), left_out)

    reads = probed if small else answered

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((LEVELS + 1) * _BINS, np.int64)
        for _, _, _, _, own, (before, pair, one, _) in reads(batches, True):
            x = pair[own] / one[own]
            some = x > 0
            bins = np.zeros(len(x), np.int64)
            bins[some] = np.clip((np.log2(x[some]) - _LOWEST) * _FINE + 1, 1, _BINS - 1).astype(np.int64)
            sums += np.bincount(before[own] * _BINS + bins, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bin", "n"])

    weights = np.zeros(LEVELS + 1)
    if total:
        n = np.zeros((LEVELS + 1) * _BINS)
        with small_batches(spark):
            binned = source.mapInArrow(fit, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # at most LEVELS * _BINS rows
        for r in binned:
            n[r.bin] = r.n
        x = np.concatenate([[0.0], 2.0 ** ((np.arange(1, _BINS) - 0.5) / _FINE + _LOWEST)])
        gain = np.log(1 - GRID + np.outer(x, GRID))  # of each bin and weight, over the word alone
        weights = GRID[(n.reshape(LEVELS + 1, _BINS) @ gain).argmax(axis=1)]

    key_type = docs.schema["key"]
    schema = T.StructType([key_type]).add("rid", "long").add("held_out", "boolean").add("n_tokens", "long").add("known", "long").add("base", "double").add("rare", T.ArrayType(T.LongType())).add("score", "double")
    arrow_key = to_arrow_type(key_type.dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i = TaskContext.get().partitionId() << 40, 0
        top, logs = shared.value["top"], shared.value["logs"]
        for ids, n, kinds_, where, _, (before, pair, one, level) in reads(batches, False):
            first_of = np.cumsum(n) - n
            w = weights[before]
            scores = np.add.reduceat(np.log10(w * pair + (1 - w) * one), first_of)
            rid = pa.array(range(part | i, (part | i) + len(n)), pa.int64())
            i += len(n)
            place = np.minimum(np.searchsorted(top, kinds_), max(0, len(top) - 1))
            known_kind = top[place] == kinds_ if len(top) else np.zeros(len(kinds_), bool)
            there = known_kind[where]
            base = np.add.reduceat(np.where(known_kind, logs[place] if len(top) else 0, 0)[where], first_of)
            known = np.add.reduceat(there.astype(np.int64), first_of)
            asked = ~there & (level > 0)  # what the filter lacks was never counted
            n_rare = np.add.reduceat(asked.astype(np.int64), first_of)
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), pa.array(kinds_[where[asked]].view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow_key), rid, pa.array([held_out(d) for d in ids], pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), rare, pa.array(scores, pa.float64())], names=schema.names)

    rows = written(source.mapInArrow(score, schema), "lm-scores")
    for b in (shared, two):  # all that needs them is written
        if b is not None:
            b.destroy()
    if not small:
        drop(source)
    rare = rows.select("rid", F.explode("rare").alias("hash"))
    counts = counted.filter("kind = 0").select(F.inline(F.arrays_zip("hashes", "counts"))).filter(F.col("counts") < least)
    norm = total + 0.5 * (kinds + 1)
    parts = rare.join(counts, rare.hash == counts.hashes).groupBy("rid").agg(F.count("*").alias("seen"), F.sum(F.log10((F.col("counts") + 0.5) / norm)).alias("more"))
    seen = F.coalesce("seen", F.lit(0))
    return rows.join(parts, "rid", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + seen).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + (F.col("n_tokens") - F.col("known") - seen) * F.lit(float(np.log10(0.5 / norm)))).alias("base_score"), "score", (F.col("score") / F.col("n_tokens")).alias("score_per_token"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
