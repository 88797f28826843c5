"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two token streams of the same bytes are read as one: the state is which side
leads and the bytes by which it does; the next token comes from the other side
(from A, if none leads). A transition depends on the residual and that token
only, so it is memoised. An empty residual closes a group.

1. A pass over the texts encodes and aligns them and writes, a row a document,
   the figures of its groups and its linked id pairs with their multiplicities.
   Words are encoded and aligned once a cache, as no rule of either vocabulary
   looks over a cut before a single blank, where the residual is empty.
2. The pairs' document counts are summed in each task and then by pair. Up to
   MOST_PAIRS of them are broadcast, more are joined by a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import Bounded, drop, ship, table, worker_cache, written
from quillon.llm.token_counts import vocabulary_path

A, B = "byte_bpe_50k", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast, 12 bytes each.
MOST_PAIRS = 4_000_000
#: Longer words aren't cached; larger groups' pairs are counted by id.
LONG, LARGE = 64, 256
_BYTE = re.compile("<0x([0-9A-F]{2})>")
#: White space over whose cuts A's rules look, and what the libraries take for white space differently.
_ODD = re.compile(r"\s (?:\s|\Z)|[\x1c-\x1f]")


class Transducer:
    """Groups of two id sequences over the bytes that their tokens stand for.

    States are numbered; state 0 is the empty residual, an odd one says that B
    leads, an even one that A does.
    """

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes], limit: int = 1_000_000):
        self.of = (bytes_a, bytes_b)
        at = {x: i for i, x in enumerate(bytes_b)}
        #: For each id of A the id of B with the same bytes, whose two transitions lead from the empty residual back to it.
        self.twin = [at.get(x, -1) if x else -1 for x in bytes_a]
        self.clear()
        self.limit = limit

    def clear(self) -> None:
        self.residuals, self.number, self.memo = [b"", b""], {(0, b""): 0}, {}

    def _state(self, lead: int, residual: bytes) -> int:
        if not residual:
            return 0
        k = self.number.get((lead, residual))
        if k is None:
            k = self.number[lead, residual] = len(self.residuals) + lead
            self.residuals += [residual, residual]
        return k

    def step(self, state: int, token: int) -> int:
        """The state after the next token of the side that doesn't lead; -1 if their bytes differ."""
        lead, residual = state & 1, self.residuals[state]
        x = self.of[0 if not state else 1 - lead][token]
        if not state:
            return self._state(0, x)
        if residual.startswith(x):
            return self._state(lead, residual[len(x) :])
        return self._state(1 - lead, x[len(residual) :]) if x.startswith(residual) else -1

    def __call__(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The groups, in order; None if the two don't stand for the same bytes."""
        if len(self.memo) > self.limit:
            self.clear()
        memo, twin, state, i, j, i0, j0, out = self.memo, self.twin, 0, 0, 0, 0, 0, []
        n, m = len(a), len(b)
        while i < n or j < m:
            if state and not state & 1:
                if j == m:
                    return None
                token = b[j]
                j += 1
            else:
                if i == n:
                    return None
                token = a[i]
                i += 1
                if not state and j < m and b[j] == twin[token]:
                    j += 1
                    out.append((a[i0:i], b[j0:j]))
                    i0, j0 = i, j
                    continue
            k = state << 32 | token
            to = memo.get(k)
            if to is None:
                to = memo[k] = self.step(state, token)
            if to <= 0:
                if to:
                    return None
                out.append((a[i0:i], b[j0:j]))
                i0, j0 = i, j
            state = to
        return None if state else out


def token_bytes_a(vocab: dict[str, int]) -> list[bytes]:
    """Bytes of a byte-level vocabulary's tokens, by id."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    alphabet = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*plain}))}
    out = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
    return out


def token_bytes_b(pieces: list[str]) -> list[bytes]:
    """Bytes of a sentencepiece vocabulary's pieces, by id."""
    return [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]


#: Of a word or text: tokens of A and B, groups, links, the groups' text, codes of the links, codes and multiplicities of large groups' links.
Aligned = tuple[int, int, int, int, str, bytes, tuple]


class Aligner:
    def __init__(self, a: str = A, b: str = B, folder: str | None = None, limit: int = 300_000):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(f"{a}.json", folder))
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(vocabulary_path(f"{a}.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.ordinary = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(b, folder))
        vocab = self.library.get_vocab()
        if max(vocab.values()) >= 1 << 16 or len(self.sp) > 1 << 16:
            raise ValueError("a pair of ids is kept in four bytes")
        self.groups = Transducer(token_bytes_a(vocab), token_bytes_b([self.sp.id_to_piece(i) for i in range(len(self.sp))]))
        self.said = [f"{i}|" for i in range(max(vocab.values()) + 1)], [str(i) for i in range(len(self.sp))]
        self.words = Bounded(lambda w: self.encoded([w])[0], limit)

    def encoded(self, words: list[str]) -> list[Aligned | None]:
        ordinary, aligned = self.ordinary, self.aligned
        return [aligned(ordinary(" " + w), b) for w, b in zip(words, self.sp.encode(words, num_threads=1), strict=True)]

    def aligned(self, a: list[int], b: list[int]) -> Aligned | None:
        groups = self.groups(a, b)
        if groups is None:
            return None
        links, codes, large, said = 0, [], [], []
        first, second = self.said
        for x, y in groups:
            if len(x) == 1 == len(y):
                links += 1
                codes.append(x[0] << 16 | y[0])
                said.append(first[x[0]] + second[y[0]])
                continue
            n = len(x) * len(y)
            links += n
            if n <= LARGE:
                codes += [i << 16 | j for i in x for j in y]
            else:
                (p, k), (q, m) = (np.unique(np.array(z, np.uint32), return_counts=True) for z in (x, y))
                large.append(((p[:, None] << 16 | q).ravel(), (k[:, None] * m).ravel()))
            said.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
        return len(a), len(b), len(groups), links, ";".join(said), array("I", codes).tobytes(), tuple(large)

    def whole(self, text: str) -> Aligned | None:
        a = self.library.encode(" " + text, add_special_tokens=False).ids if re.search("[\x1c-\x1f]", text) else self.ordinary(" " + text)
        return self.aligned(a, self.sp.encode(text, num_threads=1))

    def split(self, text: str) -> list[str] | None:
        """Words that encode alone; None if there is other white space between them than single blanks."""
        words = text.split(" ")
        return None if "" in words or _ODD.search(text) else words

    def many(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, bytes, bytes]]:
        """document() of each text; their words are encoded in one go."""
        split = [*map(self.split, texts)]
        self.words.fill((w for words in split for w in words or () if len(w) <= LONG), self.encoded)
        return map(self.document, texts, split)

    def document(self, text: str, words: list[str] | None) -> tuple[int, int, int, int, str, bytes, bytes]:
        """Tokens of A and B, groups, links, hash of the groups' text, distinct codes of the links and their multiplicities."""
        none = (0, 0, 0, 0, "", b"", b"")
        if not text:
            return none
        parts = [self.whole(text)] if words is None else [self.words[w] if len(w) <= LONG else self.encoded([w])[0] for w in words]
        if None in parts:
            return none
        n_a, n_b, groups, links, said, codes, large = zip(*parts, strict=True)
        kinds, k = np.unique(np.frombuffer(b"".join(codes), np.uint32), return_counts=True)
        if extra := [x for part in large for x in part]:
            kinds, at = np.unique(np.concatenate([kinds, *(x[0] for x in extra)]), return_inverse=True)
            counts = np.zeros(len(kinds), np.int64)
            np.add.at(counts, at, np.concatenate([k, *(x[1] for x in extra)]))
            k = counts
        return sum(n_a), sum(n_b), sum(groups), sum(links), hashlib.sha256(";".join(said).encode()).hexdigest(), kinds.tobytes(), k.astype(np.int64).tobytes()


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
_CODES = pa.schema([("code", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (codes): each code's number of rows, summed over about a million at a time."""
    codes, counts = np.array([], np.uint32), np.array([], np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], schema=_CODES)

    for b in batches:
        new, n = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32), return_counts=True)
        both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
        sums = np.zeros(len(both), np.int64)
        np.add.at(sums, at, np.concatenate([counts, n]))
        codes, counts = both, sums
        if len(codes) > 1_000_000:
            yield out()
            codes, counts = codes[:0], counts[:0]
    yield out()


def align(docs: DataFrame, *, text: str = "text", key: str = "doc_id", a: str = A, b: str = B, folder: str | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens are those of a blank and the text, special strings being plain text.
    A null or empty text, or one that either side's tokens don't spell, has no
    tokens: all figures are 0 and the hash is ''. Repeated rows and null keys
    are documents like others; other columns aren't read; an empty table gives
    no rows. Texts are aligned whole.
    """
    spark = docs.sparkSession
    ship(spark)
    kind, long = docs.schema[key], "long"
    schema = type(docs.schema)([kind])
    for n in _FIGURES:
        schema = schema.add(n, long)
    schema = schema.add("groups_sha256", "string").add("codes", "binary").add("times", "binary").add("row", long)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_cache(f"aligner {a} {b} {folder}", lambda: Aligner(a, b, folder))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), 64):  # a few texts' words at a time
                part = batch.slice(at, 64)
                texts = part.column(1).fill_null("").to_pylist()
                made = zip(*aligner.many(texts), strict=True)
                types = [*[pa.int64()] * len(_FIGURES), pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(made, types, strict=True)), pa.array(np.arange(row, row + len(part)))], names=schema.names)
                row += len(part)

    linked = written(docs.select(key, text).mapInArrow(encode, schema), "aligned")
    counts = written(linked.filter("n_links > 0").select("codes").mapInArrow(_counted, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs")), "pair_counts")
    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() <= most:
        t = counts.orderBy("code").toArrow()
        codes, n = t["code"].to_numpy().astype(np.uint32), t["docs"].to_numpy()
        starts = np.flatnonzero(np.diff(codes >> 16, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(n, starts), np.diff(starts, append=len(codes))) if len(codes) else n
        shared = spark.sparkContext.broadcast((codes, n, n == highest))
        drop(counts)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, n, best = shared.value
            for batch in batches:
                sums = []
                for c, k in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True):
                    at, k = np.searchsorted(codes, np.frombuffer(c, np.uint32)), np.frombuffer(k, np.int64)
                    sums.append((int(k[best[at]].sum()), int((k * n[at]).sum())))
                x, y = zip(*sums, strict=True) if sums else ([], [])
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(x, pa.int64()), pa.array(y, pa.int64()), batch.column("groups_sha256")], names=names)

        out = type(schema)([kind])
        for c in names[1:-1]:
            out = out.add(c, long)
        return linked.select(key, *_FIGURES, "groups_sha256", "codes", "times").mapInArrow(look_up, out.add("groups_sha256", "string"))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, c, k in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                c = np.frombuffer(c, np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), row)), pa.array(c.astype(np.int64)), pa.array(np.frombuffer(k, np.int64))], names=["row", "code", "times"])

    best = F.col("docs") == F.max("docs").over(Window.partitionBy(F.shiftright("code", 16)))
    each = linked.filter("n_links > 0").select("row", "codes", "times").mapInArrow(apart, "row long, code long, times long").join(counts.withColumn("best", best), "code")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return linked.drop("codes", "times").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(*names)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
