"""Packing: concatenate all token streams and cut them into fixed windows.

Pass 1 encodes every text, writes the ids with each document's place in its
partition to the shared folder, and sums the tokens of each partition. Prefix
sums over the partitions' totals (one number a partition) give global offsets.
Pass 2 reads the table and cuts at multiples of the window; a document that
crosses one leaves a boundary record, a piece, in each window that it touches.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Bounded, ship, table, worker_cache, written
from quillon.llm.token_counts import vocabulary_path

VOCABULARY, WINDOW, END = "byte_bpe_50k", 2048, 1

#: White space that reaches over a cut before a single blank, where words don't encode alone; and what Python takes as white space and the library doesn't.
_RUN = re.compile(r"\s (?:\s|\Z)|[\x1c-\x1f]")


class Encoder:
    """Ids of whole texts, two bytes an id, as tokenizers gives them without special tokens of its own.

    No rule of the vocabulary's pattern looks over the cut before a single
    blank, so that a text's ids are those of its blank-separated chunks, which
    a bounded cache keeps. Texts with other runs of white space, or with the
    special token's string, are encoded whole.
    """

    def __init__(self, name: str = VOCABULARY, folder: str | None = None, limit: int = 400_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(f"{name}.json", folder))
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in two bytes")
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        with open(vocabulary_path(f"{name}.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chunks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ordinary = lambda s: np.array(chunks.encode_ordinary(s), np.uint16).tobytes()
        self.cache = Bounded(lambda s: self.ordinary(" " + s), limit)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if _RUN.search(text):
            return self.whole(text) if re.search("[\x1c-\x1f]", text) else self.ordinary(text)
        first, *rest = text.split(" ")
        return self.ordinary(first) + b"".join(map(self.cache.__getitem__, rest))


_PASS_1 = pa.schema([("part", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, *, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, folder: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids (little-endian, 4 bytes).

    Each document's ids are its text's, then ``end``; a null text counts as
    empty and is the end id alone. Every id lies in one piece; sequences fill
    without gaps and only the last may be short. Null keys and repeated rows are
    documents like others; other columns aren't read. An empty table gives no
    pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key]
    empty = spark.createDataFrame([], "a long").schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"encoder {vocabulary} {folder}", lambda: Encoder(vocabulary, folder))
        part, before, last = TaskContext.get().partitionId(), 0, np.array([end], np.uint16).tobytes()
        for b in batches:
            ids = [encoder(t or "") + last for t in b.column(1).to_pylist()]
            n = [len(x) // 2 for x in ids]
            at = before + np.cumsum([0, *n])
            before = int(at[-1])
            for i in range(0, len(n), 512):
                j = slice(i, i + 512)
                yield pa.RecordBatch.from_arrays([b.column(0)[j], *(pa.array(x, t.type) for x, t in zip(([part] * len(n[j]), at[:-1][j], n[j], ids[j]), _PASS_1, strict=True))], names=[key, *_PASS_1.names])

    schema = type(empty)([kind]).add("part", "long").add("before", "long").add("n", "long").add("ids", "binary")
    first = written(docs.select(key, text).mapInArrow(encode, schema), "tokens")
    totals = dict(first.groupBy("part").agg(F.sum("n")).collect())  # one number a partition
    parts = sorted(totals)
    offsets = spark.sparkContext.broadcast(dict(zip(parts, np.cumsum([0, *(totals[p] for p in parts)])[:-1].tolist(), strict=True)))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = type(empty)([kind])
    for n in names:
        out = out.add(n, "long")
    if with_ids:
        out = out.add("ids", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, rows, ids_out = [], [], []
            for i, (part, before, n, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                at = offsets.value[part] + before
                wide = memoryview(np.frombuffer(ids, np.uint16).astype("<u4").tobytes())
                start = 0
                while start < n:
                    seq, off = divmod(at + start, window)
                    length = min(window - off, n - start)
                    piece = wide[4 * start : 4 * (start + length)]
                    doc.append(i)
                    rows.append((start, length, zlib.crc32(piece), n, seq, off))
                    if with_ids:
                        ids_out.append(bytes(piece))
                    start += length
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *columns, *[pa.array(ids_out, pa.binary())] * with_ids], names=[key, *names, *["ids"] * with_ids])

    return first.mapInArrow(cut, out)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
