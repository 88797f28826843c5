"""Quality rules: plain text counts, and the fertility of a public tokeniser.

A text's words are encoded with a public vocabulary that falls back to bytes.
Characters per token, the share of byte tokens and the entropy of the tokens
must lie in a band that depends on the text's script, or its language where a
column says it and a band is known. The least entropy rises with the number of
tokens, of which few can't have much: it is a line through points of (log2 of
tokens, bits). fit_bands() sets bands from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Bounded, fresh, per_row, ship, table, worker_cache
from quillon.llm.token_counts import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS, MAX_REPEAT = 50, 50
#: Ids of the vocabulary's byte tokens.
BYTES = (3, 259)
SYMBOLS = re.compile(r"[#*$%&|<>]+")
#: Least and most characters per token, most byte share, and the points of the least entropy, which starts at none.
Band = tuple[float, float, float, tuple[tuple[float, float], ...]]
NOTHING = (0.0, 0.0)
LATIN_FIT: Band = (1.794, 2.45, 0.1, (NOTHING, (7.56, 5.792), (8.57, 6.13), (9.47, 6.26), (10.45, 6.451), (11.43, 6.565)))
#: By script. That of Latin is fit_bands() of the sf0.1 documents with an even doc_id (LATIN_FIT); the others only turn away what is far off.
BANDS: dict[str, Band] = {
    "latin": LATIN_FIT,
    "cyrillic": (0.8, 6.0, 0.20, (NOTHING, (8.0, 3.0))),
    "greek": (0.5, 4.0, 0.60, (NOTHING, (8.0, 2.5))),
    "arabic": (0.4, 4.0, 0.60, (NOTHING, (8.0, 2.5))),
    "hebrew": (0.4, 4.0, 0.60, (NOTHING, (8.0, 2.5))),
    "devanagari": (0.4, 4.0, 0.70, (NOTHING, (8.0, 2.5))),
    "han": (0.3, 3.0, 0.90, (NOTHING, (8.0, 2.5))),
    "other": (0.2, 8.0, 1.00, (NOTHING, (8.0, 2.0))),
}
#: fit_bands(): labelled documents used, shares of good ones below a bound (characters per token, entropy), documents a point, slack on characters and byte share.
SAMPLE, OUTSIDE, A_POINT, SLACK = 20_000, (0.002, 0.003), 100, (0.01, 0.03, 0.10)
#: First code points of the stretches that belong to a script, "" to none.
STRETCHES = {0: "", 0x41: "latin", 0x5B: "", 0x61: "latin", 0x7B: "", 0xC0: "latin", 0x250: "", 0x370: "greek", 0x400: "cyrillic", 0x530: "", 0x590: "hebrew", 0x600: "arabic", 0x700: "", 0x900: "devanagari", 0x980: "", 0x3040: "han", 0xA000: ""}
_STARTS, _SCRIPTS = np.array(list(STRETCHES), np.uint32), [*dict.fromkeys(x for x in STRETCHES.values() if x)]
_SCRIPT_OF = np.array([_SCRIPTS.index(x) if x else len(_SCRIPTS) for x in STRETCHES.values()])


def script(text: str) -> str:
    """The script of most letters; ``other`` without letters."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_SCRIPT_OF[np.searchsorted(_STARTS, points, "right") - 1], minlength=len(_SCRIPTS) + 1)[:-1]
    return _SCRIPTS[int(n.argmax())] if n.any() else "other"


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(len, SYMBOLS.findall(text)))
    lines = text.split("\n")
    dups = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen: set[str] = set()
        for x in lines:
            if x in seen:
                dups += bool(x.encode().split())
            seen.add(x)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            once: dict = {}
            for w in windows:
                once[w] = w in once
            end = 0
            for i, w in enumerate(windows):
                if once[w]:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return n, chars, symbols, dups, repeated


class Fertility:
    """Characters per token, byte share and token entropy of the words of a text."""

    def __init__(self, path: str, limit: int = 250_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids = Bounded(lambda w: self.encode([w])[0], limit)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, two bytes an id."""
        return [np.array(x, np.uint16).tobytes() for x in self.sp.encode([w.decode() for w in words], num_threads=1)]

    def __call__(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        ids = np.frombuffer(b"".join(map(self.ids.__getitem__, words)), np.uint16)
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0
        k = np.bincount(ids)
        byte = int(k[BYTES[0] : BYTES[1]].sum())
        k = k[k > 0]
        return n, chars / n, byte / n, max(0.0, math.log2(n) - float((k * np.log2(k)).sum()) / n)


def verdict(tokens: int, per_token: float, byte: float, entropy: float, band: tuple) -> bool:
    low, high, most, points = band
    return tokens > 0 and low <= per_token <= high and byte <= most and entropy >= np.interp(math.log2(tokens), *zip(*points, strict=True))


def _judge(vocabulary: str, folder: str | None, bands: dict):
    fertility = worker_cache(f"fertility {vocabulary} {folder}", lambda: Fertility(vocabulary_path(vocabulary, folder)))

    def judge(texts: list[str | None], langs: list[str | None]) -> list[tuple]:
        rows = []
        for at in range(0, len(texts), 64):  # a few texts' words at a time
            part = [t or "" for t in texts[at : at + 64]]
            split = [t.encode().split() for t in part]  # of bytes: white space is x20 and x09-x0d only
            fertility.ids.fill(chain.from_iterable(split), fertility.encode)
            for text, words, lang in zip(part, split, langs[at : at + 64], strict=True):
                base = base_counts(text, words)
                n, chars, _, _, repeated = base
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT * n
                measured = fertility(words, chars)
                rows.append((*base, failed, not failed and verdict(*measured, bands.get(lang) or bands[script(text)]), *measured))
        return rows

    return judge


def quality_rules(docs: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str | None = None, vocabulary: str = VOCABULARY, folder: str | None = None, bands: dict = BANDS) -> DataFrame:
    """Per row: key, the base counts, base_failed, kept, and the method's measures.

    A null or empty text has no words: base_failed, not kept. Repeated rows and
    null keys stay. Very long texts are measured whole. ``bands`` may hold
    languages of a column ``lang``, which then go before the script's band.
    """

    def make():
        judge = _judge(vocabulary, folder, bands)
        n = 11

        def f(ids, texts, langs=None):
            rows = judge(texts, langs or [None] * len(texts))
            return [ids, *([list(x) for x in zip(*rows, strict=True)] or [[]] * n)]

        return f

    have = lang is not None and lang in docs.columns
    kind = dict(docs.dtypes)[key].replace("bigint", "long")
    return per_row(docs, [key, text, *[lang] * have], make, f"{key} {kind},n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean,kept boolean,n_tokens long,chars_per_token double,byte_share double,token_entropy double")


def band_of(tokens: np.ndarray, per_token: np.ndarray, byte: np.ndarray, entropy: np.ndarray) -> Band:
    """The band of good documents' measures.

    The entropy's trend is a parabola over log2 of the tokens; below it, a point
    for each doubling of the tokens lies where the share OUTSIDE of the documents there
    is lower. Doublings with fewer than A_POINT documents join the next one.
    """
    x = np.log2(tokens)
    trend = np.polyval(np.polyfit(x, entropy, min(2, len(np.unique(x)) - 1)), x)
    points, low = [NOTHING], math.floor(x.min())
    for high in range(low + 1, math.floor(x.max()) + 2):
        inside = (x >= low) & (x < high)
        if inside.sum() >= A_POINT:
            middle = float(np.median(x[inside]))
            near = inside & (np.abs(x - middle) <= np.quantile(np.abs(x[inside] - middle), 0.1))
            points.append((round(middle, 2), round(float(trend[near].mean() + np.quantile((entropy - trend)[inside], OUTSIDE[1])), 3)))
            low = high
    below, above, share = SLACK
    return round(float(np.quantile(per_token, OUTSIDE[0])) * (1 - below), 3), round(float(np.quantile(per_token, 1 - OUTSIDE[0])) * (1 + above), 3), round(float(np.quantile(byte, 1 - OUTSIDE[0])) + share, 3), tuple(points)


def fit_bands(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", quality: str = "quality", lang: str | None = None, sample: int = SAMPLE, vocabulary: str = VOCABULARY, folder: str | None = None, bands: dict[str, Band] = BANDS) -> dict[str, Band]:
    """``bands`` with those of the scripts, and of the languages of ``lang``, that A_POINT good documents or more have.

    Good are documents whose label in ``quality`` is 1 and which pass the base
    rules. At most ``sample`` labelled ones, those with the least hashes of
    their keys, are measured; their measures, a few numbers each, come to the driver.
    """
    good = labels.filter(F.col(quality) == 1).select(F.col(key).alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(sample)
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang")).join(F.broadcast(good), "k", "left_semi")

    def make():
        judge = _judge(vocabulary, folder, bands)

        def f(texts, langs):
            rows = [(*r[5:6], *r[7:], script(t or ""), g) for r, t, g in zip(judge(texts, langs), texts, langs, strict=True)]
            return [list(x) for x in zip(*rows, strict=True)] or [[]] * 7

        return f

    measured = per_row(some, ["text", "lang"], make, "failed boolean,n long,per_token double,byte double,entropy double,script string,lang string").filter("NOT failed AND n > 0").toPandas()
    out = dict(bands)
    for by in ("script", "lang"):
        for name, m in measured.groupby(by):
            if len(m) >= A_POINT:
                out[name] = band_of(*(m[c].to_numpy(float) for c in ("n", "per_token", "byte", "entropy")))
    return out


def keep_good(docs: DataFrame, *, text: str = "text", lang: str | None = None, vocabulary: str = VOCABULARY, folder: str | None = None, bands: dict = BANDS) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with all their columns; judged in the same pass that reads them."""
    ship(docs.sparkSession)
    mark = fresh(docs, "kept")
    have = lang is not None and lang in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(vocabulary, folder, bands)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):  # few texts at a time as Python's strings
                b = whole.slice(i, 256)
                texts = b.column(b.schema.get_field_index(text)).to_pylist()
                langs = b.column(b.schema.get_field_index(lang)).to_pylist() if have else [None] * len(texts)
                yield b.append_column(mark, pa.array([r[6] for r in judge(texts, langs)], pa.bool_()))

    schema = docs.sparkSession.createDataFrame([], docs.schema).schema
    return docs.mapInArrow(run, schema.add(mark, "boolean")).filter(f"`{mark}`").drop(mark)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
