"""Token counts of texts by a map-side two-tier lookup.

Tier 1 is a compact table from frequent pre-tokens to their lengths, broadcast
to the workers: the vocabulary's own whole words, which are the pre-tokens that
were frequent enough for BPE to give them a merge. Its size is bounded by the
vocabulary. Tier 2 is a cache in each Python worker, bounded, which encodes what
tier 1 lacks. Nothing is shuffled.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import Bounded, per_row, table, worker_cache

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Characters that Python's str.split() takes as white space and the library doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def vocabulary_path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def frequent_lengths(path: str) -> dict[str, int]:
    """Whole words of the vocabulary and their token counts, as the library gives them."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(path)
    words = sorted(w[:-4] for w in t.get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha())
    return {w: len(e.ids) for w, e in zip(words, t.encode_batch_fast(words, add_special_tokens=False), strict=True)}


class Counter:
    """Counts tokens of a text as Tokenizer.encode(text, add_special_tokens=False) does.

    The library drops white space, and no rule looks over it, so that a text's
    count is the sum of its words' counts.
    """

    def __init__(self, path: str, frequent: dict[str, int], limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.normal, self.pieces, self.model = self.t.normalizer.normalize_str, self.t.pre_tokenizer.pre_tokenize_str, self.t.model
        self.piece = Bounded(lambda p: len(self.model.tokenize(p)), limit)
        self.miss = Bounded(self.word, limit)
        self.frequent = frequent

    def word(self, w: str) -> int:
        n = self.frequent.get(w)
        return sum(self.piece[p] for p, _ in self.pieces(self.normal(w))) if n is None else n

    def whole(self, text: str) -> int:
        return len(self.t.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> int:
        if ODD_SPACE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        get, miss = self.frequent.get, self.miss
        n = 0
        for w in text.split():
            k = get(w)
            n += miss[w] if k is None else k
        return n


def count_tokens(docs: DataFrame, *, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, folder: str | None = None, limit: int = LIMIT, cache: int = 500_000) -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); an empty table gives no
    rows; repeated rows and null keys are kept as they are; other columns are
    not read, so their names can't clash. A text is never cut.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(vocabulary_path(vocabulary, folder)))

    def make():
        count = worker_cache(f"count {vocabulary} {folder} {cache}", lambda: Counter(vocabulary_path(vocabulary, folder), frequent.value, cache))

        def f(ids, texts):
            texts = [t or "" for t in texts]
            n = [count(t) for t in texts]
            return ids, [len(t.encode()) for t in texts], n, [x > limit for x in n]

        return f

    kind = dict(docs.dtypes)[key].replace("bigint", "long")
    return per_row(docs, [key, text], make, f"{key} {kind},n_bytes long,n_tokens long,over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
