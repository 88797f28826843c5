"""Chat formatting with DataFrame expressions only.

A conversation becomes ``<|turn|>role<|text|>text<|end|>`` for each run of turns
of one role; further texts of a run follow ``<|part|>``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so that markers can't be forged
and everything can be read back. The turns of a conversation are collected once
as structs, sorted, cut into runs of one role, and joined, all inside the array.
``loss`` lists the stretches (start, length, in
code points) of the formatted string that hold a text of the trained role.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import table

TURN, TEXT, PART, END = "<|turn|>", "<|text|>", "<|part|>", "<|end|>"
TRAINED = "assistant"
#: Places of an array whose prefix sums are made in one fold.
BLOCK = 256


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of ``c``, which is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def prefix_sums(c: Column) -> Column:
    """The sum of an array of longs up to each place: blocks' totals are summed first, so that no long array is copied at each step."""
    grown = lambda xs, first: F.aggregate(xs, F.struct(F.array().cast("array<long>").alias("a"), first.cast("long").alias("s")), lambda t, x: F.struct(F.concat(t["a"], F.array(t["s"] + x)).alias("a"), (t["s"] + x).alias("s")), lambda t: t["a"])
    starts = F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.slice(c, i, BLOCK))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda t, x: t + x)
    return bound(blocks, lambda b: bound(grown(F.transform(b, total), F.lit(0)), lambda past: F.flatten(F.transform(b, lambda xs, k: grown(xs, F.when(k > 0, F.get(past, k - 1)).otherwise(F.lit(0)))))))


def format_chats(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED) -> DataFrame:
    """One row a conversation: its id, ``formatted`` and ``loss``.

    Turns are ordered by number, then role, then text (a null number comes
    first); repeated rows are turns of their own. A null text or role is empty;
    rows whose conversation is null form one conversation. An empty table gives
    no rows; other columns aren't read. A conversation is one row, and its time
    is in proportion to its length.
    """
    rows = turns.select(F.col(conversation).alias("c"), F.struct(F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x")).alias("turn"))
    collected = rows.groupBy("c").agg(F.collect_list("turn").alias("turns"))

    def runs(s: Column) -> Column:
        """The sorted turns' runs of one role: (role, pieces)."""
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["r"] != x["r"]), i + 1)), lambda i: i.isNotNull())
        return bound(heads, lambda h: F.transform(h, lambda i, k: F.struct(F.get(s, i - 1)["r"].alias("role"), F.transform(F.slice(s, i, F.coalesce(F.get(h, k + 1), F.size(s) + 1) - i), lambda x: escape(x["x"])).alias("texts"))))

    head = lambda r: F.concat(F.lit(TURN), escape(r["role"]), F.lit(TEXT))
    merged = collected.select("c", bound(F.array_sort("turns"), runs).alias("runs"))
    # what stands between the texts, and the texts, in turn
    skipped = F.flatten(F.transform("runs", lambda r, k: F.transform(r["texts"], lambda x, j: F.when(j > 0, F.lit(len(PART))).otherwise(F.length(head(r)) + F.when(k > 0, F.lit(len(END))).otherwise(F.lit(0))).cast("long"))))
    lengths = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda x: F.length(x).cast("long"))))
    on = F.flatten(F.transform("runs", lambda r: F.transform(r["texts"], lambda x: r["role"] == trained)))
    formatted = F.array_join(F.transform("runs", lambda r: F.concat(head(r), F.array_join(r["texts"], PART), F.lit(END))), "")
    placed = merged.select("c", formatted.alias("formatted"), skipped.alias("skipped"), lengths.alias("n"), on.alias("on"))
    placed = placed.select("c", "formatted", prefix_sums(F.zip_with("skipped", "n", lambda a, b: a + b)).alias("ends"), "n", "on")
    loss = F.filter(F.transform(F.arrays_zip("ends", "n", "on"), lambda z: F.struct((z["ends"] - z["n"]).alias("start"), z["n"].alias("length"), z["on"].alias("on"))), lambda z: z["on"])
    return placed.select(F.col("c").alias(conversation), "formatted", F.transform(loss, lambda z: F.struct(z["start"].alias("start"), z["length"].alias("length"))).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted string: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    sides = F.transform(blocks, lambda b: F.split(F.replace(b, F.lit(TURN), F.lit("")), r"<\|text\|>"))
    return F.flatten(F.transform(sides, lambda s: F.transform(F.split(s[1], r"<\|part\|>"), lambda x: F.struct(unescape(s[0]).alias("role"), unescape(x).alias("text")))))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    out = out.select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("lost"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE 8 + role_chars + 8 + 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
