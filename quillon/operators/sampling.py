"""Picks whose order matters, made exactly over bounded candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.relational import first_of, topk

TOTAL = 40


def pick_unique(rows: DataFrame, *, key: str, category: str, reference: str, order: list[str], total: int = TOTAL) -> DataFrame:
    """Rows of (place, key, category, reference): ``total`` rows, a category's turn after the other's, references not used before first.

    Categories take turns as they first appear in ``order``. On its turn a
    category gives its first row whose reference isn't used yet, or else its first row
    that is left; rows without a category fill up what is missing at the end.
    A null reference is one like others. ``key`` tells rows apart.

    Each choice depends on those before, so it is made in one loop, over rows
    that suffice whatever is chosen: as every category has a row, only the first
    ``total`` categories get a turn; as at most ``total`` rows and references are
    used, a category needs the first rows of its first total + 1 references and
    its first total + 1 rows. That is total * 2 * (total + 1) rows at most.
    """
    r = rows.select(F.col(key).alias("key"), F.col(category).alias("category"), F.coalesce(F.col(reference).cast("string"), F.lit("nan")).alias("reference"), F.struct(*order).alias("o"))
    has = r.filter(F.col("category").isNotNull())
    first = has.groupBy("category").agg(F.min("o").alias("f")).orderBy("f", "category").limit(total).select("category", "f")
    mine = has.join(F.broadcast(first), "category").drop("f")  # ``total`` rows
    by_reference = topk(first_of(mine, ["category", "reference"], ["o", "key"]), ["category"], ["o", "key"], total + 1)
    by_place = topk(mine, ["category"], ["o", "key"], total + 1)
    rest = r.filter(F.col("category").isNull()).orderBy("o", "key").limit(total)
    some = sorted({(tuple(x.o), x.key, x.category, x.reference) for x in by_reference.unionByName(by_place).unionByName(rest).collect()}, key=lambda x: x[:2])
    turns = [x.category for x in first.orderBy("f", "category").collect()]
    of: dict = {}
    for x in some:
        of.setdefault(x[2], []).append(x)
    used, names, out = set(), set(), []
    while len(out) < total:
        before = len(out)
        for c in turns:
            left = [x for x in of.get(c, []) if x[1] not in used]
            pick = next((x for x in left if x[3] not in names), left[0] if left else None)
            if pick is not None and len(out) < total:
                out.append(pick)
                used.add(pick[1])
                names.add(pick[3])
        if len(out) == before:
            break
    out += of.get(None, [])[: total - len(out)]
    kinds = dict(r.dtypes)
    return rows.sparkSession.createDataFrame([(i + 1, x[1], x[2], x[3]) for i, x in enumerate(out)], f"place int, {key} {kinds['key']}, {category} {kinds['category']}, {reference} string")


def examples(scored: DataFrame, by: str, key: str, score: Column, confidence: Column, correct: Column, n: int = 5, most: int = 10) -> DataFrame:
    """Rows of (by, key, side, place): each group's best and worst ``n`` by score, and the first ``most`` that are sure and wrong or unsure and right, best first; ties by key."""
    r = scored.select(by, key, score.alias("_s"), F.when((F.lower(confidence) == "high") & ~correct, "overconfident_error").when((F.lower(confidence) == "low") & correct, "underconfident_success").alias("_kind"))
    best = topk(r, [by], [F.desc("_s"), key], n, rank="place").withColumn("side", F.lit("best"))
    worst = topk(r, [by], ["_s", F.desc(key)], n, rank="place").withColumn("side", F.lit("worst"))
    odd = topk(r.filter(F.col("_kind").isNotNull()), [by], [F.desc("_s"), key], most, rank="place").withColumn("side", F.col("_kind"))
    return best.unionByName(worst).unionByName(odd).select(by, key, "side", "place")
