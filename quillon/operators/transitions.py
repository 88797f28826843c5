"""What took a section's place: a fitted model's word first, then the table of replaced sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import section_number
from quillon.operators.retrieval import dense

# For each old act what its name holds, its short name, the new act's, and what is said of a section that the model calls replaced without naming by what.
OLD_ACTS = [(["IPC", "Indian Penal Code"], "IPC", "BNS", "Removed in BNS"), (["CrPC", "Code of Criminal Procedure", "Cr.P.C"], "CrPC", "BNSS", "BNSS equivalent")]
LEARNED, GONE, SIGN = "learned transition classifier", "removed", "⚠️ Note: "


def _old(act: Column, value: int) -> Column:
    """Of the first old act that a name holds; null for other acts."""
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(act, F.lit(n)) for n in o[0]]), o[value]) for o in OLD_ACTS])


def nearest_positive(asked: DataFrame, known: DataFrame, *, key: str, vector: str, name: str, label: str = "label") -> DataFrame:
    """Rows of (key, replacement): the ``name`` of the closest vector among the ``known`` ones that are labelled 1."""
    positive = known.filter(F.col(label) == 1).select(F.monotonically_increasing_id().alias("_id"), F.col(vector).alias("_v"), F.col(name).alias("replacement"))
    found = dense(positive.select("_id", "_v"), asked.select(F.col(key).alias("_q"), F.col(vector).alias("_w")), key="_id", vector="_v", query="_q", query_vector="_w", k=1)
    return found.join(positive.select("_id", "replacement"), "_id").select(F.col("_q").alias(key), "replacement")


def transitions(sections: DataFrame, predicted: DataFrame, table: DataFrame, *, act: str = "act_name", section: str = "section_number") -> DataFrame:
    """``sections`` with original, replaced_by, changes, note and source, null where nothing took a section's place.

    ``predicted`` are (act, section, is_superseded, replacement), one row a
    section; ``table`` (old, section, new, changes), by the old act's short name and
    one row a section, with ``removed`` for sections without successor. For the
    old acts a prediction that a section is superseded wins; if there is none,
    or it says no, the table counts. Sections of other acts, and those without a
    number that the table lacks, stay as they are.
    """
    number = F.when(F.coalesce(F.trim(F.col(section)), F.lit("")) != "", section_number(F.col(section)))
    own = sections.withColumn("_n", number).withColumn("_old", _old(F.coalesce(F.col(act), F.lit("")), 1))
    p = predicted.filter("is_superseded").select(F.col(act).alias("_pa"), section_number(F.col(section)).alias("_ps"), F.lit(True).alias("_yes"), F.nullif("replacement", F.lit("")).alias("_by"))
    t = table.select(F.col("old").alias("_to"), F.col("section").alias("_ts"), F.col("new").alias("_new"), F.col("changes").alias("_what"))
    both = own.join(p, (own[act] == p["_pa"]) & (own["_n"] == p["_ps"]) & own["_old"].isNotNull(), "left").join(t, (own["_old"] == t["_to"]) & (own["_n"] == t["_ts"]), "left")
    learned, ruled = F.coalesce("_yes", F.lit(False)), F.col("_new").isNotNull()
    newer, default = _old(F.coalesce(F.col(act), F.lit("")), 2), _old(F.coalesce(F.col(act), F.lit("")), 3)
    at = F.concat("_old", F.lit(" Section "), "_n")
    by = F.coalesce("_by", default)
    gone = F.col("_new") == GONE
    name = F.concat(newer, F.lit(" Section "), "_new")
    said = {
        "original": F.when(learned | ruled, at),
        "replaced_by": F.when(learned, by).when(ruled & gone, F.concat(F.lit("Removed in "), newer)).when(ruled, name),
        "changes": F.when(learned, LEARNED).when(ruled, F.col("_what")),
        "note": F.when(learned, F.concat(F.lit(SIGN), at, F.lit(" has been superseded. Suggested replacement: "), by, F.lit(".")))
        .when(ruled & gone, F.concat(F.lit(SIGN), at, F.lit(" has been removed in Bharatiya Nyaya Sanhita 2023.")))
        .when(ruled, F.concat(F.lit(SIGN), at, F.lit(" has been replaced by "), name, F.lit(". Changes: "), F.coalesce("_what", F.lit("")))),
        "source": F.when(learned, "learned").when(ruled, "rule_map"),
    }
    return both.select(*sections.columns, *[c.alias(n) for n, c in said.items()])
