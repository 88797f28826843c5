"""Versioned tables: upserts, reloads, re-indexing and point reads through buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.sources import versioned
from quillon.sources.sinks import scratch

_acts = lambda t: versioned.create(t.spark, f"{scratch(t.spark)}/acts-{uuid.uuid4().hex}", t.bare_acts.select("id", "act_name", "section_number"), "id")


@query("s08_versioned_upsert", "SELECT id, act_name, section_number FROM bare_acts WHERE id % 10 <> 0 UNION ALL SELECT id, 'Amended Act', section_number FROM bare_acts WHERE id % 10 = 0 UNION ALL SELECT id + 1000000000, 'New Act', section_number FROM bare_acts WHERE id % 20 = 0")
def _upsert(t):
    """Changed and new rows by key; only the buckets that they touch are written anew."""
    changed = t.bare_acts.filter("id % 10 = 0").select("id", F.lit("Amended Act").alias("act_name"), "section_number")
    new = t.bare_acts.filter("id % 20 = 0").select((F.col("id") + 1000000000).alias("id"), F.lit("New Act").alias("act_name"), "section_number")
    return _acts(t).upsert(changed.unionAll(new)).read()


@query("s09_versioned_reload", "SELECT id, act_name, section_number FROM bare_acts WHERE act_name <> 'Bharatiya Nyaya Sanhita 2023' AND id % 15 <> 0 UNION ALL SELECT id, act_name, 'new ' || section_number FROM bare_acts WHERE act_name = 'Bharatiya Nyaya Sanhita 2023' AND id % 2 = 1 AND id % 15 <> 0")
def _reload(t):
    """An act's rows are taken out and loaded again in one step; then some keys are deleted."""
    act = F.col("act_name") == "Bharatiya Nyaya Sanhita 2023"
    loaded = t.bare_acts.filter(act & (F.col("id") % 2 == 1)).select("id", "act_name", F.concat(F.lit("new "), "section_number").alias("section_number"))
    return _acts(t).replace(act, loaded).delete(t.bare_acts.filter("id % 15 = 0").select("id")).read()


@query("s12_versioned_reindex", "SELECT id, upper(act_name) AS act_name, section_number FROM bare_acts")
def _reindex(t):
    """Rows made anew in a table beside the old one."""
    return _acts(t).reindex("_upper", lambda df: df.withColumn("act_name", F.upper("act_name"))).read()


query("s02_bucket_read", "SELECT id, act_name, section_number FROM bare_acts WHERE id IN (7, 42, 99)")(lambda t: _acts(t).get(7, 42, 99))
