"""Scheduled jobs as streaming queries that take what is there and stop."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.relational import first_of
from quillon.sources.sinks import scratch
from quillon.sources.tables import Tables


def _stream(t: Tables) -> DataFrame:
    """The events as a stream; a table of one file is read by a glob that matches it alone."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parque[t]")
    return events.withColumn("ts", events["ts"].cast("timestamp"))


def run_once(t: Tables, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f's rows over the stream of events, through a file sink with a checkpoint."""
    root = f"{scratch(t.spark)}/stream-{uuid.uuid4().hex}"
    made = f(_stream(t))
    made.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).format("parquet").option("path", f"{root}/out").start().awaitTermination()
    return t.spark.read.schema(made.schema).parquet(f"{root}/out")


def run_updates(t: Tables, f: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """f's aggregate over the stream, each key as it was last updated.

    A trigger writes the keys that it changed, under its own number, so that a
    repeated trigger replaces what it wrote; the watermark frees the state of closed windows.
    """
    root = f"{scratch(t.spark)}/stream-{uuid.uuid4().hex}"
    made = f(_stream(t))
    q = made.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    q.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{root}/out/batch={i}")).start().awaitTermination()
    schema = type(made.schema)([*made.schema.fields]).add("batch", "long")
    return first_of(t.spark.read.schema(schema).parquet(f"{root}/out"), keys, [F.desc("batch")]).drop("batch")


def windows(t: Tables, width: str, name: str, start: str | None = None) -> DataFrame:
    """Counts and sums of events by window and kind."""
    w = F.window("ts", width, startTime=start) if start else F.window("ts", width)
    return run_updates(t, lambda s: s.withWatermark("ts", "1 day").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias(name), "event_type", "n", "total"), [name, "event_type"])


def sessions(t: Tables, gap: str = "30 minutes") -> DataFrame:
    """Each user's sessions, which a pause of ``gap`` ends, once the watermark has passed them; open ones stay in the state."""
    w = F.session_window("ts", gap)
    return run_once(t, lambda s: s.withWatermark("ts", "1 day").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n", "total"))


def last_run(t: Tables) -> DataFrame:
    """What a job's state holds after a run: how many rows it has taken, and the newest; a second run with the state adds nothing."""
    root = f"{scratch(t.spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        _stream(t).select("event_id", "ts").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("event_id long, ts timestamp").parquet(f"{root}/out").agg(F.count("*").alias("taken"), F.max("ts").cast("timestamp_ntz").alias("newest"))


def resumed(t: Tables) -> DataFrame:
    """A query that is run twice with one checkpoint: the second run finds nothing new, so that each event is there once."""
    root = f"{scratch(t.spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        _stream(t).select("event_id").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("event_id long").parquet(f"{root}/out")
