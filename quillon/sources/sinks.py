"""Where tables that a query writes go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return f"{given.rstrip('/')}/quillon-sinks"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillon-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, made once and read from a table by whatever asks for it."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
