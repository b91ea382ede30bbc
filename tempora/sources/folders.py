"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The name of a new folder below spark.checkpoint.dir; below a local temporary one only where that is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _OWN.setdefault("folder", tempfile.mkdtemp(prefix="tempora-"))
    return f"{folder.rstrip('/')}/tempora-{uuid.uuid4().hex}"


def replay(trace: DataFrame, parts: int) -> DataFrame:
    """The trace as a stream of so many micro-batches, in order of arrival: written as files now, one of which a batch reads."""
    spark, folder = trace.sparkSession, scratch(trace.sparkSession)
    first, last = trace.agg(F.min("seq"), F.max("seq")).first()
    if first is None:
        first = last = 0
    for k in range(parts):
        low, high = (first + (last + 1 - first) * i // parts for i in (k, k + 1))
        trace.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(trace.schema).option("maxFilesPerTrigger", 1).parquet(folder)
