"""Tables that are written once and read by several jobs, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local temporary folder only where it is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _OWN.setdefault("folder", tempfile.mkdtemp(prefix="tempora-"))


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a table written now; later jobs read it, and lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tempora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_UNIT = 1 << 40


def sampled(rows: DataFrame, n: int, *key: Column | str) -> DataFrame:
    """The n rows with the least hashes of ``key`` (which tells rows apart), or all of fewer; few more than n meet in one task."""
    at = F.pmod(F.xxhash64(*key), F.lit(_UNIT))
    total = rows.count()
    if total > 4 * n:  # twice as many as wanted are expected below this hash
        rows = rows.where(at < int(_UNIT * 2 * n / total))
    return rows.orderBy(at, *key).limit(n)


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether crc32 of the id as text modulo 5 is that remainder; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == remainder, F.lit(False))


def free_name(rows: DataFrame, name: str) -> str:
    """The name with as many underscores before it as keep it apart from all columns of the rows."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
