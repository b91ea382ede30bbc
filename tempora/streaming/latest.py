"""The latest verdict of each key and time, kept as files that don't grow in number with the micro-batches.

Each batch adds a small folder of its own.  Every so many batches these are merged into the buckets of
time that they touch, and only those are written anew: verdicts of times long past, which no longer change, stay
as they are.  A row carries its batch, and readers keep the row of the latest batch, so that a merge that
was cut short, or a batch that comes again, changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ("key", "t_us")
PARTS = 64  # shuffle partitions whose rows of a batch make a file: dealt anew, so that what yields them keeps its tasks


def latest(rows: DataFrame) -> DataFrame:
    """Of the rows of each key and time, that of the latest batch."""
    rest = [c for c in rows.columns if c not in KEY]
    best = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "batch").alias("best"))
    return best.select(*KEY, *(F.col("best")[c].alias(c) for c in rest)).select(*rows.columns)


@dataclass
class LatestVerdicts:
    """folder: shared by driver and executors; width: microseconds of a bucket; every: batches from one merge to the next."""

    folder: str
    width: int = 86_400_000_000
    every: int = 16

    def _at(self, *parts: object) -> str:
        return "/".join([self.folder.rstrip("/"), *map(str, parts)])

    def _paths(self, spark: SparkSession, pattern: str) -> list[str]:
        path = spark._jvm.org.apache.hadoop.fs.Path(self._at(pattern))
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(f.getPath().toString() for f in found or [])

    def _delete(self, spark: SparkSession, paths: list[str]) -> None:
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def merge(self, verdicts: DataFrame, batch: int) -> None:
        """Takes in a micro-batch (key, t_us and values); one that came before writes the same again."""
        spark = verdicts.sparkSession
        done = max((int(p.rpartition("=")[2]) for p in self._paths(spark, "merged/upto=*")), default=-1)
        if batch <= done:
            return
        rows = verdicts.withColumns({"batch": F.lit(batch).cast("long"), "bucket": F.floor(F.col("t_us") / F.lit(self.width))})
        files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTS)
        rows.repartition(files, *KEY).write.mode("overwrite").parquet(self._at("new", f"of={batch}"))
        if batch - done >= self.every:
            self._compact(spark, batch)

    def _compact(self, spark: SparkSession, batch: int) -> None:
        new = self._paths(spark, "new/of=*/_SUCCESS")
        rows = spark.read.option("basePath", self._at("new")).parquet(*(p.rpartition("/")[0] for p in new)).drop("of")
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # buckets of a few batches
        old = [p for p in self._paths(spark, "merged/upto=*/bucket=*") if int(p.rpartition("=")[2]) in set(touched)]
        if old:
            rows = rows.unionByName(spark.read.option("basePath", self._at("merged")).parquet(*old).drop("upto").select(*rows.columns))
        by = latest(rows).repartition(max(1, len(touched)), "bucket")
        by.write.mode("overwrite").partitionBy("bucket").parquet(self._at("merged", f"upto={batch}"))
        self._delete(spark, [p for p in old if f"/upto={batch}/" not in p])
        self._delete(spark, [p.rpartition("/")[0] for p in new])
        for p in self._paths(spark, "merged/upto=*"):  # those of which no bucket is left, but for the latest
            if not p.endswith(f"upto={batch}") and not self._paths(spark, f"merged/{p.rpartition('/')[2]}/bucket=*"):
                self._delete(spark, [p])

    def read(self, spark: SparkSession) -> DataFrame:
        """One row per key and time: its latest values, and the batch they came with."""
        found = None
        for part, sub, drop in (("merged", "upto=*/bucket=*", "upto"), ("new", "of=*", "of")):
            paths = self._paths(spark, f"{part}/{sub}")
            if paths:
                rows = spark.read.option("basePath", self._at(part)).parquet(*paths).drop(drop).withColumn("bucket", F.col("bucket").cast("long"))
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            raise ValueError("no batch has come yet")
        return latest(found).drop("bucket")

    def start(self, verdicts: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Keeps the view of a streaming DataFrame of verdicts."""
        return verdicts.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
