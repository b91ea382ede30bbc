"""Online monitoring with Structured Streaming: each micro-batch runs the batch plan on what is still open.

Windows look ahead, so a verdict for t waits until all signals have passed t plus the formula's
depth.  Between micro-batches only the samples from the first open time on are kept, and each
signal's last sample before (for alignment and for dropping late samples): state is bounded by the
depth.  State and verdicts are tables named by batch id and written over when a batch is repeated; the
state of the batch before last is removed.  Keys that bring nothing for ``idle`` microseconds of the
stream's time are forgotten, with what is still open for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tempora.operators import evaluate as E
from tempora.plans.formula import Formula


SEMANTICS = ("delayed_bool", "delayed_rob", "eager", "interval")


@dataclass
class OnlineMonitor:
    """A formula over a stream of samples (the columns of a trace).

    Delayed verdicts leave once, when all signals have passed their window; eager ones once, when they
    are decided and all earlier ones are; intervals leave with each micro-batch until they are closed.
    """

    formula: Formula
    folder: str  # shared by driver and executors
    semantics: str = "delayed_rob"
    synchronize: str = "none"
    bindings: E.Bindings | Callable[[], E.Bindings] | None = None  # a function is asked anew for each micro-batch
    idle: int | None = None

    def __post_init__(self):
        if self.semantics not in SEMANTICS:
            raise ValueError(f"semantics is one of {SEMANTICS}")

    def _at(self, kind: str, batch: int) -> str:
        return f"{self.folder.rstrip('/')}/{kind}/{batch}"

    def _evaluate(self, rows: DataFrame) -> DataFrame:
        options = {"synchronize": self.synchronize, "bindings": self.bindings() if callable(self.bindings) else self.bindings}
        if self.semantics == "eager":
            return E.eager(rows, self.formula, **options)
        if self.semantics == "interval":
            return E.intervals(rows, self.formula, **options)
        return E.verdicts(rows, self.formula, self.semantics.removeprefix("delayed_"), **options)

    def process(self, samples: DataFrame, batch: int) -> None:
        """One micro-batch: writes what it brings and the state for the next one."""
        spark = samples.sparkSession
        signals = self.formula.signals()
        new = samples.select("key", "signal", "t_us", "value", "seq")
        if signals:
            new = new.where(F.col("signal").isin(signals))
        done, rows = None, new
        if batch:
            rows = spark.read.parquet(self._at("state", batch - 1)).unionByName(new)
            done = spark.read.parquet(self._at("bound", batch - 1))
        out = self._evaluate(rows)
        if done is not None:
            out = out.join(done, "key", "left").where(F.col("bound").isNull() | (F.col("t_us") > F.col("bound"))).drop("bound")

        # bound: the time up to which a key's verdicts have left for good
        if self.semantics == "eager":
            out.write.mode("overwrite").parquet(self._at("verdicts", batch))
            bound = spark.read.schema(out.schema).parquet(self._at("verdicts", batch)).groupBy("key").agg(F.max("t_us").alias("bound"))
            bound = bound if done is None else bound.unionByName(done).groupBy("key").agg(F.max("bound").alias("bound"))
        else:
            ends = rows.groupBy("key", "signal").agg(F.max("t_us").alias("t"))
            bound = ends.groupBy("key").agg(F.count("*").alias("n"), F.min("t").alias("t")).where(F.col("n") >= max(1, len(signals))).select("key", (F.col("t") - self.formula.depth()).alias("bound"))
        bound.write.mode("overwrite").parquet(self._at("bound", batch))
        bound = spark.read.schema(bound.schema).parquet(self._at("bound", batch))
        if self.semantics.startswith("delayed"):
            out = out.join(bound, "key").where(F.col("t_us") <= F.col("bound")).drop("bound")
        if self.semantics != "eager":
            out.write.mode("overwrite").parquet(self._at("verdicts", batch))

        last = Window.partitionBy("key", "signal", "closed").orderBy(F.desc("t_us"), "seq")
        kept = rows.join(bound, "key", "left").withColumn("closed", F.coalesce(F.col("t_us") <= F.col("bound"), F.lit(False)))
        kept = kept.withColumn("place", F.row_number().over(last)).where(~F.col("closed") | (F.col("place") == 1)).select("key", "signal", "t_us", "value", "seq")
        if self.idle is not None:
            newest = rows.agg(F.max("t_us")).first()[0] or 0
            live = rows.groupBy("key").agg(F.max("t_us").alias("last")).where(F.col("last") >= newest - self.idle).select("key")
            kept = kept.join(live, "key", "left_semi")
        kept.write.mode("overwrite").parquet(self._at("state", batch))
        for kind in ("state", "bound"):  # a repeated batch needs the one before it only
            old = spark._jvm.org.apache.hadoop.fs.Path(self._at(kind, batch - 2))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def verdicts(self, spark: SparkSession) -> DataFrame:
        """All that has left so far; intervals with the micro-batch they left with."""
        out = spark.read.parquet(f"{self.folder.rstrip('/')}/verdicts/*")
        if self.semantics == "interval":
            out = out.withColumn("batch", F.regexp_extract(F.input_file_name(), "/verdicts/([0-9]+)/", 1).cast("long"))
        return out
