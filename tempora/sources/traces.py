"""Traces: samples as rows (key, signal, t_us, value, seq).

``key`` names independent monitors and is the axis of parallelism; ``t_us`` is time in whole
microseconds; ``seq`` is the order of arrival.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("key", "signal", "t_us", "value", "seq")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def trace(rows: DataFrame, key: Column | str, signal: Column | str, time: Column | str, value: Column | str, seq: Column | str) -> DataFrame:
    """A trace from any table; time: microseconds, or a timestamp.  NaN values and rows without a time are left out."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = rows.select(col(key).alias("key"), col(signal).alias("signal"), col(time).alias("t_us"), col(value).cast("double").alias("value"), col(seq).alias("seq"))
    if not out.schema["t_us"].dataType.simpleString() == "bigint":
        out = out.withColumn("t_us", micros(F.col("t_us")))
    return out.where(F.col("t_us").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def events_trace(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """The events table as a trace per user: one signal x, or one signal per event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return trace(events, "user_id", F.col("event_type") if by_type else F.lit("x"), micros(F.col("ts")), "value", "event_id")


def orders_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as a trace per customer; days hold several orders at times."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return trace(orders, "o_custkey", F.lit("x"), micros(F.col("o_orderdate")), "o_totalprice", "o_orderkey")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows read from files, with ``row``: 0, 1, ... over the files in order of their names.

    In two levels: each piece of a file that a task reads counts its rows, and the pieces before it, in a small
    table, say where its count begins.
    """
    places = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    pieces = places.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    begins = pieces.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return places.join(begins, ["_file", "_start"]).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias("row"))


#: names all columns, as those that nothing asks for are not parsed
_IS_SAMPLE = "line is null and timestep is not null and value is not null"


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("columnPruning", "false").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line")
    return reader.csv(path, header=True, schema="timestep double, value double, line string")


def read_csv(spark: SparkSession, path: str, signal: str = "x", key: str = "", rate: float | None = None) -> DataFrame:
    """Samples from CSV files with header ``timestep,value`` (seconds); arrival is in order of time.

    rate: rows are samples at so many per second, whatever their timestep: a row's number over all files, in order
    of their names, is its arrival and gives its time.  Rows that don't parse are no samples (see ``rejected_csv``) but are counted.
    """
    rows = _parsed(spark, path)
    if rate is not None:
        rows = numbered(rows)
        t, seq = F.round(F.col("row") * (1_000_000 / rate)).cast("long"), F.col("row")
    else:
        t = seq = F.round(F.col("timestep") * 1_000_000).cast("long")
    return trace(rows.where(_IS_SAMPLE), F.lit(key), F.lit(signal), t, "value", seq)


def rejected_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of such files that are no samples, by their number: row, line (null: it parses, but a cell is empty)."""
    return numbered(_parsed(spark, path)).where(f"not ({_IS_SAMPLE})").select("row", "line")


def write_csv(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("overwrite").csv(path, header=True)


def from_samples(spark: SparkSession, samples: dict[str, list[tuple[float, float]]], key: str = "") -> DataFrame:
    """A small trace from {signal: [(value, seconds)]}; signals arrive interleaved in order of time."""
    rows = [(signal, round(t * 1_000_000), float(v)) for signal, steps in samples.items() for v, t in steps]
    if not rows:
        raise ValueError("no samples")
    rows = [(key, *r, k) for k, r in enumerate(sorted(rows, key=lambda r: r[1]))]
    return spark.createDataFrame(rows, "key string, signal string, t_us long, value double, seq long")


def sine(spark: SparkSession, n: int, rate: float = 1.0, frequency: float = 0.01, signal: str = "x") -> DataFrame:
    """n samples of a sine wave at ``rate`` Hz."""
    t = F.col("id") / F.lit(rate)
    return trace(spark.range(n), F.lit(""), F.lit(signal), F.round(t * 1_000_000).cast("long"), F.sin(F.lit(2 * math.pi * frequency) * t), "id")


def chirp(spark: SparkSession, n: int, rate: float = 1.0, low: float = 0.001, high: float = 0.1, signal: str = "x") -> DataFrame:
    """n samples of a sine whose frequency rises linearly from ``low`` to ``high``."""
    t, total = F.col("id") / F.lit(rate), max(n, 1) / rate
    phase = F.lit(low) * t + F.lit((high - low) / (2 * total)) * t * t
    return trace(spark.range(n), F.lit(""), F.lit(signal), F.round(t * 1_000_000).cast("long"), F.cos(F.lit(2 * math.pi) * phase), "id")
