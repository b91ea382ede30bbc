"""Alignment of signals: late samples go, gaps at other signals' times are filled, signals become columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.carry import carried

STRATEGIES = ("none", "zoh", "linear")


def increasing(trace: DataFrame, arrivals: int | None = None) -> DataFrame:
    """Samples that are later than all of their signal that arrived before them.

    arrivals: look at blocks of so many arrivals on their own, after the latest times of the blocks before,
    so that one long signal runs in many tasks.
    """
    if arrivals is not None:
        trace = trace.withColumn("_part", F.floor(F.col("seq") / F.lit(arrivals)))
        tops = trace.groupBy("key", "signal", "_part").agg(F.max("t_us").alias("_top"))
        over = Window.partitionBy("key", "signal").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        past = tops.select("key", "signal", "_part", F.max("_top").over(over).alias("_past"))
        inside = Window.partitionBy("key", "signal", "_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        rows = trace.join(past, ["key", "signal", "_part"]).withColumn("_latest", F.greatest(F.max("t_us").over(inside), "_past"))
        return rows.where(F.col("_latest").isNull() | (F.col("t_us") > F.col("_latest"))).select(*(c for c in trace.columns if c != "_part"))
    before = Window.partitionBy("key", "signal").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max("t_us").over(before)
    return trace.withColumn("_latest", latest).where(F.col("_latest").isNull() | (F.col("t_us") > F.col("_latest"))).drop("_latest")


def wide(trace: DataFrame, signals: list[str], synchronize: str = "none", arrivals: int | None = None, width: int | None = None, also: Sequence[str] = ()) -> DataFrame:
    """One row per key and time: key, t_us, seq, and per signal s its value v_s and arrival q_s (null: no sample).

    ``zoh`` holds the last sample and ``linear`` interpolates, at times of other signals that lie
    between two samples of a signal; a filled value arrives with the later of the two.
    width: fill by parts of so many microseconds, over which last and next samples are carried, so that
    one long key runs in many tasks.  also: further columns of samples, as <column>_<s>, filled as arrivals are.
    """
    if synchronize not in STRATEGIES:
        raise ValueError(f"synchronize is one of {STRATEGIES}")
    columns = [("v", "value"), ("q", "seq"), *((c, c) for c in also)]
    cells = [F.max(F.when(F.col("signal") == s, F.col(c))).alias(f"{p}_{i}") for i, s in enumerate(signals) for p, c in columns]
    rows = increasing(trace.where(F.col("signal").isin(signals)), arrivals).groupBy("key", "t_us").agg(F.max("seq").alias("seq"), *cells)
    if synchronize == "none" or len(signals) < 2:
        return rows
    known = lambda i: F.when(F.col(f"v_{i}").isNotNull(), F.struct("t_us", *(F.col(f"{p}_{i}").alias(p) for p, _ in columns)))
    before, after = ({f"{side}_{i}": known(i) for i in range(len(signals))} for side in ("a", "b"))
    if width is not None:
        both = carried(rows, ["key"], ["t_us"], F.floor(F.col("t_us") / F.lit(width)), before, after)
    else:
        past = Window.partitionBy("key").orderBy("t_us").rowsBetween(Window.unboundedPreceding, 0)
        ahead = Window.partitionBy("key").orderBy(F.desc("t_us")).rowsBetween(Window.unboundedPreceding, 0)  # a frame that only grows
        both = rows.select("*", *(F.last(k, True).over(past).alias(c) for c, k in before.items()), *(F.last(k, True).over(ahead).alias(c) for c, k in after.items()))
    out = []
    for i in range(len(signals)):
        a, b = F.col(f"a_{i}"), F.col(f"b_{i}")
        seconds = lambda t: t / F.lit(1_000_000.0)
        if synchronize == "linear":
            filled = a["v"] + (b["v"] - a["v"]) * (seconds(F.col("t_us") - a["t_us"]) / seconds(b["t_us"] - a["t_us"]))
        else:
            filled = a["v"]
        between = F.col(f"v_{i}").isNull() & a.isNotNull() & b.isNotNull()
        out += [F.when(between, filled).otherwise(F.col(f"v_{i}")).alias(f"v_{i}"), *(F.when(between, b[p]).otherwise(F.col(f"{p}_{i}")).alias(f"{p}_{i}") for p, _ in columns[1:])]
    return both.select("key", "t_us", "seq", *out)
