"""Values carried along an ordered axis in two levels, and as-of joins with change logs built on it.

A long axis (one key's time, or all arrivals) is cut into parts.  The last known value of each part is
one row of a small table, in which a running window carries values over parts; rows then look inside
their own part only, and else take what was carried in.  So no task holds more of the axis than a part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARRIVALS = 1 << 20  # of a part when an axis of arrivals is cut


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[str], part: Column, past: Mapping[str, Column], ahead: Mapping[str, Column] | None = None) -> DataFrame:
    """rows with columns of the last non-null value at or before each row (``past``), and the first at or after it (``ahead``).

    by: the columns of one axis (may be null); order: columns that order an axis; part: the part of a row, growing along it.
    """
    ahead = ahead or {}
    rows = rows.withColumn("_part", part)
    named = {f"_p{k}": (out, value, False) for k, (out, value) in enumerate(past.items())} | {f"_a{k}": (out, value, True) for k, (out, value) in enumerate(ahead.items())}
    rows = rows.withColumns({c: value for c, (_, value, _) in named.items()})
    place = F.struct(*order)
    tops = rows.groupBy(*by, "_part").agg(*((F.min_by if back else F.max_by)(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c, (_, _, back) in named.items()))
    before = lambda back: Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_part") if back else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    brought = tops.select(*(F.col(c).alias(f"_b{c}") for c in by), F.col("_part").alias("_bpart"), *(F.last(c, True).over(before(back)).alias(f"_in{c}") for c, (_, _, back) in named.items()))
    same = F.col("_part").eqNullSafe(F.col("_bpart"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b{c}"))
    met = rows.join(brought, same)
    inside = lambda back: Window.partitionBy(*by, "_part").orderBy(*(F.desc(c) if back else F.asc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    found = {out: F.coalesce(F.last(c, True).over(inside(back)), F.col(f"_in{c}")) for c, (out, _, back) in named.items()}
    kept = [c for c in rows.columns if c not in {"_part", *named, *found}]
    return met.select(*kept, *(e.alias(out) for out, e in found.items()))


def joined(rows: DataFrame, by: Sequence[str], part: str, small: DataFrame) -> DataFrame:
    """rows beside the columns of a small table that has one row for each axis (may be null) and part."""
    at = small.withColumnsRenamed({c: f"_b{c}" for c in [*by, part]})
    same = F.col(part).eqNullSafe(F.col(f"_b{part}"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b{c}"))
    return rows.join(at, same).drop(*(f"_b{c}" for c in [*by, part]))


def running_max(rows: DataFrame, by: Sequence[str], order: str, part: str, values: Mapping[str, Column]) -> DataFrame:
    """rows with columns of the greatest value up to each row; part: a column, growing along the axis."""
    rows = rows.withColumns({f"_r{k}": v for k, v in enumerate(values.values())})
    tops = rows.groupBy(*by, part).agg(*(F.max(f"_r{k}").alias(f"_r{k}") for k in range(len(values))))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    brought = tops.select(*by, part, *(F.max(f"_r{k}").over(before).alias(f"_in{k}") for k in range(len(values))))
    inside = Window.partitionBy(*by, part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = joined(rows, by, part, brought)
    return met.withColumns({out: F.greatest(F.max(f"_r{k}").over(inside), f"_in{k}") for k, out in enumerate(values)}).drop(*(f"{p}{k}" for k in range(len(values)) for p in ("_r", "_in")))


def as_of(samples: DataFrame, logs: Mapping[str, DataFrame], width: int = ARRIVALS) -> DataFrame:
    """samples with a column for each log: the value of its latest change at or before the sample's arrival (null: none yet).

    logs: tables (effective_seq, value), or (key, effective_seq, value) where each key has changes of its own; of several
    changes at one arrival the greatest value holds.  Axes are cut into ranges of ``width`` arrivals.
    """
    for keyed in (False, True):
        some = {n: log for n, log in logs.items() if ("key" in log.columns) == keyed}
        if not some:
            continue
        by = ["key"] if keyed else []
        columns = samples.columns
        axis = samples.withColumns({"_sample": F.lit(1)} | {f"_w{k}": F.lit(None).cast("double") for k in range(len(some))})
        for k, log in enumerate(some.values()):
            one = log.where("effective_seq is not null and value is not null").groupBy(*by, F.col("effective_seq").cast("long").alias("seq")).agg(F.max(F.col("value").cast("double")).alias(f"_w{k}"))
            axis = axis.unionByName(one.withColumn("_sample", F.lit(0)), allowMissingColumns=True)
        part = F.floor(F.col("seq") / F.lit(width))
        axis = carried(axis, by, ["seq", "_sample"], part, {n: F.col(f"_w{k}") for k, n in enumerate(some)})
        samples = axis.where("_sample = 1").select(*columns, *some)
    return samples


def changes(log: DataFrame, *names: str) -> dict[str, DataFrame]:
    """The changes of each named variable, from a log (name, effective_seq, value), or with a key."""
    columns = [c for c in ("key", "effective_seq", "value") if c in log.columns]
    return {n: log.where(F.col("name") == n).select(*columns) for n in names}
