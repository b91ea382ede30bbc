"""Sliding extremes and until over one key's rows in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def ahead(start: int, end: int) -> WindowSpec:
    """Rows of the key between t + start and t + end microseconds."""
    return Window.partitionBy("key").orderBy("t_us").rangeBetween(start, end)


def from_on(start: int) -> WindowSpec:
    """Rows of the key from t + start microseconds on."""
    # seen from the end, so that the frame only grows: frames open at the end are evaluated anew for each row
    return Window.partitionBy("key").orderBy(F.desc("t_us")).rangeBetween(Window.unboundedPreceding, -start)


def truth_sweep(part: Column, start: int, end: int, exists: bool) -> Column:
    """Whether some (``exists``) or every row of the window holds: by the first time from t + start on that decides."""
    met = F.min(F.when(part == F.lit(exists), F.col("t_us"))).over(from_on(start))
    hit = F.coalesce(met <= F.col("t_us") + F.lit(end), F.lit(False))
    return hit if exists else ~hit


def until_truth(left: Column, right: Column, start: int, end: int, reach: int) -> Column:
    """Truth of left until right: the first right in the window comes before the first row without left.

    reach: how far the window of rights begins (0 to look from t on).
    """
    both = left.isNotNull() & right.isNotNull()
    met = F.min(F.when(both & right, F.col("t_us"))).over(from_on(reach))
    broken = F.min(F.when(both & ~left, F.col("t_us"))).over(from_on(0))
    return F.coalesce(met <= F.col("t_us") + F.lit(end), F.lit(False)) & (broken.isNull() | (met < broken))


def _looked_up(rows: DataFrame, width: int, start: int, end: int, suffix: list[str], prefix: list[str]) -> DataFrame:
    """rows with ``_s`` and ``_p``: the columns ``suffix`` of the first row from t + start on, and ``prefix`` of the last
    row up to t + end; null where that row is not in the block (of ``width``) of the window's begin or end."""
    place = lambda shift: F.floor((F.col("t_us") + F.lit(shift)) / F.lit(width))
    until_end = Window.partitionBy("key").orderBy("t_us").rangeBetween(Window.unboundedPreceding, end)  # a frame that only grows
    s, p = (F.struct("_block", *(F.col(c).alias(c) for c in cols)) for cols in (suffix, prefix))
    rows = rows.withColumns({"_s": F.last(s).over(from_on(start)), "_p": F.last(p).over(until_end)})
    return rows.withColumns({"_s": F.when(F.col("_s._block") == place(start), F.col("_s")), "_p": F.when(F.col("_p._block") == place(end), F.col("_p"))})


def block_extreme(rows: DataFrame, value: str, start: int, end: int, least: bool, out: str) -> DataFrame:
    """rows with ``out``: the extreme of ``value`` over t + start .. t + end, by blocks as wide as the window.

    A window spans two neighbouring blocks: the end of one and the beginning of the next.  Each half is
    a running extreme inside a block, looked up at the window's first and last row, and all frames only
    grow, so cost per row does not depend on the window.  Needs end > start and one row per key and time.
    """
    width = end - start
    best = F.min if least else F.max
    inside = Window.partitionBy("key", "_block")
    rows = rows.withColumn("_block", F.floor(F.col("t_us") / F.lit(width)))
    rows = rows.withColumns({"_tail": best(value).over(inside.orderBy(F.desc("t_us")).rowsBetween(Window.unboundedPreceding, 0)), "_head": best(value).over(inside.orderBy("t_us").rowsBetween(Window.unboundedPreceding, 0))})
    rows = _looked_up(rows, width, start, end, ["_tail"], ["_head"])
    join = F.least if least else F.greatest
    return rows.withColumn(out, join("_s._tail", "_p._head")).drop("_block", "_tail", "_head", "_s", "_p")


def first_from(cond: Column, start: int, *cols: Column) -> Column:
    """(t_us, cols) of the first row from t + start on where cond holds."""
    return F.min(F.when(cond, F.struct("t_us", *cols))).over(from_on(start))


def until_fold(left: Column, right: Column, start: int, end: int, top: Column | None = None, bottom: Column | None = None) -> Column:
    """The robustness of until by a walk over each window's rows: for windows of few rows.

    top, bottom: above and below all values, where these are not doubles.
    """
    known = left.isNotNull() & right.isNotNull()
    top, bottom = F.lit(INF) if top is None else top, F.lit(-INF) if bottom is None else bottom
    walk = F.sort_array(F.collect_list(F.when(known, F.struct(F.col("t_us").alias("t"), left.alias("l"), right.alias("r")))).over(ahead(0, end)))

    def step(acc: Column, x: Column) -> Column:
        run = F.least(acc["run"], x["l"])
        return F.struct(run.alias("run"), F.when(x["t"] >= F.col("t_us") + F.lit(start), F.greatest(acc["best"], F.least(x["r"], run))).otherwise(acc["best"]).alias("best"))

    return F.aggregate(walk, F.struct(top.alias("run"), bottom.alias("best")), step, lambda acc: acc["best"])


def until_best(rows: DataFrame, left: str, right: str, start: int, end: int, out: str, top: Column | None = None, bottom: Column | None = None) -> DataFrame:
    """rows with ``out``, the robustness of until: the best over t' of min(right at t', least left up to t').

    Blocks of time are as wide as the window.  From a row to the end of its block, left and right make
    a clamp x -> min(high, max(low, x)); clamps of 1, 2, 4, ... rows are composed by doubling.  From the
    beginning of a block the best is a running one.  A window is the end of one block and the beginning
    of the next: n log n in the rows of a block, whatever the window.
    """
    t, top, bottom = F.col("t_us"), F.lit(INF) if top is None else top, F.lit(-INF) if bottom is None else bottom
    known = F.col(left).isNotNull() & F.col(right).isNotNull()
    rows = rows.withColumns({"_l": F.when(known, F.col(left)), "_r": F.when(known, F.col(right))})
    ahead_of = F.coalesce(F.min("_l").over(ahead(0, start - 1)), top) if start else top  # left up to the window
    if start == end:
        at = F.least(F.min("_l").over(ahead(0, start)), F.max("_r").over(ahead(start, start)))
        there = F.max("_r").over(ahead(start, start)).isNotNull()
        return rows.withColumn(out, F.when(there, at).otherwise(bottom)).drop("_l", "_r")
    width = end - start
    rows = rows.withColumn("_block", F.floor(t / F.lit(width)))
    most = rows.groupBy("key", "_block").count().agg(F.max("count")).first()[0] or 1
    inside = Window.partitionBy("key", "_block").orderBy("t_us")
    so_far, onward = inside.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("key", "_block").orderBy(F.desc("t_us")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_low": F.coalesce("_r", bottom), "_high": F.coalesce("_l", top), "_run": F.min("_l").over(so_far), "_left": F.min("_l").over(onward)})
    rows = rows.withColumn("_head", F.max(F.when(F.col("_r").isNotNull(), F.least("_r", "_run"))).over(so_far))
    step = 1
    while step < most:
        rows = rows.withColumns({"_low2": F.lead("_low", step).over(inside), "_high2": F.lead("_high", step).over(inside)})
        high = F.when(F.col("_high2").isNull(), F.col("_high")).otherwise(F.least("_high", F.greatest("_low", "_high2")))
        rows = rows.withColumns({"_low": F.greatest("_low", "_low2"), "_high": high}).drop("_low2", "_high2")
        step *= 2
    rows = _looked_up(rows.withColumn("_tail", F.least("_low", "_high")), width, start, end, ["_tail", "_left"], ["_head"])
    first, second = F.coalesce("_s._tail", bottom), F.coalesce("_p._head", bottom)
    value = F.least(ahead_of, F.greatest(first, F.least(F.coalesce("_s._left", top), second)))
    return rows.withColumn(out, value).drop("_l", "_r", "_block", "_low", "_high", "_run", "_left", "_head", "_tail", "_s", "_p")
