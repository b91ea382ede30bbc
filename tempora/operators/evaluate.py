"""Evaluation of formulas over traces: one column per distinct subformula, windows over one exchange by key.

``verdicts`` gives (key, t_us, value) once windows are closed, as truth, robustness, robustness with its witness, or in a domain of the user's;
``eager`` gives truth as soon as it is decided, with the arrival that decided it; ``intervals``
gives robustness intervals on what has arrived; ``interval_trace`` all their refinements.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.algebra import DOMAINS, INF, Robustness, Truth
from tempora.operators import temporal as W
from tempora.operators.carry import ARRIVALS, as_of, joined, running_max
from tempora.operators.sync import wide
from tempora.plans.formula import And, Compare, Constant, Eventually, Formula, Globally, Not, Or, Timed, Until, lowered

#: name -> value, or -> [(first arrival it holds for, value), ...], or -> a table of changes (see ``carry.as_of``)
Bindings = Mapping[str, float | Sequence[tuple[int, float]] | DataFrame]


@dataclass
class Plan:
    """A lowered formula, its signals and the numbers of its distinct subformulas."""

    formula: Formula
    signals: list[str]
    number: dict[Formula, int]
    ends: bool = False  # whether rows hold e_<i>, the last time of each signal of their key
    parts: bool = False  # whether rows hold _own, the part of their key's time, and z_<i>, each signal's first arrival after the next part
    logs: Mapping[str, DataFrame] = field(default_factory=dict)  # variables whose changes are a table: w<j>_<i>, as each sample of signal i arrives

    @staticmethod
    def of(formula: Formula, bindings: Bindings | None) -> Plan:
        low = lowered(formula)
        missing = set(low.variables()) - set(bindings or {})
        if missing:
            raise ValueError(f"no value for variable {', '.join(sorted(missing))}")
        logs = {n: b for n in low.variables() if isinstance(b := (bindings or {})[n], DataFrame)}
        return Plan(low, low.signals(), {f: k for k, f in enumerate(low.walk())}, logs=logs)

    def table(self, trace: DataFrame, synchronize: str, arrivals: int | None = None, width: int | None = None) -> DataFrame:
        """One row per key and time; a formula without signals is evaluated on all of the trace."""
        if self.signals:
            return wide(self.arrived(trace), self.signals, synchronize, arrivals, width, [f"w{j}" for j in range(len(self.logs))])
        return trace.groupBy("key", "t_us").agg(F.max("seq").alias("seq"))

    def arrived(self, trace: DataFrame) -> DataFrame:
        """The samples of the plan's signals, with the values of variables as each arrives."""
        own = trace.where(F.col("signal").isin(self.signals))
        return as_of(own.select("key", "signal", "t_us", "value", "seq"), {f"w{j}": log for j, log in enumerate(self.logs.values())}) if self.logs else own

    def col(self, f: Formula, prefix: str = "c") -> Column:
        return F.col(f"{prefix}{self.number[f]}")

    def cells(self, f: Formula, prefix: str) -> list[Column]:
        return [F.col(f"{prefix}_{self.signals.index(s)}") for s in f.signals()]

    def frontier(self, f: Formula) -> Column:
        """The time up to which all signals of f are known, per key."""
        by = Window.partitionBy("key")
        if self.ends:
            ends = self.cells(f, "e") or [F.col("e")]
            return ends[0] if len(ends) == 1 else F.when(_all_known(ends), F.least(*ends))
        ends = [F.max(F.when(v.isNotNull(), F.col("t_us"))).over(by) for v in self.cells(f, "v")] or [F.max("t_us").over(by)]
        return ends[0] if len(ends) == 1 else F.when(_all_known(ends), F.least(*ends))

    def closing(self, f: Formula) -> Column:
        """The first arrival at or after the end of f's window, among f's signals."""
        least = lambda cols: cols[0] if len(cols) == 1 else F.least(*cols)
        first = F.min(least(self.cells(f, "q") or [F.col("seq")])).over(W.from_on(f.depth()))
        return F.least(first, least(self.cells(f, "z") or [F.col("z")])) if self.parts else first

    def arrival(self, f: Formula) -> Column:
        arrivals = self.cells(f, "q")
        return arrivals[0] if arrivals else F.col("seq")


def _chunked(plan: Plan, trace: DataFrame, synchronize: str, chunk: int) -> DataFrame:
    """The plan's table with keys (key, chunk); rows that follow a chunk within the depth come with it, not as its own."""
    depth = plan.formula.depth()
    width = max(chunk, depth + 1)
    rows = plan.table(trace, synchronize, ARRIVALS, width)
    last = [F.max(F.when(F.col(f"v_{i}").isNotNull(), F.col("t_us"))).alias(f"e_{i}") for i in range(len(plan.signals))] or [F.max("t_us").alias("e")]
    rows = rows.join(rows.groupBy("key").agg(*last), "key")
    plan.ends = True
    own = F.floor(F.col("t_us") / F.lit(width))
    in_both = F.col("t_us") - own * F.lit(width) <= depth
    copies = F.explode(F.when(in_both, F.array(own, own - 1)).otherwise(F.array(own)))
    rows = rows.select("*", own.alias("own"), copies.alias("chunk"))
    return rows.withColumns({"key": F.struct("key", "chunk"), "own": F.col("own") == F.col("chunk")}).drop("chunk")


def _all_known(cols: list[Column]) -> Column:
    out = cols[0].isNotNull()
    for c in cols[1:]:
        out = out & c.isNotNull()
    return out


def _limit(plan: Plan, f: Compare, bindings: Bindings | None) -> Column:
    if not isinstance(f.limit, str):
        return F.lit(f.limit)
    if f.limit in plan.logs:
        return F.col(f"w{list(plan.logs).index(f.limit)}_{plan.signals.index(f.signal)}")
    bound, arrival = (bindings or {})[f.limit], plan.arrival(f)
    if isinstance(bound, (int, float)):
        return F.lit(float(bound))
    out = F.lit(None).cast("double")
    for since, value in sorted(bound):
        out = F.when(arrival >= since, F.lit(float(value))).otherwise(out)
    return out


def _wide(f: Timed, block_from: int | None) -> bool:
    least = None if block_from is None else block_from // 10 if isinstance(f, Until) else block_from  # walks of until cost more than frames
    return least is not None and f.end - f.start >= max(least, 1)


def verdicts(trace: DataFrame, formula: Formula, domain: str | type = "rob", synchronize: str = "none", bindings: Bindings | None = None, until_from_start: bool = False, block_from: int | None = None, emission: bool = False, chunk: int | None = None) -> DataFrame:
    """(key, t_us, value) of every closed time, and ``at_seq``, the arrival that closed it, if ``emission``.

    until_from_start: let ``until`` accept its right side from t on, whatever its lower bound.
    block_from: robustness over windows of so many microseconds or more (until: of a tenth) is computed by blocks (see
    ``block_extreme`` and ``until_best``, which counts a block's rows by a job when the plan is made); narrower ones by frames.
    chunk: split each key's time into chunks of so many microseconds (no less than the formula's depth), which are
    evaluated on their own with the rows of the depth after them: one long trace then runs in many tasks.
    """
    d = DOMAINS[domain] if isinstance(domain, str) else domain
    plan = Plan.of(formula, bindings)
    if chunk is not None and emission:
        raise ValueError("emissions are not split by chunks")
    rows = plan.table(trace, synchronize) if chunk is None else _chunked(plan, trace, synchronize, chunk)
    for f in plan.number:
        c = f"c{plan.number[f]}"
        p = [plan.col(x) for x in f.parts]
        at: Column | None = None
        if isinstance(f, Constant):
            value, at = d.constant(f.value), F.col("seq")
        elif isinstance(f, Compare):
            (v,), at = plan.cells(f, "v"), plan.arrival(f)
            value = F.when(v.isNotNull(), d.compare(v, f.op, _limit(plan, f, bindings)))
        elif isinstance(f, Not):
            value, at = d.negate(p[0]), plan.col(f.part, "a")
        elif isinstance(f, (And, Or)):
            value, at = (d.both if isinstance(f, And) else d.either)(*p), F.greatest(plan.col(f.left, "a"), plan.col(f.right, "a"))
        elif isinstance(f, (Globally, Eventually)):
            least = isinstance(f, Globally)
            if d is Truth:
                best = W.truth_sweep(p[0], f.start, f.end, not least)
            elif _wide(f, block_from):
                rows = W.block_extreme(rows, f"c{plan.number[f.part]}", f.start, f.end, least, "_x")
                best = F.col("_x")
            else:
                best = (d.least if least else d.greatest)(p[0]).over(W.ahead(f.start, f.end))
            value, at = F.coalesce(best, d.constant(least)), plan.closing(f)
            value = F.when(p[0].isNotNull() & (F.col("t_us") + f.depth() <= plan.frontier(f)), value)
        else:
            begin = 0 if until_from_start else f.start
            if d is Truth:
                value = W.until_truth(*p, f.start, f.end, begin)
            elif _wide(f, block_from):
                rows, value = W.until_best(rows, *(f"c{plan.number[x]}" for x in f.parts), begin, f.end, "_x", d.constant(True), d.constant(False)), F.col("_x")
            else:
                value = W.until_fold(*p, begin, f.end, d.constant(True), d.constant(False))
            value = F.when(p[0].isNotNull() & p[1].isNotNull() & (F.col("t_us") + f.depth() <= plan.frontier(f)), value)
            at = plan.closing(f)
        rows = rows.withColumn(c, value)
        if emission:
            rows = rows.withColumn(f"a{plan.number[f]}", at)
        rows = rows.drop("_x")
    value = plan.col(plan.formula)
    out = rows.where(value.isNotNull())
    if chunk is not None:
        return out.where("own").select("key.key", "t_us", value.alias("value"))
    return out.select("key", "t_us", value.alias("value"), *([plan.col(plan.formula, "a").alias("at_seq")] if emission else []))


# -- eager ----------------------------------------------------------------------------


def _first_come(rows: DataFrame, plan: Plan, f: Formula) -> DataFrame:
    """Verdicts leave in order of time: none before those of earlier times, none after an undecided one."""
    c, a, k = f"c{plan.number[f]}", f"a{plan.number[f]}", "_task"
    values = {"_open": F.when(F.col(k) & F.col(c).isNull(), 1).otherwise(0), "_latest": F.when(F.col(c).isNotNull(), F.col(a))}
    if plan.parts:
        rows = running_max(rows, ["key"], "t_us", "_own", values)
    else:
        so_far = Window.partitionBy("key").orderBy("t_us").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({out: F.max(v).over(so_far) for out, v in values.items()})
    decided = (F.col("_open") == 0) & F.col(c).isNotNull()
    return rows.withColumns({c: F.when(decided, F.col(c)), a: F.when(decided, F.col("_latest"))}).drop("_open", "_latest", k)


def _in_parts(plan: Plan, trace: DataFrame, synchronize: str, chunk: int) -> DataFrame:
    """The plan's table with the part of each row, and the first arrivals after the part that follows."""
    width = max(chunk, plan.formula.depth() + 1)
    rows = plan.table(trace, synchronize, ARRIVALS, width).withColumn("_own", F.floor(F.col("t_us") / F.lit(width)))
    plan.parts = True
    arrivals = {f"z_{i}": F.min(f"q_{i}") for i in range(len(plan.signals))} or {"z": F.min("seq")}
    tops = rows.groupBy("key", "_own").agg(*(v.alias(c) for c, v in arrivals.items()))
    later = Window.partitionBy("key").orderBy(F.desc("_own")).rangeBetween(Window.unboundedPreceding, -2)
    return joined(rows, ["key"], "_own", tops.select("key", "_own", *(F.min(c).over(later).alias(c) for c in arrivals)))


def _spread(rows: DataFrame) -> DataFrame:
    """Each part together with the part after it: keys are (key, part) for the windows that look ahead."""
    return rows.withColumn("_part", F.explode(F.array(F.col("_own"), F.col("_own") - 1))).withColumn("key", F.struct("key", "_part")).drop("_part")


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("key._part") == F.col("_own")).withColumn("key", F.col("key.key"))


def eager(trace: DataFrame, formula: Formula, synchronize: str = "none", bindings: Bindings | None = None, chunk: int | None = None) -> DataFrame:
    """(key, t_us, value, at_seq): truth, and the arrival by which it was decided and could be given.

    chunk: split each key's time into parts of so many microseconds (no less than the formula's depth); windows see the next
    part as well, and whether a verdict of an earlier part is open, and the latest arrival so far, are carried over parts.
    """
    plan = Plan.of(formula, bindings)
    rows = plan.table(trace, synchronize) if chunk is None else _in_parts(plan, trace, synchronize, chunk)
    for f in plan.number:
        c, a = f"c{plan.number[f]}", f"a{plan.number[f]}"
        p, at = [plan.col(x) for x in f.parts], [plan.col(x, "a") for x in f.parts]
        if isinstance(f, Constant):
            rows = rows.withColumns({c: F.lit(f.value), a: F.col("seq")})
        elif isinstance(f, Compare):
            (v,) = plan.cells(f, "v")
            rows = rows.withColumns({c: F.when(v.isNotNull(), Truth.compare(v, f.op, _limit(plan, f, bindings))), a: plan.arrival(f)})
        elif isinstance(f, Not):
            rows = rows.withColumns({c: ~p[0], a: at[0]})
        elif isinstance(f, (And, Or)):
            z = isinstance(f, Or)  # the value that decides alone
            alone = [F.when(v == F.lit(z), x) for v, x in zip(p, at, strict=True)]
            one = F.coalesce(F.least(*alone), alone[0], alone[1])
            both = p[0].isNotNull() & p[1].isNotNull()
            task = p[0].isNotNull() | p[1].isNotNull()
            rows = rows.withColumns({c: F.when(one.isNotNull(), F.lit(z)).when(both, F.lit(not z)), a: F.when(one.isNotNull(), one).when(both, F.greatest(*at)), "_task": task})
            rows = _first_come(rows, plan, f)
        elif isinstance(f, (Globally, Eventually)):
            z = isinstance(f, Eventually)
            rows = _spread(rows) if plan.parts else rows
            rows = rows.withColumns({"_hit": _first_hit(plan, f, p[0] == F.lit(z), at[0]), "_close": plan.closing(f), "_task": p[0].isNotNull()})
            hit, close, task = F.col("_hit"), F.col("_close"), F.col("_task")
            soon = hit.isNotNull() & (close.isNull() | (hit <= close))
            rows = rows.withColumns({c: F.when(task & soon, F.lit(z)).when(task & close.isNotNull(), F.lit(not z)), a: F.when(soon, F.greatest(hit, at[0])).otherwise(F.greatest(close, at[0]))})
            rows = rows.drop("_hit", "_close")
            rows = _first_come(_gathered(rows) if plan.parts else rows, plan, f)
        else:
            rows = _eager_until(rows, plan, f)
    value = plan.col(plan.formula)
    return rows.where(value.isNotNull()).select("key", "t_us", value.alias("value"), plan.col(plan.formula, "a").alias("at_seq"))


def _in_order(plan: Plan, f: Formula) -> bool:
    """Whether f's values arrive in order of time: all do but constants among several signals, which come with any sample."""
    return len(plan.signals) < 2 or not isinstance(f, Constant)


def _first_hit(plan: Plan, f: Timed, cond: Column, at: Column) -> Column:
    """The least arrival of the window's rows where cond holds."""
    if not _in_order(plan, f.parts[0]):
        return F.min(F.when(cond, at)).over(W.ahead(f.start, f.end))
    first = W.first_from(cond, f.start, at.alias("at"))
    return F.when(first["t_us"] <= F.col("t_us") + F.lit(f.end), first["at"])


def _eager_until(rows: DataFrame, plan: Plan, f: Until) -> DataFrame:
    """True once the right side, with the left up to it, has arrived; false once the left fails first, or all has passed.

    Values arrive in order of time, so of the window's rows the first that decides is also the first to
    arrive, and frames that only grow find it.
    """
    c, a = f"c{plan.number[f]}", f"a{plan.number[f]}"
    (l, r), (la, ra) = [plan.col(x) for x in f.parts], [plan.col(x, "a") for x in f.parts]
    for side, g in zip((0, 1), f.parts, strict=True):
        if not _in_order(plan, g):  # a constant is there with the other side
            la, ra = (F.coalesce(ra, la), ra) if side == 0 else (la, F.coalesce(la, ra))
    rows = _spread(rows) if plan.parts else rows
    stop = W.first_from((l.isNotNull() | r.isNotNull()) & (l.isNull() | ~l), 0, (~l).alias("fails"), la.alias("at"))
    met = W.first_from(l & r, f.start, F.greatest(la, ra).alias("at"))
    rows = rows.withColumns({"_stop": stop, "_met": met, "_close": plan.closing(f), "_task": l.isNotNull() & r.isNotNull(), "_mine": F.greatest(F.coalesce(la, ra), F.coalesce(ra, la))})
    end = F.col("t_us") + F.lit(f.end)
    true_at = F.when((F.col("_met.t_us") <= end) & (F.col("_stop").isNull() | (F.col("_met.t_us") < F.col("_stop.t_us"))), F.col("_met.at"))
    false_at = F.when((F.col("_stop.t_us") <= end) & F.col("_stop.fails"), F.greatest("_stop.at", "_mine"))
    rows = rows.withColumns({"_true": true_at, "_first": F.least(true_at, false_at, F.col("_close"))})
    rows = rows.withColumns({c: F.when(F.col("_task") & F.col("_first").isNotNull(), F.coalesce(F.col("_true") == F.col("_first"), F.lit(False))), a: F.greatest("_first", "_mine")})
    rows = rows.drop("_stop", "_met", "_close", "_mine", "_true", "_first")
    return _first_come(_gathered(rows) if plan.parts else rows, plan, f)


# -- intervals ------------------------------------------------------------------------


def _intervals(rows: DataFrame, plan: Plan, bindings: Bindings | None, block_from: int | None = None) -> DataFrame:
    """Adds l<k>, h<k>, the robustness interval of each subformula on the rows of a key."""
    for f in plan.number:
        k = plan.number[f]
        lo, hi = [plan.col(x, "l") for x in f.parts], [plan.col(x, "h") for x in f.parts]
        closed = F.coalesce(F.col("t_us") + f.depth() <= plan.frontier(f), F.lit(False))
        if isinstance(f, Constant):
            out = (Robustness.constant(f.value),) * 2
        elif isinstance(f, Compare):
            (v,) = plan.cells(f, "v")
            out = (F.when(v.isNotNull(), Robustness.compare(v, f.op, _limit(plan, f, bindings))),) * 2
        elif isinstance(f, Not):
            out = (-hi[0], -lo[0])
        elif isinstance(f, (And, Or)):
            join = Robustness.both if isinstance(f, And) else Robustness.either
            out = (join(*lo), join(*hi))
        elif isinstance(f, (Globally, Eventually)):
            least = isinstance(f, Globally)
            best = Robustness.least if least else Robustness.greatest
            found = [best(x[0]).over(W.ahead(f.start, f.end)) for x in (lo, hi)]
            if _wide(f, block_from):
                for side in "lh":
                    rows = W.block_extreme(rows, f"{side}{plan.number[f.part]}", f.start, f.end, least, f"_x{side}")
                found = [F.col("_xl"), F.col("_xh")]
            low, high = (F.coalesce(x, Robustness.constant(least)) for x in found)
            low = F.when(closed, low).otherwise(F.lit(-INF)) if least else low
            high = high if least else F.when(closed, high).otherwise(F.lit(INF))
            out = tuple(F.when(lo[0].isNotNull(), x) for x in (low, high))
        else:
            low, high = (W.until_fold(*x, f.start, f.end) for x in (lo, hi))
            if _wide(f, block_from):
                for side in "lh":
                    rows = W.until_best(rows, *(f"{side}{plan.number[x]}" for x in f.parts), f.start, f.end, f"_x{side}")
                low, high = F.col("_xl"), F.col("_xh")
            out = tuple(F.when(lo[0].isNotNull() & lo[1].isNotNull(), x) for x in (low, F.when(closed, high).otherwise(F.lit(INF))))
        rows = rows.withColumns({f"l{k}": out[0], f"h{k}": out[1]}).drop("_xl", "_xh")
    return rows


def intervals(trace: DataFrame, formula: Formula, synchronize: str = "none", bindings: Bindings | None = None, block_from: int | None = None) -> DataFrame:
    """(key, t_us, lo, hi): robustness intervals on all that the trace holds; lo = hi once closed.

    block_from: as for ``verdicts``.
    """
    plan = Plan.of(formula, bindings)
    rows = _intervals(plan.table(trace, synchronize), plan, bindings, block_from)
    lo, hi = plan.col(plan.formula, "l"), plan.col(plan.formula, "h")
    return rows.where(lo.isNotNull()).select("key", "t_us", lo.alias("lo"), hi.alias("hi"))


def interval_trace(trace: DataFrame, formula: Formula, synchronize: str = "none", bindings: Bindings | None = None) -> DataFrame:
    """(key, now_us, t_us, lo, hi): the interval of each t as known at each later time of its window.

    Every time meets the times of the formula's depth before it, by a join on key and time bucket:
    rows grow with samples per window, so this is for inspection and short windows.
    """
    plan = Plan.of(formula, bindings)
    rows = plan.table(trace, synchronize)
    depth = max(plan.formula.depth(), 1)
    # at ``now``, times before now - depth are settled; their operands reach back no further
    bucket = F.floor(F.col("t_us") / F.lit(depth))
    nows = rows.select(F.col("key").alias("k"), F.col("t_us").alias("now_us"), F.explode(F.array(bucket, bucket - 1)).alias("b"))
    near = (F.col("key") == F.col("k")) & (F.col("_b") == F.col("b")) & (F.col("t_us") <= F.col("now_us")) & (F.col("t_us") >= F.col("now_us") - F.lit(depth))
    seen = rows.withColumn("_b", bucket).join(nows, near)
    seen = seen.withColumn("key", F.struct(F.col("k").alias("key"), "now_us")).drop("k", "now_us", "_b", "b")
    out = _intervals(seen, plan, bindings)
    lo, hi = plan.col(plan.formula, "l"), plan.col(plan.formula, "h")
    return out.where(lo.isNotNull()).select("key.key", "key.now_us", "t_us", lo.alias("lo"), hi.alias("hi"))
