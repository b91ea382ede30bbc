"""Refinements of robustness intervals as changes: a row only where a time's interval is another than before.

The trace of all refinements grows with samples times window; its changes don't.  Each key's time is cut into
chunks, which run on their own with the rows of the formula's depth after them and, for what
comes later, the time at which each signal next passes that: windows of the chunk close by these.  In a chunk the rows are
taken in order of time.  A sample lowers the running extreme only of the times that reach it and lie above
it, and each connective looks at the times whose parts have changed.  A task takes its chunks together, the
n-th row of each at a time, so that short chunks of many keys cost no more than their rows.  Samples are
exchanged once, by chunk: which come too late, and which share a time, shows there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.algebra import Robustness
from tempora.operators.carry import ARRIVALS
from tempora.operators.evaluate import Bindings, Plan, _limit
from tempora.operators.sync import STRATEGIES
from tempora.plans.formula import And, Compare, Constant, Eventually, Formula, Globally, Not, Or, Timed

INF = float("inf")
NONE = np.zeros(0, np.int64)
UNSEEN = np.iinfo(np.int64).min  # the last time of a signal without rows
TOGETHER = 100_000  # rows of the chunks that a task takes together, about
WALKED = 1_000_000  # cells of the walks of ``until`` at a time


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The places lo..hi-1 of each pair, one after the other."""
    size = np.maximum(hi - lo, 0)
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _places(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, time: np.ndarray, right: bool = False) -> np.ndarray:
    """The place of each time among t[lo:hi], as of searchsorted."""
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = t[np.where(open_, mid, 0)]
        after = open_ & ((at <= time) if right else (at < time))
        lo, hi = np.where(after, mid + 1, lo), np.where(open_ & ~after, mid, hi)
    return lo


class _Chunks:
    """Rows of several chunks, each in order of time; chunk k holds the rows base[k]..base[k + 1] - 1."""

    def __init__(self, t: np.ndarray, base: np.ndarray):
        self.t, self.base = t, base
        self.of = np.repeat(np.arange(len(base) - 1), np.diff(base))
        self.begin, self.end = base[:-1][self.of], base[1:][self.of]
        self.now = base[:-1].copy()  # the row that each chunk has come to
        self.mark = np.zeros(len(t), np.int64)

    def place(self, time: np.ndarray, right: bool = False) -> np.ndarray:
        return _places(self.t, self.begin, self.end, time, right)

    def distinct(self, *rows: np.ndarray) -> np.ndarray:
        rows = np.concatenate(rows)
        number = np.arange(len(rows))
        self.mark[rows] = number
        return rows[self.mark[rows] == number]


class _Part:
    """A subformula on the rows of the chunks: its interval at each row, as known so far (nan: none)."""

    def __init__(self, f: Formula, c: _Chunks, signals: list[int]):
        self.f, self.c, self.signals = f, c, signals
        n, t = len(c.t), c.t
        self.lo, self.hi = np.full(n, np.nan), np.full(n, np.nan)
        if isinstance(f, Timed):
            self.closed = c.base[:-1].copy()  # rows of a chunk before this one are closed
            least = isinstance(f, Globally)
            self.none = INF if least else -INF
            self.best, self.run = np.full(n, self.none), np.full(n, INF)
            self.other = np.full(n, -INF if least else INF)  # the bound that a closed window sets
            # the rows whose windows begin at or before, and end at or after, each row
            self.first, self.last = c.place(t - f.end), c.place(t - f.start, True)
            self.begin, self.end = c.place(t + f.start), c.place(t + f.end, True)

    def put(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sets intervals; the rows that change by it."""
        new = ~np.isnan(lo) & ((lo != self.lo[rows]) | (hi != self.hi[rows]))
        rows = rows[new]
        self.lo[rows], self.hi[rows] = lo[new], hi[new]
        return rows

    def newly_closed(self, chunks: np.ndarray, ends: np.ndarray, now: np.ndarray) -> np.ndarray:
        known = ends[chunks][:, self.signals].min(axis=1) if self.signals else now
        seen = known != UNSEEN
        chunks, known = chunks[seen], known[seen]
        was = self.closed[chunks]
        self.closed[chunks] = _places(self.c.t, was, self.c.base[chunks + 1], known - self.f.depth(), True)
        return _spans(was, self.closed[chunks])


def _sweep(me: _Part, p: _Part, changed: np.ndarray, closed: np.ndarray) -> np.ndarray:
    least = isinstance(me.f, Globally)
    best, side = (np.minimum, p.hi) if least else (np.maximum, p.lo)
    a, e = me.first[changed], me.last[changed]
    reach = _spans(a, e)
    best.at(me.best, reach, np.repeat(side[changed], np.maximum(e - a, 0)))
    fresh = closed[~np.isnan(p.lo[closed])]
    a, e = me.begin[fresh], me.end[fresh]
    some = a < e
    if some.any():  # what the other bound comes to in a closed window
        rest = (p.lo if least else p.hi)[_spans(a[some], e[some])]
        size = (e - a)[some]
        me.other[fresh[some]] = best.reduceat(np.where(np.isnan(rest), me.none, rest), np.cumsum(size) - size)
    me.other[fresh[~some]] = me.none
    rows = me.c.distinct(reach, changed, closed)
    rows = rows[~np.isnan(p.lo[rows])]
    known, other = me.best[rows], me.other[rows]
    return me.put(rows, *((other, known) if least else (known, other)))


def _walks(left: np.ndarray, right: np.ndarray, rows: np.ndarray, end: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Best over the rows of row..end-1 from ``begin`` on of right and the least left up to there; rows without either count for nothing."""
    out, size = np.full(len(rows), -INF), end - rows
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    while len(order):  # the longest first, as many as fit beside it
        some = order[-max(1, WALKED // int(size[order[-1]])) :]
        order = order[: -len(some)]
        step = np.arange(int(size[some[-1]]))
        at = rows[some][:, None] + step
        inside = step < size[some][:, None]
        at = np.where(inside, at, 0)
        x, y = left[at], right[at]
        ok = inside & ~np.isnan(x) & ~np.isnan(y)
        run = np.minimum.accumulate(np.where(ok, x, INF), axis=1)
        best = np.minimum(run, np.where(ok & (at >= begin[some][:, None]), y, -INF))
        out[some] = best.max(axis=1)
    return out


def _until(me: _Part, p: list[_Part], changed: np.ndarray, closed: np.ndarray, final: bool) -> np.ndarray:
    """final: the operands are known for good as they arrive, one row of a chunk at a time, so that running values do."""
    left, right = p
    live = changed[~np.isnan(left.lo[changed]) & ~np.isnan(right.lo[changed])]
    a, e = me.first[live], me.last[live]
    reach = _spans(a, live + 1)
    if final:
        me.run[reach] = np.minimum(me.run[reach], np.repeat(left.lo[live], live + 1 - a))
        met = _spans(a, e)
        me.best[met] = np.maximum(me.best[met], np.minimum(np.repeat(right.lo[live], np.maximum(e - a, 0)), me.run[met]))
    rows = me.c.distinct(reach, closed)
    rows = rows[~np.isnan(left.lo[rows]) & ~np.isnan(right.lo[rows])]
    own = me.c.of[rows]
    if not final:
        me.best[rows] = _walks(left.lo, right.lo, rows, np.minimum(me.end[rows], me.c.now[own] + 1), me.begin[rows])
    high, done = np.full(len(rows), INF), rows < me.closed[own]
    shut = rows[done]
    high[done] = me.best[shut] if final else _walks(left.hi, right.hi, shut, me.end[shut], me.begin[shut])
    return me.put(rows, me.best[rows], high)


def _changes(plan: Plan, t: np.ndarray, base: np.ndarray, own: np.ndarray, known: list[np.ndarray], margins: dict[Formula, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(now, row, lo, hi) of the changes at the chunks' own rows; known: which signals each row moves on."""
    c = _Chunks(t, base)
    parts = {f: _Part(f, c, [plan.signals.index(s) for s in f.signals()]) for f in plan.number}
    timeless = {f for f in plan.number if not any(isinstance(x, Timed) for x in f.walk())}
    ends = np.full((len(base) - 1, len(known)), UNSEEN)
    size = np.diff(base)
    order = np.argsort(-size, kind="stable")  # the chunks that have an n-th row come first
    counts = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))))
    out: list[tuple] = []
    for step, n in enumerate(counts.tolist()):
        chunks = order[:n]
        here = base[chunks] + step
        c.now[chunks] = here
        for i, k in enumerate(known):
            moves = k[here]
            ends[chunks[moves], i] = t[here[moves]]
        moved: dict[Formula, np.ndarray] = {}
        for f in plan.number:
            me, p = parts[f], [parts[x] for x in f.parts]
            if isinstance(f, Constant):
                rows = here[margins[f][here]]
                moved[f] = me.put(rows, *[np.full(len(rows), INF if f.value else -INF)] * 2)
            elif isinstance(f, Compare):
                moved[f] = me.put(here, *[margins[f][here]] * 2)
            elif isinstance(f, Not):
                rows = moved[f.part]
                moved[f] = me.put(rows, -p[0].hi[rows], -p[0].lo[rows])
            elif isinstance(f, (And, Or)):
                rows = c.distinct(*(moved[x] for x in f.parts))
                join = np.minimum if isinstance(f, And) else np.maximum  # nan of either side stays
                moved[f] = me.put(rows, join(p[0].lo[rows], p[1].lo[rows]), join(p[0].hi[rows], p[1].hi[rows]))
            else:
                changed, closed = c.distinct(*(moved[x] for x in f.parts)), me.newly_closed(chunks, ends, t[here])
                if not len(changed) and not len(closed):
                    moved[f] = NONE
                elif isinstance(f, (Globally, Eventually)):
                    moved[f] = _sweep(me, p[0], changed, closed)
                else:
                    moved[f] = _until(me, p, changed, closed, all(x in timeless for x in f.parts))
        rows = moved[plan.formula]
        rows = rows[own[rows]]
        if len(rows):
            top = parts[plan.formula]
            out.append((t[c.now[c.of[rows]]], rows, top.lo[rows], top.hi[rows]))
    if not out:
        return NONE, NONE, np.zeros(0), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _whole(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Whole chunks together, of so many rows or a few more; n counts a chunk's rows from 1."""
    held, rows = [], 0
    for b in batches:
        if rows + b.num_rows >= least and len(begins := np.flatnonzero(b.column("n").to_numpy() == 1)):
            cut = int(begins[-1])
            if rows + cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, rows, b = [], 0, b.slice(cut)
        held.append(b)
        rows += b.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _on_time(chunk: np.ndarray, arrival: np.ndarray, moves: list[np.ndarray]) -> list[np.ndarray]:
    """For each signal, where its samples are that arrived before all later ones of the chunk; rows in order of time, then from the last arrival to the first."""
    order = np.unique(arrival, return_inverse=True)[1]
    place = order + chunk * np.int64(len(order) + 1)  # later chunks lie above
    out = []
    for k in moves:
        own = np.flatnonzero(k)
        mine = place[own]
        kept = k.copy()
        kept[own] = mine == np.minimum.accumulate(mine[::-1])[::-1]
        out.append(kept)
    return out


def _samples(plan: Plan, trace: DataFrame, synchronize: str, width: int) -> DataFrame:
    """key, t_us, the columns of the plan's signals, and the arrival by which a row may come too late.

    Signals that are not aligned stay samples of their own, late ones too: tasks drop these and join signals
    of one time.  Rows of any other table are all on time.
    """
    if plan.signals and (synchronize == "none" or len(plan.signals) == 1):
        if synchronize not in STRATEGIES:
            raise ValueError(f"synchronize is one of {STRATEGIES}")
        own = plan.arrived(trace)
        cells = [F.when(F.col("signal") == s, F.col(c)).alias(f"{p}_{i}") for i, s in enumerate(plan.signals) for p, c in [("v", "value"), ("q", "seq"), *((f"w{j}",) * 2 for j in range(len(plan.logs)))]]
        return own.select("key", "t_us", F.coalesce(F.col("seq").cast("long"), F.lit(UNSEEN)).alias("arrival"), *cells)
    rows = plan.table(trace, synchronize, ARRIVALS, width) if plan.signals else trace
    return rows.withColumn("arrival", F.col("t_us"))


def _ends(rows: DataFrame, own: Column, width: int, depth: int, signals: int) -> DataFrame:
    """(key, chunk, t_us, arrival, k0, ..): each signal's first sample to arrive of those after what a chunk sees.

    Samples after that one are later, those within sight that arrive after it come too late.  What each part of a key's
    time holds is a row of a small table, in which windows look at the parts that follow.
    """
    beyond = F.col("t_us") - F.col("part") * F.lit(width) > depth  # what the chunk before does not see of a part
    firsts = lambda name, of: [F.min(F.when(of, F.col("arrival"))).alias(f"a_{name}"), F.min_by("t_us", F.when(of, F.col("arrival"))).alias(f"t_{name}")]
    parts = rows.withColumn("part", own).groupBy("key", "part").agg(*(c for i in range(signals) for c in (*firsts(f"{i}", F.col(f"k{i}")), *firsts(f"rest_{i}", F.col(f"k{i}") & beyond))))
    back = Window.partitionBy("key").orderBy(F.col("back"))
    next_, later = back.rangeBetween(-1, -1), back.rangeBetween(Window.unboundedPreceding, -2)
    first = []
    for i in range(signals):
        found = [F.struct(F.min(f"a_{n}").over(w).alias("arrival"), F.min_by(f"t_{n}", f"a_{n}").over(w).alias("t_us")) for n, w in ((f"rest_{i}", next_), (f"{i}", later))]
        first.append(F.struct(F.lit(i).alias("i"), *(F.col(f"{side}_{i}.{c}").alias(f"{c}_{side}") for side in ("next", "later") for c in ("arrival", "t_us"))))
        parts = parts.withColumn("back", -F.col("part")).withColumns({f"next_{i}": found[0], f"later_{i}": found[1]})
    z = parts.select("key", F.col("part").alias("chunk"), F.explode(F.array(*first)).alias("z"))
    soon = F.coalesce(F.col("z.arrival_next") <= F.col("z.arrival_later"), F.col("z.arrival_next").isNotNull())
    of = lambda c: F.when(soon, F.col(f"z.{c}_next")).otherwise(F.col(f"z.{c}_later")).alias(c)
    return z.select("key", "chunk", of("t_us"), of("arrival"), *((F.col("z.i") == i).alias(f"k{i}") for i in range(signals))).where("t_us is not null")


def refinements(trace: DataFrame, formula: Formula, synchronize: str = "none", bindings: Bindings | None = None, chunk: int | None = None) -> DataFrame:
    """(key, now_us, t_us, lo, hi): the interval of each t when first known, and at each later time that changes it.

    Later times go on until all windows are closed (lo = hi).  chunk: microseconds of a key's time in one task, with the
    formula's depth after them (unless given, 32 depths).
    """
    plan = Plan.of(formula, bindings)
    depth = plan.formula.depth()
    width = max(chunk or 32 * (depth + 1), depth + 1)
    rows = _samples(plan, trace, synchronize, width)
    kind = trace.schema["key"].dataType.simpleString()
    atoms = [f for f in plan.number if isinstance(f, Compare)]
    margin = [F.when(F.col(f"v_{plan.signals.index(f.signal)}").isNotNull(), Robustness.compare(F.col(f"v_{plan.signals.index(f.signal)}"), f.op, _limit(plan, f, bindings))).alias(f"m{k}") for k, f in enumerate(atoms)]
    moves = [F.col(f"v_{i}").isNotNull().alias(f"k{i}") for i in range(len(plan.signals))] or [F.lit(True).alias("k0")]
    some = len(moves)
    rows = rows.select("key", "t_us", "arrival", *moves, *margin)
    own = F.expr(f"(t_us - pmod(t_us, {width}L)) div {width}L")  # exact, as in the tasks
    copies = F.explode(F.when(F.col("t_us") - own * F.lit(width) <= depth, F.array(own, own - 1)).otherwise(F.array(own))).alias("chunk")
    seen = rows.select("*", copies).unionByName(_ends(rows, own, width, depth, some), allowMissingColumns=True)

    plain = replace(plan, logs={})  # tasks get no tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, TOGETHER):
            begins = rows.column("n").to_numpy() == 1
            t = rows.column("t_us").to_numpy()
            moves = [rows.column(f"k{i}").to_numpy() for i in range(some)]
            on_time = _on_time(np.cumsum(begins), rows.column("arrival").to_numpy(), moves)
            new = begins.copy()
            new[1:] |= t[1:] != t[:-1]
            at = np.flatnonzero(new)  # of rows of one time, in which several signals move, one is left
            own = t[at] // width - rows.column("chunk").to_numpy()[at]  # 0 in the chunk, 1 within the depth after it, or beyond what it sees
            real = t[at] - (t[at] // width - own + 1) * width <= depth
            any_of = lambda x: np.logical_or.reduceat(x, at)
            margins: dict[Formula, np.ndarray] = {f: real for f in plain.number if isinstance(f, Constant)}
            for k, f in enumerate(atoms):
                m = rows.column(f"m{k}").cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False)
                margins[f] = np.fmax.reduceat(np.where(on_time[plain.signals.index(f.signal)], m, np.nan), at)
            base = np.append(np.flatnonzero(begins[at]), len(at))
            now, row, lo, hi = _changes(plain, t[at], base, own == 0, [any_of(x) for x in on_time], margins)
            keys = rows.column("key").combine_chunks().take(pa.array(at[row]))
            yield pa.RecordBatch.from_arrays([keys, pa.array(now), pa.array(t[at[row]]), pa.array(lo), pa.array(hi)], names=["key", "now_us", "t_us", "lo", "hi"])

    by = Window.partitionBy("key", "chunk").orderBy("t_us", F.desc("arrival"))  # a chunk's rows come in this order, one chunk after the other
    return seen.withColumn("n", F.row_number().over(by)).mapInArrow(run, f"key {kind}, now_us long, t_us long, lo double, hi double")
