"""Push monitoring as a keyed state operator: samples in, verdicts out, as one streaming DataFrame.

``KeyedMonitor.verdicts`` adds a ``transformWithState`` operator to a stream of samples.  Spark's state store
holds, per key, the samples whose windows are still open, the last sample of each signal before
them (for alignment, and to tell late samples), and what has left for open times: rows bounded by the samples
of the formula's depth.  Nothing is rewritten but what a key's new samples touch, and a restart goes
on from the checkpoint.

How windows close:

- by data (``lateness`` unset): samples count as they arrive, those that are not later than their signal's last one are
  dropped, and a window closes when all its signals have passed it, as in the batch plans;
- by time (``lateness`` set, microseconds): samples may arrive in any order up to so much behind the latest; they count, in
  order of time, once the watermark has passed them, and a window closes when the watermark has passed
  its end, by an event-time timer where no further sample comes.  Aligned signals wait for their next sample.
  Spark's watermark begins at the epoch: samples of 1970 and before are late from the start.

Replayed samples (at-least-once sources) are known by key, signal, arrival and time; ``replayed`` drops
them within the watermark before they reach the operator, and either way of closing drops them otherwise.

The state needs Spark's RocksDB provider, which ``start`` sets for its query.  ``idle`` (microseconds, closing by data only)
lets the state of keys go that bring nothing for so long on the clock.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tempora.operators.evaluate import Bindings, Plan
from tempora.operators.sync import STRATEGIES
from tempora.plans.formula import And, Compare, Constant, Eventually, Formula, Globally, Not, Or, Timed
from tempora.streaming.latest import LatestVerdicts

SEMANTICS = ("delayed_bool", "delayed_rob", "interval")
INF = float("inf")
NEVER = np.iinfo(np.int64).min


PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The stream with samples that come again (same key, signal, arrival and time) left out, as long as the watermark has not passed them."""
    timed = stream.withColumn("_time", F.timestamp_micros("t_us")).withWatermark("_time", lateness)
    return timed.dropDuplicatesWithinWatermark(["key", "signal", "seq", "t_us"]).drop("_time")


# -- the open rows of one key ---------------------------------------------------------


class Open:
    """A key's samples as aligned rows: times, and value and arrival of each signal (nan: none)."""

    def __init__(self, samples: pd.DataFrame | dict[str, np.ndarray], n_signals: int, synchronize: str):
        signal, *cells = (np.asarray(samples[c]) for c in ("signal", "t_us", "value", "seq"))
        self.t = np.unique(cells[0].astype(np.int64))
        self.value, self.arrival, self.ends = [], [], []
        t, seconds = self.t, self.t / 1_000_000
        for i in range(n_signals):
            at, v, q = (c[signal == i] for c in cells)
            order = np.argsort(at, kind="stable")
            at, v, q = at[order], v[order], q[order]
            value, arrival = np.full(len(t), np.nan), np.zeros(len(t), np.int64)
            here = np.searchsorted(t, at)
            value[here], arrival[here] = v, q
            self.ends.append(int(at[-1]) if len(at) else None)
            if synchronize != "none" and n_signals > 1 and len(at) > 1:
                after = np.searchsorted(at, t)
                gap = np.isnan(value) & (after > 0) & (after < len(at))
                b = after[gap]
                if synchronize == "linear":
                    share = ((t[gap] - at[b - 1]) / 1_000_000) / ((at[b] - at[b - 1]) / 1_000_000)
                    value[gap] = v[b - 1] + (v[b] - v[b - 1]) * share
                else:
                    value[gap] = v[b - 1]
                arrival[gap] = q[b]
            self.value.append(value)
            self.arrival.append(arrival)


def _extreme(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: bool, none: float) -> np.ndarray:
    """Extreme of x[lo:hi] for each pair of places; x without nan."""
    best, out = (np.minimum if least else np.maximum), np.full(len(lo), none)
    size = hi - lo
    level, table = 0, x
    while (1 << level) <= int(size.max(initial=0)):
        here = (size >> level) == 1
        if here.any():
            out[here] = best(best(table[lo[here]], table[hi[here] - (1 << level)]), none)
        if len(table) <= 1 << level:
            break
        table = best(table[: -(1 << level)], table[1 << level :])
        level += 1
    return out


def _until(t: np.ndarray, left: np.ndarray, right: np.ndarray, start: int, end: int, bottom: float) -> np.ndarray:
    known = np.flatnonzero(~np.isnan(left) & ~np.isnan(right))
    out, at, low, high = np.full(len(t), np.nan), t[known], left[known], right[known]
    last = np.searchsorted(at, at + end, "right")
    for k, (i, j) in enumerate(zip(known.tolist(), last.tolist(), strict=True)):
        begin = int(np.searchsorted(at, at[k] + start))
        run = np.minimum.accumulate(low[k:j])
        out[i] = max(bottom, np.minimum(high[begin:j], run[begin - k :]).max(initial=bottom))
    return out


def closed_at(plan: Plan, rows: Open, f: Formula, frontier: int | None) -> np.ndarray:
    """Whether all signals of f have passed the end of its window at each row."""
    ends = [rows.ends[plan.signals.index(s)] for s in f.signals()] or [int(rows.t[-1]) if len(rows.t) else None]
    known = frontier if frontier is not None else None if None in ends else min(ends)
    return np.zeros(len(rows.t), bool) if known is None else rows.t + f.depth() <= known


def final_at(plan: Plan, rows: Open, f: Formula, frontier: int | None) -> np.ndarray:
    """Whether a row's verdict can change no more: the outermost windows of f are closed, each on its own signals."""
    if isinstance(f, (Not, And, Or)):
        return np.logical_and.reduce([final_at(plan, rows, p, frontier) for p in f.parts])
    return closed_at(plan, rows, f, frontier) if isinstance(f, Timed) else np.ones(len(rows.t), bool)


def bounds_of(plan: Plan, rows: Open, bindings: Bindings | None, truth: bool, frontier: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value the formula can take at each row, nan where it has none; equal once closed.

    truth: 0 and 1 instead of robustness.  frontier: time up to which all is known (none: each signal's last sample).
    """
    bottom, top = (0.0, 1.0) if truth else (-INF, INF)
    t, found = rows.t, {}
    for f in plan.number:
        own, closed, p = [plan.signals.index(s) for s in f.signals()], closed_at(plan, rows, f, frontier), [found[x] for x in f.parts]
        if isinstance(f, Constant):
            lo = hi = np.full(len(t), top if f.value else bottom)
        elif isinstance(f, Compare):
            v, limit = rows.value[own[0]], f.limit
            if isinstance(limit, str):
                bound = (bindings or {})[limit]
                log = [(-(2**62), float(bound))] if isinstance(bound, (int, float)) else sorted(bound)
                place = np.searchsorted([s for s, _ in log], rows.arrival[own[0]], "right")
                limit = np.array([np.nan, *(float(x) for _, x in log)])[place]
            margin = v - limit if f.op == ">" else limit - v
            lo = hi = np.where(np.isnan(margin), np.nan, margin > 0) if truth else margin
        elif isinstance(f, Not):
            lo, hi = (1 - p[0][1], 1 - p[0][0]) if truth else (-p[0][1], -p[0][0])
        elif isinstance(f, (And, Or)):
            join = np.minimum if isinstance(f, And) else np.maximum  # nan of either side stays
            lo, hi = join(p[0][0], p[1][0]), join(p[0][1], p[1][1])
        elif isinstance(f, (Globally, Eventually)):
            least = isinstance(f, Globally)
            none = top if least else bottom
            a, b = np.searchsorted(t, t + f.start), np.searchsorted(t, t + f.end, "right")
            lo, hi = (_extreme(np.where(np.isnan(x), none, x), a, b, least, none) for x in p[0])
            lo, hi = (np.where(closed, lo, bottom), hi) if least else (lo, np.where(closed, hi, top))
            lo, hi = (np.where(np.isnan(p[0][0]), np.nan, x) for x in (lo, hi))
        else:
            lo, hi = (_until(t, p[0][k], p[1][k], f.start, f.end, bottom) for k in (0, 1))
            hi = np.where(closed | np.isnan(hi), hi, top)
        found[f] = (lo, hi)
    return found[plan.formula]


# -- the operator ---------------------------------------------------------------------

_SAMPLE = np.dtype([("signal", "<i8"), ("t_us", "<i8"), ("value", "<f8"), ("seq", "<i8")])
_LEAVES = np.dtype([("t_us", "<i8"), ("lo", "<f8"), ("hi", "<f8")])


def _packed(samples: np.ndarray, left: np.ndarray, bound: int | None) -> bytes:
    return np.array([len(samples), bound is not None, bound or 0], "<i8").tobytes() + samples.tobytes() + left.tobytes()


def _unpacked(raw: bytes | None) -> tuple[np.ndarray, np.ndarray, int | None]:
    if raw is None:
        return np.zeros(0, _SAMPLE), np.zeros(0, _LEAVES), None
    n, bounded, bound = np.frombuffer(raw, "<i8", 3).tolist()
    cut = 24 + n * _SAMPLE.itemsize
    return np.frombuffer(raw[24:cut], _SAMPLE), np.frombuffer(raw[cut:], _LEAVES), bound if bounded else None


class _Processor(StatefulProcessor):
    def __init__(self, monitor: KeyedMonitor):
        self.monitor = monitor

    def init(self, handle) -> None:
        self.handle = handle
        m = self.monitor
        ttl = None if m.idle is None else m.idle // 1000
        self.state = handle.getValueState("open", "rows binary", ttl)  # one value, as each call of the store costs more than a key's rows
        self.plan = Plan.of(m.formula, m.bindings)
        self.number = {s: i for i, s in enumerate(self.plan.signals)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.concatenate([self._samples(r) for r in rows])
        yield from self._step(key, new, timerValues)

    def _samples(self, rows: pd.DataFrame) -> np.ndarray:
        signal = np.array([self.number.get(s, -1) for s in rows["signal"].tolist()] if self.number else [0] * len(rows), np.int64)
        ok = (signal >= 0) & rows["t_us"].notna().to_numpy() & rows["value"].notna().to_numpy()
        out = np.zeros(int(ok.sum()), _SAMPLE)
        out["signal"] = signal[ok]
        for c in ("t_us", "value", "seq"):
            out[c] = rows[c].to_numpy()[ok]
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, None, timerValues)

    def close(self) -> None:
        pass

    def _step(self, key, new: np.ndarray | None, timers) -> Iterator[pd.DataFrame]:
        m, depth = self.monitor, self.plan.formula.depth()
        raw = self.state.get()
        held, leaves, bound = _unpacked(None if raw is None else bytes(raw[0]))
        now = None if m.lateness is None else timers.getCurrentWatermarkInMs() * 1000
        signals = range(max(1, len(self.plan.signals)))
        if new is not None and len(new):
            if now is None:  # in order of arrival, each later than its signal's last
                new = new[np.argsort(new["seq"], kind="stable")]
                later = np.zeros(len(new), bool)
                for i in signals:
                    own = np.flatnonzero(new["signal"] == i)
                    t, last = new["t_us"][own], held["t_us"][held["signal"] == i]
                    before = np.maximum.accumulate(np.concatenate([[last.max() if len(last) else NEVER], t]))[:-1]
                    later[own] = t > before
                new = new[later]
            held = np.concatenate([held, new])
            if now is not None:  # one sample a signal and time, that of the least arrival
                held = held[np.lexsort((held["seq"], held["signal"], held["t_us"]))]
                again = (held["t_us"][1:] == held["t_us"][:-1]) & (held["signal"][1:] == held["signal"][:-1])
                held = held[np.concatenate([[True], ~again])] if len(held) else held
        sure = held if now is None else held[held["t_us"] <= now]
        rows = Open(sure, len(signals), m.synchronize)
        frontier = now if now is not None and (m.synchronize == "none" or len(self.plan.signals) < 2) else None
        lo, hi = bounds_of(self.plan, rows, m.bindings, m.semantics == "delayed_bool", frontier)
        open_ = ~np.isnan(lo)
        if bound is not None:
            open_ &= rows.t > bound
        left = {t: (a, b) for t, a, b in leaves.tolist()}
        delayed = m.semantics != "interval"
        final = final_at(self.plan, rows, self.plan.formula, frontier)
        out = [(t, a, b) for t, a, b, o, c in zip(rows.t.tolist(), lo.tolist(), hi.tolist(), open_.tolist(), final.tolist(), strict=True) if o and ((c and t not in left) if delayed else left.get(t) != (a, b))]
        left |= {t: (a, b) for t, a, b in out}

        settled = frontier if frontier is not None else None if None in rows.ends else min(rows.ends)
        if settled is not None:
            bound = settled - depth if bound is None else max(bound, settled - depth)
        if bound is not None:
            past = held["t_us"] <= bound
            if now is None or m.synchronize != "none":  # the last of each signal stays
                for i in signals:
                    own = np.flatnonzero(past & (held["signal"] == i))
                    if len(own):
                        past[own[np.argmax(held["t_us"][own])]] = False
            held = held[~past]
            left = {t: v for t, v in left.items() if t > bound}
        if now is not None and not len(held):
            bound = None  # what comes for this key again is later than the watermark
        if len(held) or left or bound is not None:
            self.state.update((_packed(held, np.array([(t, *v) for t, v in left.items()], _LEAVES), bound),))
        else:
            self.state.clear()
        if now is not None and len(held):
            marks = np.concatenate([held["t_us"], held["t_us"] + depth])
            marks = marks[marks > now]
            if len(marks):
                self.handle.registerTimer(int(-(-int(marks.min()) // 1000)) + 1)
        if out:
            yield m._frame(key[0], out)


@dataclass
class KeyedMonitor:
    """A formula over a stream of samples (the columns of a trace), with state per key.

    Delayed verdicts (key, t_us, value) leave once; intervals (key, t_us, lo, hi) leave when a micro-batch has changed
    them, until they are closed.  bindings: values of variables, or change logs [(first arrival, value), ...].
    """

    formula: Formula
    semantics: str = "delayed_rob"
    synchronize: str = "none"
    bindings: Bindings | None = None
    lateness: int | None = None
    idle: int | None = None

    def __post_init__(self):
        if self.semantics not in SEMANTICS:
            raise ValueError(f"semantics is one of {SEMANTICS}")
        if self.synchronize not in STRATEGIES:
            raise ValueError(f"synchronize is one of {STRATEGIES}")
        if self.lateness is not None and self.idle is not None:
            raise ValueError("idle keys go with the watermark when windows close by time")
        if Plan.of(self.formula, self.bindings).logs:
            raise ValueError("a table of changes is no part of a key's state: give a variable's changes as a list")

    def _frame(self, key, out: list[tuple[int, float, float]]) -> pd.DataFrame:
        keys, t = pd.Series([key] * len(out), dtype=object), [r[0] for r in out]
        if self.semantics == "interval":
            return pd.DataFrame({"key": keys, "t_us": t, "lo": [r[1] for r in out], "hi": [r[2] for r in out]})
        return pd.DataFrame({"key": keys, "t_us": t, "value": [r[1] > 0 for r in out] if self.semantics == "delayed_bool" else [r[1] for r in out]})

    def verdicts(self, stream: DataFrame) -> DataFrame:
        """The streaming DataFrame of verdicts, for any sink in append mode."""
        kind = stream.schema["key"].dataType.simpleString()
        values = {"delayed_bool": "value boolean", "delayed_rob": "value double", "interval": "lo double, hi double"}[self.semantics]
        rows = stream.select("key", "signal", "t_us", F.col("value").cast("double").alias("value"), "seq")
        if self.formula.signals():
            rows = rows.where(F.col("signal").isin(self.formula.signals()))
        mode = "None" if self.idle is None else "ProcessingTime"
        if self.lateness is not None:
            mode = "EventTime"
            rows = rows.withColumn("time", F.timestamp_micros("t_us")).withWatermark("time", f"{self.lateness} microseconds")
        return rows.groupBy("key").transformWithStateInPandas(_Processor(self), f"key {kind}, t_us long, {values}", "append", mode)

    def start(self, stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Verdicts of the stream as Parquet files, each once."""
        out = self.verdicts(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return _started(stream.sparkSession, out.outputMode("append").trigger(**(trigger or {"availableNow": True})).start)

    def keep(self, stream: DataFrame, view: LatestVerdicts, checkpoint: str, **trigger) -> StreamingQuery:
        """The latest verdict of each key and time, as a view."""
        return _started(stream.sparkSession, lambda: view.start(self.verdicts(stream), checkpoint, **trigger))


def _started(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """A query started with the state store that the operator needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(PROVIDER, before)
