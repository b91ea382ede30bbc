import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import evaluate as E
from tempora.operators import temporal as W
from tempora.operators.monitor import Monitor, Variables
from tempora.operators.sync import increasing, wide
from tempora.plans.formula import And, Compare, Constant, Eventually, Globally, Not, Or, Until, always, eventually, gt, gt_var, lowered, lt
from tempora.plans.notation import formula
from tempora.sources import traces


def cells(df):
    return {(r.t_us // 1_000_000): (r.v_0, r.v_1) for r in df.collect()}


def test_late_samples_are_dropped(spark):
    rows = spark.createDataFrame([("k", "a", t * 1_000_000, float(i), i) for i, t in enumerate([2, 3, 3, 1, 5])], "key string, signal string, t_us long, value double, seq long")
    assert sorted(r.t_us // 1_000_000 for r in increasing(rows).collect()) == [2, 3, 5]


def test_zero_order_hold_and_linear(spark):
    rows = traces.from_samples(spark, {"a": [(1, 1), (10, 2), (3, 4)], "b": [(0, 0), (30, 5)]})
    held = cells(wide(rows, ["a", "b"], "zoh"))
    assert [held[t][1] for t in (1, 2, 4)] == [0, 0, 0] and held[0][0] is None and held[5][0] is None
    rows = traces.from_samples(spark, {"a": [(0, 0), (10, 2)], "b": [(0, 0), (20, 4)]})
    assert cells(wide(rows, ["a", "b"], "linear"))[2][1] == 10


def test_every_time_of_interleaved_signals_has_a_verdict(spark):
    rows = traces.from_samples(spark, {"x": [(t, t) for t in range(0, 101, 2)], "y": [(t, t) for t in range(1, 100, 2)]})
    for how in ("zoh", "linear"):
        got = {r.t_us // 1_000_000 for r in E.verdicts(rows, formula("(x>0) && (y<150)"), synchronize=how).collect()}
        assert got == set(range(1, 100))


def test_variables_hold_from_their_arrival_on(spark):
    rows = traces.from_samples(spark, {"x": [(10, 1), (10, 2)]})
    v = Variables(threshold=5)
    v.set("threshold", 15, since=1)
    got = [r.value for r in E.verdicts(rows, gt_var("x", "threshold"), bindings=v.history).orderBy("t_us").collect()]
    assert got == [5, -5]
    with pytest.raises(ValueError, match="threshold"):
        E.verdicts(rows, gt_var("x", "threshold"))


def test_variables_api():
    v = Variables(a=1)
    v.set("b", 2)
    assert v.names() == ["a", "b"] and v.get("b") == 2 and v.contains("a") and len(v) == 2 and v.get("c") is None
    v.remove("a")
    assert v.names() == ["b"]
    v.clear()
    assert len(v) == 0


def test_nan_and_null_values_are_no_samples(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 0), (1, 1, math.nan, 1), (1, 2, None, 2), (1, None, 4.0, 3), (1, 4, 5.0, 4)], "k long, t long, v double, s long")
    t = traces.trace(rows, "k", F.lit("x"), "t", "v", "s")
    assert sorted(r.value for r in t.collect()) == [1, 5]


def test_empty_trace(spark):
    rows = traces.from_samples(spark, {"x": [(1, 1)]}).where("false")
    f = formula("G[0,2](x>1) && F[1,2](y<3)")
    assert E.verdicts(rows, f).count() == E.eager(rows, f).count() == E.intervals(rows, f).count() == E.interval_trace(rows, f).count() == 0
    with pytest.raises(ValueError):
        traces.from_samples(spark, {})


@pytest.mark.parametrize("start,end", [(0, 40), (7, 90), (30, 31)])
def test_blocks_equal_frames(spark, start, end):
    rows = traces.chirp(spark, 400).where("seq % 7 <> 3").select((F.col("seq") % 2).cast("string").alias("key"), "signal", "t_us", "value", "seq")
    for f in (always(start, end, gt("x", 0.1)), eventually(start, end, gt("x", 0.1))):
        a, b = (sorted(E.verdicts(rows, f, block_from=k).collect()) for k in (None, 0))
        assert a == b and len(a) > 100


@pytest.mark.parametrize("domain", ["bool", "rob"])
def test_one_long_trace_runs_in_many_tasks(spark, domain):
    rows = traces.sine(spark, 4000).withColumn("key", (F.col("seq") * 0).cast("string"))  # one key, not known to the optimiser
    f = always(0, 50, gt("x", -2) >> eventually(0, 30, lt("x", 0)))
    whole, parts = (E.verdicts(rows, f, domain, block_from=1, chunk=c) for c in (None, 100_000_000))
    assert sorted(whole.collect()) == sorted(parts.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [df.select("value", F.spark_partition_id().alias("task")).groupBy("task").count().count() for df in (whole, parts)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks[0] == 1 and tasks[1] == 4


@pytest.mark.parametrize("start, end", [(0, 1), (0, 7), (3, 9), (4, 4), (0, 40), (25, 90)])
def test_until_best_equals_fold(spark, start, end):
    rnd = random.Random(start * 100 + end)
    xs = [(k, rnd.randint(0, 200), rnd.choice([None, rnd.uniform(-3, 3)]), rnd.choice([None, rnd.uniform(-3, 3)])) for k in "ab" for _ in range(90)]
    table = {(k, t): (k, t, l, r) for k, t, l, r in xs}
    df = spark.createDataFrame(list(table.values()), "key string, t_us long, l double, r double")
    got = {(r.key, r.t_us): r.v for r in W.until_best(df, "l", "r", start, end, "v").collect()}
    for k, t, *_ in table.values():
        low, best = math.inf, -math.inf
        for (k2, t2), (_, _, l, r) in sorted(table.items()):
            if k2 == k and t <= t2 <= t + end and l is not None and r is not None:
                low = min(low, l)
                best = max(best, min(low, r)) if t2 >= t + start else best
        assert got[k, t] == best


def test_late_samples_by_blocks(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([("k", "x", rnd.randint(0, 400) + i, 1.0, i) for i in range(500)], "key string, signal string, t_us long, value double, seq long")
    assert sorted(increasing(df).collect()) == sorted(increasing(df, 16).collect())


def test_monitor_views(spark):
    rows = traces.from_samples(spark, {"x": [(5, 0), (4, 1), (6, 2), (2, 3), (5, 4)]})
    m = Monitor("G[0,2](x>3)")
    assert m.temporal_depth == 2 and m.signal_identifiers == ["x"] and m.specification == "G[0, 2](x > 3)" and "temporal depth: 2 s" in str(m)
    assert [r.value for r in m.verdicts(rows).orderBy("t_us").collect()] == [1, -1, -1]
    assert m.verdict_at(rows, 1_000_000).first().value == -1
    assert m.latest(rows).first().t_us == 2_000_000
    assert tuple(m.counts(rows).first()[1:]) == (3, 3)
    assert [len(r.outputs) for r in m.evaluations(rows).orderBy("at").collect()] == [1, 1, 1]
    assert Monitor("G[0,2](x>3)", "interval").counts(rows).first().n_verdicts == 5
    assert [len(r.outputs) for r in Monitor("G[0,2](x>3)", "eager").evaluations(rows).orderBy("at").collect()] == [1, 3]
    for bad in ({"semantics": "late"}, {"synchronize": "cubic"}):
        with pytest.raises(ValueError):
            Monitor("x > 1", **bad)


def test_csv_round_trip(spark, tmp_path):
    spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "timestep double, value double").coalesce(1).write.csv(str(tmp_path / "in"), header=True)
    got = E.verdicts(traces.read_csv(spark, str(tmp_path / "in")), gt("x", 2))
    traces.write_csv(got, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.csv(str(tmp_path / "out"), header=True, inferSchema=True).collect()) == [-1, 1]


def test_one_exchange_for_all_windows_of_a_formula(spark):
    rows = traces.sine(spark, 100)
    df = E.verdicts(rows, formula("G[0,5](x>0 -> F[0,3](x<0)) && F[0,9](x>0)"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key") <= 2  # late samples, then time


def test_eager_until_over_wide_windows(spark):
    """The first deciding row of 5,000, for every sample of a long trace, in the time of a sort."""
    trace = traces.chirp(spark, 20_000)
    f = formula("x < 0.999 U[500,5000] (x > 0.99)")
    got = E.eager(trace, f).orderBy("t_us").toPandas()
    x = [r.value for r in trace.orderBy("t_us").collect()]
    for t in range(0, len(got), 487):
        stop = next((u for u in range(t, len(x)) if not x[u] < 0.999), None)
        met = next((u for u in range(t + 500, len(x)) if 0.99 < x[u] < 0.999), None)
        true_at = met if met is not None and met <= t + 5000 and (stop is None or met < stop) else None
        first = min(u for u in (true_at, stop if stop is not None and stop <= t + 5000 else None, t + 5000) if u is not None)
        assert got.value[t] == (true_at == first)


@pytest.mark.parametrize("text", ["(x > 0 && y > 0) U[1,6] (y < 0.5)", "G[0,5](x > -0.5 || y > 0)", "F[1,4](x > 0.9) && G[0,3](y > -0.9)", "true U[0,5] (x > 0.8)"])
def test_eager_decides_as_a_walk_does(spark, text):
    """Windows walked row by row in order of arrival, at every operator."""
    rnd = random.Random(11)
    rows = [("k", "xy"[i % 2], (i - i % 2) * 1_000_000, rnd.uniform(-1, 1), i) for i in range(240)]
    f = lowered(formula(text))
    want = _eager_walk(f, rows)
    got = {r.t_us: (r.value, r.at_seq) for r in E.eager(spark.createDataFrame(rows, "key string, signal string, t_us long, value double, seq long"), f).collect()}
    assert got == want and len(got) > 10
    for chunk in (1, 20_000_000):
        parts = E.eager(spark.createDataFrame(rows, "key string, signal string, t_us long, value double, seq long"), f, chunk=chunk)
        assert {r.t_us: (r.value, r.at_seq) for r in parts.collect()} == want


def _eager_walk(f, rows):
    own = [r for r in rows if r[1] in f.signals()]
    times = sorted({r[2] for r in own})
    at = {s: {r[2]: (r[3], r[4]) for r in own if r[1] == s} for s in f.signals()}

    def close(g, t):
        return min((r[4] for r in own if r[1] in (g.signals() or f.signals()) and r[2] >= t + g.depth()), default=None)

    def first_come(found):
        out, latest = {}, -1
        for t in times:
            if found.get(t) is None:
                if t in found:
                    break
                continue
            latest = max(latest, found[t][1])
            out[t] = (found[t][0], latest)
        return out

    def value(g):
        if isinstance(g, Constant):
            return {t: (g.value, max(r[4] for r in own if r[2] == t)) for t in times}
        if isinstance(g, Compare):
            return {t: ((v > g.limit) if g.op == ">" else (v < g.limit), q) for t, (v, q) in at[g.signal].items()}
        p = [value(x) for x in g.parts]
        if isinstance(g, Not):
            return {t: (not v, q) for t, (v, q) in p[0].items()}
        found = {}
        for t in times:
            if isinstance(g, (And, Or)):
                z = isinstance(g, Or)
                sides = [x[t] for x in p if t in x]
                alone = [q for v, q in sides if v == z]
                if sides:
                    found[t] = (z, min(alone)) if alone else (not z, max(q for _, q in sides)) if len(sides) == 2 else None
            elif isinstance(g, (Globally, Eventually)):
                z = isinstance(g, Eventually)
                if t in p[0]:
                    hit = min((q for u, (v, q) in p[0].items() if t + g.start <= u <= t + g.end and v == z), default=None)
                    done = close(g, t)
                    found[t] = (z, max(hit, p[0][t][1])) if hit is not None and (done is None or hit <= done) else (not z, max(done, p[0][t][1])) if done is not None else None
            elif t in p[0] and t in p[1]:
                l, r = p
                mine, pre, true_at, false_at = max(l[t][1], r[t][1]), -1, None, None
                for u in times:
                    if not t <= u <= t + g.end or (u not in l and u not in r):
                        continue
                    if u not in l:
                        break
                    pre = max(pre, l[u][1])
                    if not l[u][0]:
                        false_at = max(pre, mine)
                        break
                    if u >= t + g.start and u in r and r[u][0]:
                        came = max(pre, r[u][1])
                        true_at = came if true_at is None else min(true_at, came)
                first = min((x for x in (true_at, false_at, close(g, t)) if x is not None), default=None)
                found[t] = None if first is None else (true_at == first, max(first, mine))
        return first_come(found)

    return value(f)


@pytest.mark.parametrize("start, end", [(0, 5_000_000), (2_000_000, 7_000_000), (3_000_000, 3_000_000)])
def test_until_by_fold_and_by_blocks_agree(spark, start, end):
    rnd = random.Random(21)
    rows = [("k", "xy"[i % 2], (i - i % 2) * 500_000, rnd.uniform(-1, 1), i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, signal string, t_us long, value double, seq long")
    f = Until(start, end, gt("x", -0.5), gt("y", 0.3))
    one, two = (sorted(E.verdicts(df, f, "rob", block_from=k).collect()) for k in (None, 0))
    assert one == two and len(one) > 100
    a, b = (sorted(E.intervals(df, Globally(start, end, f), block_from=k).collect()) for k in (None, 0))
    assert a == b
