"""Refinements as changes against intervals evaluated anew at every time."""

import random

import pandas as pd
import pyarrow as pa
import pytest

from tempora.operators.evaluate import Plan
from tempora.operators.refine import _whole, refinements
from tempora.plans.notation import formula
from tempora.streaming.keyed import Open, bounds_of

TRACE = "key string, signal string, t_us long, value double, seq long"
S = 1_000_000
FORMULAS = (
    "G[0,5](x > 0)", "F[2,9](x < 0.3)", "!(G[0,4](x > 0.2)) && F[0,7](y > 0)", "G[0,6](x > 0 -> F[0,4](y < 0))", "F[1,5](G[0,3](x > -0.5) || y > 0.5)", "x > -0.3 U[0,6] y > 0.4",
    "x > -0.3 U[2,7] F[0,3](y > 0.4)", "G[0,4](x > -0.9 U[0,3] y > 0.4)", "true U[0,5] (x > 0)", "G[3,3](x > 0)", "x > 0 || y < 0", "G[0,9](F[0,2](x > 0) || false)",
)


def expected(rows, f):
    """Every interval at every time, of which those that differ from before are kept."""
    plan, out = Plan.of(f, None), []
    for key in {r[0] for r in rows}:
        own = pd.DataFrame([(plan.signals.index(r[1]), *r[2:]) for r in rows if r[0] == key and r[1] in plan.signals], columns=["signal", "t_us", "value", "seq"])
        latest = {}
        for now in sorted(set(own["t_us"])):
            seen = Open(own[own["t_us"] <= now], len(plan.signals), "none")
            lo, hi = bounds_of(plan, seen, None, False, None)
            for t, a, b in zip(seen.t.tolist(), lo.tolist(), hi.tolist(), strict=True):
                if a == a and latest.get(t) != (a, b):
                    latest[t] = (a, b)
                    out.append((key, now, t, a, b))
    return sorted(out)


def samples(seed, gaps):
    rnd = random.Random(seed)
    rows, t = [], 0
    for _ in range(70):
        t += rnd.choice([1, 1, 2, gaps])
        for s in "xy":
            if rnd.random() < 0.8:
                rows.append((rnd.choice("ab"), s, t * S, round(rnd.uniform(-1, 1), 1), len(rows)))
    return rows


@pytest.mark.parametrize("text", FORMULAS)
def test_changes_equal_those_of_the_full_trace(spark, text):
    f = formula(text)
    for seed, gaps, chunk in ((1, 3, None), (2, 25, 1)):
        rows = samples(seed, gaps)
        got = refinements(spark.createDataFrame(rows, TRACE), f, chunk=chunk and chunk * S)
        assert sorted(map(tuple, got.collect())) == expected(rows, f)


def test_as_many_rows_as_changes(spark):
    n = 3000
    rows = [("k", "x", t * S, -float(t), t) for t in range(n)]  # each sample lowers every open minimum
    flat = [("k", "x", t * S, 1.0 + (t % 7 == 0), t) for t in range(n)]
    f = formula("G[0,50](x > 0)")
    assert refinements(spark.createDataFrame(rows, TRACE), f, chunk=300 * S).count() == sum(min(50, n - 1 - t) + 1 for t in range(n))
    # two values: at most one change while open, one to close
    assert refinements(spark.createDataFrame(flat, TRACE), f, chunk=300 * S).count() <= 3 * n


def test_short_chunks_of_many_keys_are_taken_together(spark):
    rnd = random.Random(3)
    rows = [(f"k{k}", s, (100 * k + 3 * i + rnd.randint(0, 2)) * S, round(rnd.uniform(-1, 1), 1), 10 * k + i) for k in range(120) for i in range(1 + k % 9) for s in "xy"[: 1 + k % 2]]
    for text in ("!(G[0,4](x > 0.2)) && F[0,7](y > 0)", "x > -0.3 U[2,7] F[0,3](x > 0.4)"):
        f = formula(text)
        got = refinements(spark.createDataFrame(rows, TRACE), f, chunk=10 * S)
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # no call of Python for each of a hundred thousand chunks
        assert sorted(map(tuple, got.collect())) == expected(rows, f)


def test_tables_hold_whole_chunks():
    counts = [n for size in (1, 5, 2, 9, 1, 1, 3) for n in range(1, size + 1)]
    batches = pa.table({"n": counts}).to_batches(max_chunksize=4)
    found = [t.column("n").to_pylist() for t in _whole(iter(batches), 6)]
    assert sum(found, []) == counts and all(x[0] == 1 for x in found) and len(found) > 2


def on_time(rows):
    """The samples that are later than all of their signal that arrived before them."""
    latest, out = {}, []
    for r in sorted(rows, key=lambda r: r[4]):
        if r[2] > latest.get(r[:2], -(10**18)):
            latest[r[:2]] = r[2]
            out.append(r)
    return out


@pytest.mark.parametrize("text", ("G[0,5](x > 0)", "!(G[0,4](x > 0.2)) && F[1,7](y > 0)", "x > -0.3 U[2,7] F[0,3](y > 0.4)", "true U[0,5] (x > 0)"))
def test_late_samples_are_left_out_without_a_join(spark, text):
    f, rnd = formula(text), random.Random(5)
    for late, chunk in ((3, 1), (30, 1), (30, 40)):
        rows = [(rnd.choice("ab"), rnd.choice("xy"), (n - 60 + rnd.choice([0, 0, -rnd.randint(0, late)])) * S, round(rnd.uniform(-1, 1), 1), n) for n in range(140)]
        got = refinements(spark.createDataFrame(rows, TRACE), f, chunk=chunk * S)
        assert "Join " not in got._jdf.queryExecution().optimizedPlan().toString()  # samples meet by the exchange of chunks alone
        assert sorted(map(tuple, got.collect())) == expected(on_time(rows), f)
