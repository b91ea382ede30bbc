"""Expected emissions of small traces: step -> {time: value}, as the semantics define them."""

import math

import pytest

from tempora.operators import evaluate as E
from tempora.plans.notation import formula
from tempora.sources.traces import from_samples

NAN = math.nan
# fixed values: signals, formulas and the emissions expected of them, as the semantics are specified
S1 = {"x": [5, 4, 6, 2, 5]}
S2 = {"x": [1, 1, 1, 2, 3, 4, 0, 0, 0, 1, 2]}
S3 = {"x": [0, 6, 1, 0, 8, 1, 7]}
S4 = {"x": [0, 6, 1, 3, 8, 1, 7], "y": [4, 3, 6, 7, 2, 1, 0]}
SPARSE = {"x": [(100, 0), (15, 1), (16, 2), (2, 5), (2, 10)]}

F1 = ["G[0,2](x>3)", "!(F[0,2](x<=3))", "!((true) U[0,2] (x<=3))"]
F2 = ["(G[0,2](x>0)) U[0,6] (F[0,2](x>3))"]
F3 = ["(F[0,2](x>5)) && (G[0,2](x>0))", "((true) U[0,2] (x>5)) && (!(F[0,2](x<=0)))"]
F4 = ["(F[0,2](x>5)) && (true)"]
F5 = ["F[0,2](x>5)", "(true) U[0,2] (x>5)"]
F6 = ["(G[0,5](x>0)) -> (F[0,2](x>3))", "(!(F[0,5](x<=0))) -> ((true) U[0,2](x>3))"]
F7 = ["(!(x<5)) || (false)"]
F8 = ["(G[0,2](x>0)) && (y<5)", "(!(F[0,2](x<=0))) && (y<5)"]
F10 = ["x<-1 U[0,4] (x>-1)"]
F11 = ["x<8 U[0,4] (x>5)"]
T, N = True, False


def trace(spark, signals):
    return from_samples(spark, {s: [v if isinstance(v, tuple) else (v, t) for t, v in enumerate(vs)] for s, vs in signals.items()})


def emitted(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.at_seq, {})[r.t_us // 1_000_000] = r.value
    return out


DELAYED = [
    (F1, S1, {2: {0: 1}, 3: {1: -1}, 4: {2: -1}}),
    (F2, S2, {8: {0: 1}, 9: {1: 1}, 10: {2: 1}}),
    (F3, S3, {2: {0: 0}, 3: {1: 0}, 4: {2: 0}, 5: {3: 0}, 6: {4: 1}}),
    (F4 + F5, S3, {2: {0: 1}, 3: {1: 1}, 4: {2: 3}, 5: {3: 3}, 6: {4: 3}}),
    (F6, S2, {5: {0: -1}, 6: {1: 0}, 7: {2: 0}, 8: {3: 1}, 9: {4: 1}, 10: {5: 1}}),
    (F7, S3, {t: {t: v} for t, v in enumerate([-5, 1, -4, -5, 3, -4, 2])}),
    (F8, S4, {4: {0: 0}, 6: {1: 1}, 8: {2: -1}, 10: {3: -2}, 12: {4: 1}}),
    (F1[:2], SPARSE, {2: {0: 12}, 3: {1: 12, 2: 13}, 4: {5: -1}}),
]
EAGER = [
    (F1, S1, {2: {0: T}, 3: {1: N, 2: N, 3: N}}),
    (F2, S2, {5: {0: T, 1: T, 2: T, 3: T}, 6: {4: N, 5: N}, 8: {6: N}, 9: {7: N}, 10: {8: N}}),
    (F3, S3, {0: {0: N}, 3: {1: N, 2: N, 3: N}, 6: {4: T}}),
    (F4 + F5, S3, {1: {0: T, 1: T}, 4: {2: T, 3: T, 4: T}, 6: {5: T, 6: T}}),
    (F6, S2, {5: {0: N}, 6: {1: T, 2: T, 3: T, 4: T, 5: T, 6: T}, 7: {7: T}, 8: {8: T}}),
    (F7, S3, {t: {t: v > 0} for t, v in enumerate([-5, 1, -4, -5, 3, -4, 2])}),
    (F8, S4, {0: {0: N}, 6: {1: T, 2: N}, 7: {3: N}, 12: {4: T}}),
    (F10, S3, {t: {t: N} for t in range(7)}),
    (F11, S3, {1: {0: T, 1: T}, 4: {2: N, 3: N, 4: N}, 6: {5: T, 6: T}}),
    (F1[:1], SPARSE, {2: {0: T}, 3: {1: T, 2: T, 5: N}, 4: {10: N}}),
]


@pytest.mark.parametrize("case", range(len(DELAYED)))
def test_delayed_robustness(spark, case):
    texts, signals, want = DELAYED[case]
    for text in texts:
        assert emitted(E.verdicts(trace(spark, signals), formula(text), emission=True)) == want, text


@pytest.mark.parametrize("case", range(len(EAGER)))
def test_eager(spark, case):
    texts, signals, want = EAGER[case]
    for text in texts:
        assert emitted(E.eager(trace(spark, signals), formula(text))) == want, text


def test_delayed_truth_at_zero_robustness(spark):
    got = E.verdicts(trace(spark, S2), formula(F6[0]), "bool").collect()
    assert {r.t_us // 1_000_000: r.value for r in got} == {0: N, 1: T, 2: T, 3: T, 4: T, 5: T}


def test_until_on_irregular_times(spark):
    rows = from_samples(spark, {"x": [(2, 0), (2, 2), (2, 4), (6, 6), (12, 8)]})
    got = E.verdicts(rows, formula("x<10 U[0,4] x>5"), "bool").collect()
    assert {r.t_us // 1_000_000: r.value for r in got} == {0: N, 2: T, 4: T}


def test_interval_trace_tightens(spark):
    rows = from_samples(spark, {"x": [(7, 0), (4, 1)]})
    got = {(r.now_us // 1_000_000, r.t_us // 1_000_000): (r.lo, r.hi) for r in E.interval_trace(rows, formula("G[0,2](x>5)")).collect()}
    inf = math.inf
    assert got == {(0, 0): (-inf, 2), (1, 0): (-inf, -1), (1, 1): (-inf, -1)}


@pytest.mark.parametrize("text,signals", [(F1[0], S1), (F2[0], S2), (F3[0], S3), (F5[1], S3), (F6[0], S2), (F8[0], S4), ("F[0,2](G[0,1](x>0))", S2)])
def test_final_interval_is_delayed_value_and_bounds_tighten(spark, text, signals):
    rows = trace(spark, signals)
    final = {r.t_us: (r.lo, r.hi) for r in E.intervals(rows, formula(text)).collect()}
    for r in E.verdicts(rows, formula(text)).collect():
        assert final[r.t_us] == (r.value, r.value)
    seen = {}
    for r in sorted(E.interval_trace(rows, formula(text)).collect(), key=lambda r: r.now_us):
        lo, hi = seen.get(r.t_us, (-math.inf, math.inf))
        assert lo <= r.lo <= r.hi <= hi
        seen[r.t_us] = (r.lo, r.hi)


def test_synchronized_intervals(spark):
    rows = from_samples(spark, {"x": [(5, 0), (15, 2), (8, 4)], "y": [(25, 0), (15, 3), (30, 5)]})
    got = {r.t_us // 1_000_000: (r.lo, r.hi) for r in E.intervals(rows, formula("G[0,2](x>10) && F[0,3](y<20)"), "zoh").collect()}
    assert got[0][0] == got[0][1] and got[2][0] == got[2][1]
    assert got[3][0] < got[3][1] and got[4][0] < got[4][1]


def test_metamorphic_always_is_not_eventually_not(spark):
    rows = trace(spark, S2)
    a = E.verdicts(rows, formula("G[1,3](x>1)")).collect()
    b = E.verdicts(rows, formula("!(F[1,3](!(x>1)))")).collect()
    assert sorted(a) == sorted(b) and len(a) == 8
