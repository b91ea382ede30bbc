"""Queries over the events and orders tables, one per operator, each with SQL for another engine.

``SQL`` spells the meaning of a formula with plain windows and correlated subqueries, one step per
subformula, and shares no code with the evaluation.  Infinite bounds are given as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import evaluate as E
from tempora.operators.monitor import Monitor, Variables
from tempora.operators.refine import refinements
from tempora.operators.sync import increasing, wide
from tempora.plans import formula as P
from tempora.plans.catalog import catalog
from tempora.plans.notation import formula
from tempora.sources.folders import replay, scratch
from tempora.sources.traces import events_trace, orders_trace, read_csv
from tempora.streaming.keyed import KeyedMonitor
from tempora.streaming.latest import LatestVerdicts

Query = Callable[[SparkSession, str], DataFrame]
H = 3600
DAY = 24 * H

# -- SQL ------------------------------------------------------------------------------

EVENTS = "ev AS (SELECT user_id AS key, epoch_us(ts) AS t_us, event_id AS seq, value AS x FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"


def sql_verdicts(f: P.Formula, domain: str, bound: dict[str, float] | None = None, source: str = EVENTS, finite: bool = True) -> str:
    """SQL for the verdicts of a formula over one signal x, with until by its definition."""
    steps, name, number = [source], "ev", {}
    rob = domain == "rob"
    for k, g in enumerate(f.walk()):
        number[g] = k
        p = [f"c{number[x]}" for x in g.parts]
        both = lambda e, p=p: f"CASE WHEN {p[0]} IS NOT NULL AND {p[1]} IS NOT NULL THEN {e} END"
        if isinstance(g, P.Constant):
            e = ("'inf'::DOUBLE" if g.value else "'-inf'::DOUBLE") if rob else str(g.value)
        elif isinstance(g, P.Compare):
            c = bound[g.limit] if isinstance(g.limit, str) else g.limit
            e = (f"x - {c!r}::DOUBLE" if g.op == ">" else f"{c!r}::DOUBLE - x") if rob else f"x {g.op} {c!r}::DOUBLE"
        elif isinstance(g, P.Not):
            e = f"-{p[0]}" if rob else f"NOT {p[0]}"
        elif isinstance(g, P.And):
            e = both(f"least({p[0]}, {p[1]})" if rob else f"{p[0]} AND {p[1]}")
        elif isinstance(g, P.Or):
            e = both(f"greatest({p[0]}, {p[1]})" if rob else f"{p[0]} OR {p[1]}")
        elif isinstance(g, P.Implies):
            e = both(f"greatest(-{p[0]}, {p[1]})" if rob else f"NOT {p[0]} OR {p[1]}")
        else:
            closed = f"t_us + {g.depth()} <= max(t_us) OVER (PARTITION BY key)"
            if isinstance(g, P.Until):
                inner = f"(SELECT min(n.{p[0]}) FROM {name} n WHERE n.key = o.key AND n.t_us BETWEEN o.t_us AND m.t_us)"
                best = f"max(least(m.{p[1]}, {inner}))" if rob else f"coalesce(bool_or(m.{p[1]} AND {inner}), false)"
                default = "'-inf'::DOUBLE" if rob else "false"
                value = f"coalesce((SELECT {best} FROM {name} m WHERE m.key = o.key AND m.t_us BETWEEN o.t_us + {g.start} AND o.t_us + {g.end}), {default})"
                steps.append(f"s{k} AS (SELECT o.*, CASE WHEN known THEN {value} END AS c{k} FROM (SELECT *, {' AND '.join(f'{x} IS NOT NULL' for x in p)} AND {closed} AS known FROM {name}) o)")
                steps[-1] = steps[-1].replace("o.*", "o.* EXCLUDE (known)")
                name = f"s{k}"
                continue
            least = isinstance(g, P.Globally)
            default = ("'inf'::DOUBLE" if least else "'-inf'::DOUBLE") if rob else str(least)
            best = f"{'min' if least else 'max'}({p[0]}) OVER (PARTITION BY key ORDER BY t_us RANGE BETWEEN {g.start} FOLLOWING AND {g.end} FOLLOWING)"
            e = f"CASE WHEN {p[0]} IS NOT NULL AND {closed} THEN coalesce({best}, {default}) END"
        steps.append(f"s{k} AS (SELECT *, {e} AS c{k} FROM {name})")
        name = f"s{k}"
    value = f"CASE WHEN isfinite(c{number[f]}) THEN c{number[f]} END" if rob and finite else f"c{number[f]}"
    return f"WITH {', '.join(steps)} SELECT key, t_us, {value} AS value FROM {name} WHERE c{number[f]} IS NOT NULL"


FIRST_COME = "ORDER BY t_us ROWS UNBOUNDED PRECEDING"


def sql_eager(f: P.Formula) -> str:
    """Eager truth of a formula over one signal x, and the arrival by which it could be given."""
    steps, name, number = [EVENTS], "ev", {}
    for k, g in enumerate(f.walk()):
        number[g] = k
        p, a = ([f"{c}{number[x]}" for x in g.parts] for c in "ca")
        if isinstance(g, P.Compare):
            steps.append(f"s{k} AS (SELECT *, x {g.op} {g.limit!r}::DOUBLE AS c{k}, seq AS a{k} FROM {name})")
        elif isinstance(g, P.Not):
            steps.append(f"s{k} AS (SELECT *, NOT {p[0]} AS c{k}, {a[0]} AS a{k} FROM {name})")
        else:
            if isinstance(g, (P.And, P.Or)):
                z, other = ("true", "false") if isinstance(g, P.Or) else ("false", "true")
                alone = f"least(CASE WHEN {p[0]} = {z} THEN {a[0]} END, CASE WHEN {p[1]} = {z} THEN {a[1]} END)"
                both = f"{p[0]} IS NOT NULL AND {p[1]} IS NOT NULL"
                steps.append(f"w{k} AS (SELECT *, {p[0]} IS NOT NULL OR {p[1]} IS NOT NULL AS task, {alone} AS alone FROM {name})")
                v, came = f"CASE WHEN alone IS NOT NULL THEN {z} WHEN {both} THEN {other} END", f"CASE WHEN alone IS NOT NULL THEN alone WHEN {both} THEN greatest({a[0]}, {a[1]}) END"
            else:
                z = "true" if isinstance(g, P.Eventually) else "false"
                over = "OVER (PARTITION BY key ORDER BY t_us RANGE BETWEEN"
                hit = f"min(CASE WHEN {p[0]} = {z} THEN {a[0]} END) {over} {g.start} FOLLOWING AND {g.end} FOLLOWING)"
                steps.append(f"w{k} AS (SELECT *, {p[0]} IS NOT NULL AS task, {hit} AS hit, min(seq) {over} {g.depth()} FOLLOWING AND UNBOUNDED FOLLOWING) AS done FROM {name})")
                soon = "hit IS NOT NULL AND (done IS NULL OR hit <= done)"
                v, came = f"CASE WHEN task AND {soon} THEN {z} WHEN task AND done IS NOT NULL THEN NOT {z} END", f"greatest({a[0]}, CASE WHEN {soon} THEN hit ELSE done END)"
            rest = "* EXCLUDE (task, alone, v, came)" if isinstance(g, P.Pair) else "* EXCLUDE (task, hit, done, v, came)"
            steps.append(f"v{k} AS (SELECT *, {v} AS v, {came} AS came FROM w{k})")
            given = "v IS NOT NULL AND max(CASE WHEN task AND v IS NULL THEN 1 ELSE 0 END) OVER q = 0"
            steps.append(f"s{k} AS (SELECT {rest}, CASE WHEN {given} THEN v END AS c{k}, CASE WHEN {given} THEN max(CASE WHEN v IS NOT NULL THEN came END) OVER q END AS a{k} FROM v{k} WINDOW q AS (PARTITION BY key {FIRST_COME}))")
        name = f"s{k}"
    k = number[f]
    return f"WITH {', '.join(steps)} SELECT key, t_us, c{k} AS value, a{k}::BIGINT AS at_seq FROM {name} WHERE c{k} IS NOT NULL"


def sql_latest_intervals(f: P.Formula) -> str:
    """Robustness intervals of a formula over one signal x on all that has arrived."""
    steps, name, number = [EVENTS], "ev", {}
    for k, g in enumerate(f.walk()):
        number[g] = k
        lo, hi = ([f"{c}{number[x]}" for x in g.parts] for c in "lh")
        if isinstance(g, P.Compare):
            e = (f"x - {g.limit!r}::DOUBLE" if g.op == ">" else f"{g.limit!r}::DOUBLE - x",) * 2
        elif isinstance(g, P.Not):
            e = (f"-{hi[0]}", f"-{lo[0]}")
        elif isinstance(g, (P.And, P.Or)):
            e = tuple(f"{'least' if isinstance(g, P.And) else 'greatest'}({x[0]}, {x[1]})" for x in (lo, hi))
        else:
            least = isinstance(g, P.Globally)
            best, none = ("min", "'inf'::DOUBLE") if least else ("max", "'-inf'::DOUBLE")
            closed = f"t_us + {g.depth()} <= max(t_us) OVER (PARTITION BY key)"
            over = f"OVER (PARTITION BY key ORDER BY t_us RANGE BETWEEN {g.start} FOLLOWING AND {g.end} FOLLOWING)"
            e = tuple(f"coalesce({best}({x[0]}) {over}, {none})" for x in (lo, hi))
            open_ = f"CASE WHEN {closed} THEN {{}} ELSE {'-' if least else ''}'inf'::DOUBLE END"
            e = (open_.format(e[0]), e[1]) if least else (e[0], open_.format(e[1]))
        steps.append(f"s{k} AS (SELECT *, {e[0]} AS l{k}, {e[1]} AS h{k} FROM {name})")
        name = f"s{k}"
    k = number[f]
    return f"WITH {', '.join(steps)} SELECT key, t_us, CASE WHEN isfinite(l{k}) THEN l{k} END AS lo, CASE WHEN isfinite(h{k}) THEN h{k} END AS hi FROM {name}"


def sql_interval_trace(f: P.Sweep, limit: float) -> str:
    """Robustness intervals of a sweep over x > limit at each time of the window."""
    least = isinstance(f, P.Globally)
    best, none = ("min", "'inf'::DOUBLE") if least else ("max", "'-inf'::DOUBLE")
    value = f"coalesce((SELECT {best}(m.x - {limit}::DOUBLE) FROM ev m WHERE m.key = o.key AND m.t_us BETWEEN o.t_us + {f.start} AND o.t_us + {f.end} AND m.t_us <= o.now_us), {none})"
    nows = f"SELECT e.key, e.t_us, n.t_us AS now_us FROM ev e JOIN ev n ON n.key = e.key AND n.t_us BETWEEN e.t_us AND e.t_us + {f.end}"
    lo, hi = ("CASE WHEN closed THEN v END", "v") if least else ("v", "CASE WHEN closed THEN v END")
    return f"""WITH {EVENTS}, o AS ({nows}), r AS (SELECT *, {value} AS v, now_us >= t_us + {f.end} AS closed FROM o)
SELECT key, now_us, t_us, CASE WHEN isfinite({lo}) THEN {lo} END AS lo, CASE WHEN isfinite({hi}) THEN {hi} END AS hi FROM r"""


def sql_refinements(f: P.Formula) -> str:
    """Changes of the intervals of a formula over one signal x: those of the full trace, by subqueries at every later time."""

    def bounds(g: P.Formula, at: str, depth: int) -> tuple[str, str]:
        if isinstance(g, P.Compare):
            return (f"({at}.x - {g.limit!r}::DOUBLE)" if g.op == ">" else f"({g.limit!r}::DOUBLE - {at}.x)",) * 2
        if isinstance(g, P.Not):
            lo, hi = bounds(g.part, at, depth)
            return f"(-{hi})", f"(-{lo})"
        if isinstance(g, (P.And, P.Or)):
            both = zip(bounds(g.left, at, depth), bounds(g.right, at, depth), strict=True)
            return tuple(f"{'least' if isinstance(g, P.And) else 'greatest'}({a}, {b})" for a, b in both)
        m, n = f"m{depth}", f"n{depth}"
        closed = f"o.now_us >= {at}.t_us + {g.depth()}"
        window = lambda e, a=g.start: f"(SELECT {e} FROM ev {m} WHERE {m}.key = o.key AND {m}.t_us BETWEEN {at}.t_us + {a} AND {at}.t_us + {g.end} AND {m}.t_us <= o.now_us)"
        if isinstance(g, P.Until):
            inner = lambda k: f"(SELECT min({bounds(g.left, n, depth + 1)[k]}) FROM ev {n} WHERE {n}.key = o.key AND {n}.t_us BETWEEN {at}.t_us AND {m}.t_us)"
            lo, hi = (f"coalesce({window(f'max(least({bounds(g.right, m, depth + 1)[k]}, {inner(k)}))')}, '-inf'::DOUBLE)" for k in (0, 1))
            return lo, f"CASE WHEN {closed} THEN {hi} ELSE 'inf'::DOUBLE END"
        least = isinstance(g, P.Globally)
        lo, hi = (f"coalesce({window(('min' if least else 'max') + f'({e})')}, {repr('inf' if least else '-inf')}::DOUBLE)" for e in bounds(g.part, m, depth + 1))
        return (f"CASE WHEN {closed} THEN {lo} ELSE '-inf'::DOUBLE END", hi) if least else (lo, f"CASE WHEN {closed} THEN {hi} ELSE 'inf'::DOUBLE END")

    lo, hi = bounds(f, "o", 0)
    last = f"coalesce((SELECT min(n.t_us) FROM ev n WHERE n.key = e.key AND n.t_us >= e.t_us + {f.depth()}), 9223372036854775807)"
    return f"""WITH {EVENTS}, e AS (SELECT *, {last} AS last FROM ev e), o AS (SELECT e.key, e.t_us, e.x, n.t_us AS now_us FROM e JOIN ev n ON n.key = e.key AND n.t_us BETWEEN e.t_us AND e.last),
r AS (SELECT o.key, o.now_us, o.t_us, {lo} AS lo, {hi} AS hi FROM o), c AS (SELECT *, lag(lo) OVER w AS lo0, lag(hi) OVER w AS hi0 FROM r WINDOW w AS (PARTITION BY key, t_us ORDER BY now_us))
SELECT key, now_us, t_us, CASE WHEN isfinite(lo) THEN lo END AS lo, CASE WHEN isfinite(hi) THEN hi END AS hi FROM c WHERE lo0 IS NULL OR lo <> lo0 OR hi <> hi0"""


TYPES = "ev AS (SELECT user_id AS key, epoch_us(ts) AS t_us, event_id AS seq, event_type AS signal, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IN ('click', 'view'))"


def sql_filled(linear: bool) -> str:
    """click and view of each user, filled between their samples at each other's times."""
    fill = "va + (vb - va) * (((t_us - ta) / 1000000.0::DOUBLE) / ((tb - ta) / 1000000.0::DOUBLE))" if linear else "va"

    def one(s: str) -> str:
        return f"""{s}0 AS (SELECT t.key, t.t_us, e.value AS v FROM t LEFT JOIN ev e ON e.key = t.key AND e.t_us = t.t_us AND e.signal = '{s}'),
{s}1 AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t_us END IGNORE NULLS) OVER b AS ta, last_value(v IGNORE NULLS) OVER b AS va,
  first_value(CASE WHEN v IS NOT NULL THEN t_us END IGNORE NULLS) OVER a AS tb, first_value(v IGNORE NULLS) OVER a AS vb FROM {s}0
  WINDOW b AS (PARTITION BY key ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY key ORDER BY t_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{s} AS (SELECT key, t_us, coalesce(v, CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN {fill} END) AS v FROM {s}1)"""

    return f"WITH {TYPES}, t AS (SELECT DISTINCT key, t_us FROM ev), {one('click')}, {one('view')}, w AS (SELECT c.key, c.t_us, c.v AS click, v.v AS view FROM click c JOIN view v ON c.key = v.key AND c.t_us = v.t_us)"


# -- queries --------------------------------------------------------------------------

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _finite(c: str) -> Column:
    return F.when(F.abs(c) < float("inf"), F.col(c)).alias(c)


def _register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _formula(name: str, f: P.Formula, domain: str, bound: dict[str, float] | None = None, **options) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = E.verdicts(events_trace(spark, sf_dir), f, domain, bindings=bound, **options)
        return out.select("key", "t_us", _finite("value")) if domain == "rob" else out

    _register(name, query, sql_verdicts(f, domain, bound))


GT, LT = P.gt("x", 40), P.lt("x", 60)
for _domain in ("bool", "rob"):
    for _name, _f in {
        "p1_gt": GT, "p2_lt": LT, "p5_true": P.TRUE, "p6_false": P.FALSE, "p7_ge": P.ge("x", 40), "p7_le": P.le("x", 60), "p8_eq": P.eq("x", 49.63),
        "b1_not": ~GT, "b2_and": GT & LT, "b3_or": GT | P.lt("x", 20), "b4_implies": GT >> LT,
        "t1_eventually": P.eventually(0, 2 * DAY, GT), "t2_globally": P.always(0, 2 * DAY, P.gt("x", 5)),
        "t1_offset_window": P.eventually(6 * H, 3 * DAY, GT), "t2_empty_window": P.always(H, 3 * H, P.gt("x", 5)),
        "nested_g_f": P.always(0, DAY, P.gt("x", 30) >> P.eventually(0, 2 * DAY, P.lt("x", 30))), "f_g_chain": P.eventually(0, DAY, P.always(0, DAY, P.eventually(0, DAY, GT))),
        "t3_until": P.until(0, 2 * DAY, P.lt("x", 80), GT), "t3_until_lower_bound": P.until(12 * H, 3 * DAY, P.lt("x", 90), GT), "until_chain": P.until(0, DAY, GT | LT, P.until(0, DAY, LT, GT)),
    }.items():
        _formula(f"{_name}_{_domain}", _f, _domain)
    _formula(f"p3_gt_var_{_domain}", P.gt_var("x", "high"), _domain, {"high": 42.5})
    _formula(f"p4_lt_var_{_domain}", P.lt_var("x", "high"), _domain, {"high": 42.5})


def _scaled(f: P.Formula, by: int) -> P.Formula:
    """The same formula with times multiplied, for traces of coarser samples."""
    if isinstance(f, P.Sweep):
        return type(f)(f.start * by, f.end * by, _scaled(f.part, by))
    if isinstance(f, P.Until):
        return P.Until(f.start * by, f.end * by, _scaled(f.left, by), _scaled(f.right, by))
    return type(f)(*(_scaled(p, by) for p in f.parts)) if f.parts else f


_NAMES = ("and", "or", "not", "globally", "globally_100", "globally_1000", "eventually", "eventually_100", "eventually_1000", "until", "until_100", "until_1000")
_NAMES += tuple(f"{n}_{k}" for n in ("and_eventually", "eventually_globally", "until") for k in (2, 3, 5))
for _k, _name in enumerate(_NAMES, 1):
    _formula(f"catalog_{_k}_{_name}", _scaled(catalog()[_k], {100: 2 * H, 1000: 600}.get(int("0" + _name.rpartition("_")[2] if _name[-1].isdigit() else 0), 2 * H)), "rob")
_formula("phi1", P.lt("x", 60) & P.gt("x", 20), "rob")
_formula("phi2", formula("G[0,864000](x > 60 -> F[0,86400](x < 20))"), "rob")
_formula("phi3", formula("(G[0,86400](x < 90)) or (G[86400,129600](x > 5))"), "rob")
for _domain in ("bool", "rob"):
    _formula(f"by_chunks_nested_{_domain}", P.always(0, DAY, P.gt("x", 30) >> P.eventually(0, 2 * DAY, P.lt("x", 30))), _domain, chunk=5 * DAY * 1_000_000)
    _formula(f"by_chunks_until_{_domain}", P.until(12 * H, 3 * DAY, P.lt("x", 90), GT), _domain, chunk=5 * DAY * 1_000_000)
_formula("until_from_start_bool", P.until(12 * H, 3 * DAY, P.lt("x", 90), GT), "bool", until_from_start=True)
_formula("until_from_start_rob", P.until(12 * H, 3 * DAY, P.lt("x", 90), GT), "rob", until_from_start=True)
for _domain in ("bool", "rob"):  # windows still close by the upper bound only, so the lower bound can be left out
    ORACLES[f"until_from_start_{_domain}"] = sql_verdicts(P.until(0, 3 * DAY, P.lt("x", 90), GT), _domain)
_formula("t2_globally_by_blocks", P.always(0, 10 * DAY, P.gt("x", 5)), "rob", block_from=DAY * 1_000_000)
_formula("t1_eventually_offset_by_blocks", P.eventually(DAY, 9 * DAY, GT), "rob", block_from=DAY * 1_000_000)

for _name, _f in {
    "eager_g": P.always(0, 2 * DAY, P.gt("x", 10)), "eager_f": P.eventually(0, 2 * DAY, P.gt("x", 80)),
    "eager_f_lower_bound": P.eventually(12 * H, 3 * DAY, P.gt("x", 80)), "eager_g_lower_bound": P.always(DAY, 3 * DAY, P.gt("x", 10)),
    "eager_and": P.lt("x", 60) & P.always(0, DAY, P.gt("x", 10)), "eager_or": P.gt("x", 90) | P.eventually(0, DAY, P.gt("x", 70)), "eager_not": ~P.always(0, DAY, P.gt("x", 10)),
    "eager_nested_g_f": P.always(0, DAY, P.eventually(0, DAY, P.gt("x", 40))), "eager_nested_f_or": P.eventually(0, DAY, P.gt("x", 90) | P.always(0, DAY, P.gt("x", 10))),
}.items():
    _register(_name, lambda spark, d, f=_f: E.eager(events_trace(spark, d), f), sql_eager(_f))
_register("eager_implies", lambda spark, d: E.eager(events_trace(spark, d), P.gt("x", 30) >> P.eventually(0, DAY, P.lt("x", 30))), sql_eager(~P.gt("x", 30) | P.eventually(0, DAY, P.lt("x", 30))))
for _name in ("eager_g", "eager_f_lower_bound", "eager_and", "eager_nested_f_or"):  # the same by parts of five days
    _f = {"eager_g": P.always(0, 2 * DAY, P.gt("x", 10)), "eager_f_lower_bound": P.eventually(12 * H, 3 * DAY, P.gt("x", 80)), "eager_and": P.lt("x", 60) & P.always(0, DAY, P.gt("x", 10)), "eager_nested_f_or": P.eventually(0, DAY, P.gt("x", 90) | P.always(0, DAY, P.gt("x", 10)))}[_name]
    _register(f"{_name}_by_chunks", lambda spark, d, f=_f: E.eager(events_trace(spark, d), f, chunk=5 * DAY * 1_000_000), ORACLES[_name])

# robustness with the time of the sample that decides it
_PAIR = "{{'v': {0}, 'at': {1}}}"


def _witnessed(spark: SparkSession, sf_dir: str, f: P.Formula, **options) -> DataFrame:
    return E.verdicts(events_trace(spark, sf_dir), f, "witness", **options).select("key", "t_us", F.when(F.abs("value.v") < float("inf"), F.col("value.v")).alias("value"), F.col("value.at").alias("witness_us"))


def _sql_witness_sweep(best: str, margin: str, start: int, end: int) -> str:
    return f"""WITH {EVENTS}, w AS (SELECT key, t_us, max(t_us) OVER (PARTITION BY key) AS ends, (SELECT {best}({_PAIR.format(margin, "m.t_us")}) FROM ev m
WHERE m.key = o.key AND m.t_us BETWEEN o.t_us + {start} AND o.t_us + {end}) AS s FROM ev o)
SELECT key, t_us, s.v AS value, s.at AS witness_us FROM w WHERE t_us + {end} <= ends"""


for _name, _options in (("", {}), ("_by_blocks", {"block_from": H * 1_000_000}), ("_by_chunks", {"chunk": 5 * DAY * 1_000_000})):
    _register(f"witness_g{_name}", lambda spark, d, o=_options: _witnessed(spark, d, P.always(0, 2 * DAY, P.gt("x", 5)), **o), _sql_witness_sweep("min", "m.x - 5.0::DOUBLE", 0, 2 * DAY * 1_000_000))
    _register(f"witness_until{_name}", lambda spark, d, o=_options: _witnessed(spark, d, P.until(0, 2 * DAY, P.lt("x", 90), P.gt("x", 60)), **o), f"""WITH {EVENTS},
p AS (SELECT o.key, o.t_us, m.t_us AS u, {_PAIR.format("m.x - 60.0::DOUBLE", "m.t_us")} AS r, (SELECT min({_PAIR.format("90.0::DOUBLE - n.x", "n.t_us")}) FROM ev n WHERE n.key = o.key AND n.t_us BETWEEN o.t_us AND m.t_us) AS l
  FROM ev o JOIN ev m ON m.key = o.key AND m.t_us BETWEEN o.t_us AND o.t_us + {2 * DAY * 1000000}),
b AS (SELECT key, t_us, max(CASE WHEN r < l THEN r ELSE l END) AS s FROM p GROUP BY key, t_us), e AS (SELECT key, max(t_us) AS ends FROM ev GROUP BY key)
SELECT b.key, t_us, s.v AS value, s.at AS witness_us FROM b JOIN e ON b.key = e.key AND t_us + {2 * DAY * 1000000} <= ends""")
_register("witness_f_offset", lambda spark, d: _witnessed(spark, d, P.eventually(DAY, 3 * DAY, P.gt("x", 40))), _sql_witness_sweep("max", "m.x - 40.0::DOUBLE", DAY * 1_000_000, 3 * DAY * 1_000_000))


def sql_eager_until(low: float, high: float, start: int, end: int) -> str:
    """x < high until x > low: true with the first right whose lefts all hold, false with the first left that fails."""
    among = lambda begin, cond: f"(SELECT min(m.seq) FROM ev m WHERE m.key = o.key AND m.t_us BETWEEN o.t_us + {begin} AND o.t_us + {end} AND {cond})"
    return f"""WITH {EVENTS},
a AS (SELECT o.*, {among(0, f"NOT m.x < {high}")} AS fails, {among(start, f"m.x > {low} AND m.x < {high}")} AS met,
  (SELECT min(m.seq) FROM ev m WHERE m.key = o.key AND m.t_us >= o.t_us + {end}) AS done FROM ev o),
b AS (SELECT *, CASE WHEN met IS NOT NULL AND (fails IS NULL OR met < fails) THEN met END AS tr FROM a),
c AS (SELECT *, least(tr, fails, done) AS came FROM b),
e AS (SELECT *, sum((came IS NULL)::INT) OVER w AS open, max(came) OVER w AS latest FROM c WINDOW w AS (PARTITION BY key ORDER BY t_us ROWS UNBOUNDED PRECEDING))
SELECT key, t_us, coalesce(tr = came, false) AS value, latest::BIGINT AS at_seq FROM e WHERE open = 0"""


for _name, _start in (("eager_until", 0), ("eager_until_lower_bound", 12 * H)):
    _register(_name, lambda spark, d, a=_start: E.eager(events_trace(spark, d), P.until(a, 2 * DAY, P.lt("x", 90), P.gt("x", 60))), sql_eager_until(60, 90, _start * 1_000_000, 2 * DAY * 1_000_000))
_register("eager_until_by_chunks", lambda spark, d: E.eager(events_trace(spark, d), P.until(12 * H, 2 * DAY, P.lt("x", 90), P.gt("x", 60)), chunk=5 * DAY * 1_000_000), ORACLES["eager_until_lower_bound"])
for _name, _f in {"interval_latest_g_by_blocks": P.always(0, 2 * DAY, P.gt("x", 10)), "interval_latest_nested_by_blocks": P.always(0, DAY, P.eventually(0, DAY, P.gt("x", 60)) & P.lt("x", 95))}.items():
    _register(_name, lambda spark, d, f=_f: E.intervals(events_trace(spark, d), f, block_from=H * 1_000_000).select("key", "t_us", _finite("lo"), _finite("hi")), sql_latest_intervals(_f))
for _name, _f in {
    "interval_latest_g": P.always(0, 2 * DAY, P.gt("x", 10)), "interval_latest_f": P.eventually(0, 2 * DAY, P.gt("x", 80)),
    "interval_latest_and": P.always(0, DAY, P.gt("x", 10)) & P.eventually(0, 2 * DAY, P.gt("x", 80)), "interval_latest_or": P.lt("x", 60) | P.always(0, 2 * DAY, P.gt("x", 40)),
    "interval_latest_not": ~P.always(0, 2 * DAY, P.gt("x", 10)), "interval_latest_nested": P.always(0, DAY, P.eventually(0, DAY, P.gt("x", 60)) & P.lt("x", 95)),
}.items():
    _register(_name, lambda spark, d, f=_f: E.intervals(events_trace(spark, d), f).select("key", "t_us", _finite("lo"), _finite("hi")), sql_latest_intervals(_f))
_UNTIL = P.until(0, 2 * DAY, P.lt("x", 90), P.gt("x", 60))
_register(
    "interval_latest_until", lambda spark, d: E.intervals(events_trace(spark, d), _UNTIL).select("key", "t_us", _finite("lo"), _finite("hi")),
    f"""WITH {EVENTS}, r AS (SELECT o.key, o.t_us, max(o.t_us) OVER (PARTITION BY o.key) AS now_us, (SELECT max(least(m.x - 60.0::DOUBLE, (SELECT min(90.0::DOUBLE - n.x) FROM ev n WHERE n.key = o.key AND n.t_us BETWEEN o.t_us AND m.t_us)))
FROM ev m WHERE m.key = o.key AND m.t_us BETWEEN o.t_us AND o.t_us + {_UNTIL.end}) AS v FROM ev o)
SELECT key, t_us, v AS lo, CASE WHEN now_us >= t_us + {_UNTIL.end} THEN v END AS hi FROM r""",
)
_TRACED = P.always(0, DAY, P.gt("x", 10))
_register("interval_trace", lambda spark, d: E.interval_trace(events_trace(spark, d), _TRACED).select("key", "now_us", "t_us", _finite("lo"), _finite("hi")), sql_interval_trace(_TRACED, 10.0))

for _name, _f in {
    "refine_g": P.always(0, 2 * DAY, P.gt("x", 10)), "refine_f_lower_bound": P.eventually(DAY, 3 * DAY, P.gt("x", 80)), "refine_until": _UNTIL,
    "refine_and_not": P.always(0, DAY, P.gt("x", 10)) & ~P.always(0, 2 * DAY, P.gt("x", 40)), "refine_nested": P.always(0, 2 * DAY, P.gt("x", 60) >> P.eventually(0, DAY, P.lt("x", 40))),
    "refine_until_nested": P.until(0, DAY, P.eventually(0, DAY, P.gt("x", 40)), P.gt("x", 60)),
}.items():
    _register(_name, lambda spark, d, f=_f: refinements(events_trace(spark, d), f, chunk=6 * DAY * 1_000_000).select("key", "now_us", "t_us", _finite("lo"), _finite("hi")), sql_refinements(P.lowered(_f)))

_register(
    "y1_strict_increasing", lambda spark, d: increasing(orders_trace(spark, d)).select("key", "t_us", "value", "seq"),
    """WITH o AS (SELECT o_custkey AS key, epoch_us(o_orderdate) AS t_us, o_totalprice AS value, o_orderkey AS seq FROM orders),
p AS (SELECT *, max(t_us) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT key, t_us, value, seq FROM p WHERE before IS NULL OR t_us > before""",
)
for _how in ("zoh", "linear"):
    _register(f"y_{_how}", lambda spark, d, how=_how: wide(events_trace(spark, d, True), ["click", "view"], how).select("key", "t_us", F.col("v_0").alias("click"), F.col("v_1").alias("view")), sql_filled(_how == "linear") + " SELECT key, t_us, click, view FROM w")
    _register(f"y_{_how}_and", lambda spark, d, how=_how: E.verdicts(events_trace(spark, d, True), P.gt("click", 30) & P.lt("view", 60), "rob", how), sql_filled(_how == "linear") + " SELECT key, t_us, least(click - 30.0::DOUBLE, 60.0::DOUBLE - view) AS value FROM w WHERE click IS NOT NULL AND view IS NOT NULL")


for _how in ("zoh", "linear"):  # the same by parts of five days, over which samples are carried
    _register(f"y_{_how}_by_chunks", lambda spark, d, how=_how: wide(events_trace(spark, d, True), ["click", "view"], how, width=5 * DAY * 1_000_000).select("key", "t_us", F.col("v_0").alias("click"), F.col("v_1").alias("view")), ORACLES[f"y_{_how}"])
    _register(f"y_{_how}_and_by_chunks", lambda spark, d, how=_how: E.verdicts(events_trace(spark, d, True), P.gt("click", 30) & P.lt("view", 60), "rob", how, chunk=5 * DAY * 1_000_000), ORACLES[f"y_{_how}_and"])


def _two_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x at all times of a user's events, y only at those of purchases and clicks."""
    by_type = events_trace(spark, sf_dir, True)
    y = by_type.where(F.col("signal").isin("click", "purchase")).withColumns({"signal": F.lit("y"), "value": 100 - F.col("value")})
    return by_type.withColumn("signal", F.lit("x")).unionByName(y)


BOTH = "ev AS (SELECT user_id AS key, epoch_us(ts) AS t_us, event_id AS seq, value AS x, CASE WHEN event_type IN ('click', 'purchase') THEN 100 - value END AS y FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"
# without synchronisation operands meet at times that both signals have; the result's window closes with the slower signal
_X, _Y = P.gt("x", 30), P.lt("y", 60)
for _domain in ("bool", "rob"):
    _l, _r, _join = ("x > 30.0::DOUBLE", "y < 60.0::DOUBLE", "l AND r") if _domain == "bool" else ("x - 30.0::DOUBLE", "60.0::DOUBLE - y", "least(l, r)")
    _register(f"y_none_two_signals_{_domain}", lambda spark, d, m=_domain: E.verdicts(_two_signals(spark, d), _X & _Y, m), f"WITH {BOTH} SELECT key, t_us, {_join} AS value FROM (SELECT *, {_l} AS l, {_r} AS r FROM ev WHERE y IS NOT NULL)")
_register(
    "y_none_two_signals_g", lambda spark, d: E.verdicts(_two_signals(spark, d), P.always(0, DAY, _X | _Y), "rob"),
    f"""WITH {BOTH}, m AS (SELECT *, max(t_us) OVER (PARTITION BY key) AS ex, max(CASE WHEN y IS NOT NULL THEN t_us END) OVER (PARTITION BY key) AS ey FROM ev),
g AS (SELECT *, min(greatest(x - 30.0::DOUBLE, 60.0::DOUBLE - y)) OVER (PARTITION BY key ORDER BY t_us RANGE BETWEEN 0 FOLLOWING AND {DAY * 1000000} FOLLOWING) AS value FROM m WHERE y IS NOT NULL)
SELECT key, t_us, value FROM g WHERE t_us + {DAY * 1000000} <= least(ex, ey)""",
)


def _changing(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = Variables(high=30)
    limits.set("high", 45, since=3000)
    limits.set("high", 60, since=7000)
    return E.verdicts(events_trace(spark, sf_dir), P.gt_var("x", "high"), "rob", bindings=limits.history)


_register("var_changelog", _changing, f"WITH {EVENTS} SELECT key, t_us, x - CASE WHEN seq >= 7000 THEN 60.0 WHEN seq >= 3000 THEN 45.0 ELSE 30.0 END::DOUBLE AS value FROM ev")

# a log of changes as a table: of all users, or each user's own
_LOGS = {
    "var_table": ("SELECT o_orderkey AS effective_seq, o_totalprice % 97 AS value FROM orders", False),
    "var_table_by_key": ("SELECT o_custkey AS key, o_orderkey AS effective_seq, o_totalprice % 97 AS value FROM orders", True),
}


def _log(spark: SparkSession, sf_dir: str, keyed: bool) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(*([F.col("o_custkey").alias("key")] if keyed else []), F.col("o_orderkey").alias("effective_seq"), (F.col("o_totalprice") % 97).alias("value"))


for _name, (_sql, _keyed) in _LOGS.items():
    _on = "ev.key = c.key AND " if _keyed else ""
    _as_of = f"WITH {EVENTS}, c AS ({_sql}), w AS (SELECT ev.key, t_us, x - c.value AS value, max(t_us) OVER (PARTITION BY ev.key) AS ends FROM ev ASOF LEFT JOIN c ON {_on}ev.seq >= c.effective_seq)"
    _register(_name, lambda spark, d, k=_keyed: E.verdicts(events_trace(spark, d), P.gt_var("x", "high"), "rob", bindings={"high": _log(spark, d, k)}), f"{_as_of} SELECT key, t_us, value FROM w WHERE value IS NOT NULL")
    _register(f"{_name}_g", lambda spark, d, k=_keyed: E.verdicts(events_trace(spark, d), P.always(0, DAY, P.gt_var("x", "high")), "bool", bindings={"high": _log(spark, d, k)}), f"""{_as_of}, k AS (SELECT key, t_us, value, ends FROM w)
SELECT key, t_us, min(value > 0) OVER (PARTITION BY key ORDER BY t_us RANGE BETWEEN 0 FOLLOWING AND {DAY * 1000000} FOLLOWING) AS value FROM k QUALIFY t_us + {DAY * 1000000} <= ends AND k.value IS NOT NULL""")


_WATCH = Monitor("F[0,172800](x > 40)")


def _first_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = events_trace(spark, sf_dir)
    first = _WATCH.verdicts(trace).agg(F.min("t_us")).first()[0]
    return _WATCH.verdict_at(trace, first or 0)


_CLOSED = f"""WITH {EVENTS}, a AS (SELECT *, max(x - 40.0::DOUBLE) OVER (PARTITION BY key ORDER BY t_us RANGE BETWEEN 0 FOLLOWING AND {2 * DAY * 1000000} FOLLOWING) AS value,
min(seq) OVER (PARTITION BY key ORDER BY t_us RANGE BETWEEN {2 * DAY * 1000000} FOLLOWING AND UNBOUNDED FOLLOWING) AS at_seq FROM ev), m AS (SELECT key, t_us, value, at_seq FROM a WHERE at_seq IS NOT NULL)"""
_register("m1_verdicts", lambda spark, d: _WATCH.verdicts(events_trace(spark, d)), f"{_CLOSED} SELECT key, t_us, value FROM m")
_register("m2_emissions", lambda spark, d: _WATCH.emissions(events_trace(spark, d)), f"{_CLOSED} SELECT key, t_us, value, at_seq FROM m")
_register("m3_counts", lambda spark, d: _WATCH.counts(events_trace(spark, d)), f"{_CLOSED} SELECT key, count(*) AS n_emissions, count(DISTINCT t_us) AS n_verdicts FROM m GROUP BY key")
_register("m5_verdict_at", _first_time, f"{_CLOSED} SELECT key, t_us, value FROM m WHERE t_us = (SELECT min(t_us) FROM m)")
_register("m4_has_verdicts", lambda spark, d: _WATCH.has_verdicts(events_trace(spark, d)), f"{_CLOSED} SELECT key, count(m.t_us) > 0 AS has_verdicts FROM (SELECT DISTINCT key FROM ev) k LEFT JOIN m USING (key) GROUP BY key")
_register("m4_has_outputs", lambda spark, d: _WATCH.has_outputs(events_trace(spark, d)), f"{_CLOSED} SELECT e.key, e.t_us, e.seq, o.at_seq IS NOT NULL AS has_outputs FROM ev e LEFT JOIN (SELECT DISTINCT key, at_seq FROM m) o ON o.key = e.key AND o.at_seq = e.seq")
_register("m9_display", lambda spark, d: Monitor("G[0,86400](x > 10)", "delayed_bool").display(events_trace(spark, d)), f"SELECT key, t_us, printf('t=%.6fs: %s', t_us / 1000000.0, CASE WHEN value THEN 'true' ELSE 'false' END) AS line FROM ({sql_verdicts(P.always(0, DAY, P.gt('x', 10)), 'bool')})")
_register("m12_records", lambda spark, d: _WATCH.records(events_trace(spark, d)).select("key", "t_us", "seq", "signal", "value", F.size("outputs").alias("n_outputs"), F.try_element_at("outputs", F.lit(-1))["t_us"].alias("last_t_us")), f"""{_CLOSED}, o AS (SELECT key, at_seq, count(*) AS n, max(t_us) AS last FROM m GROUP BY key, at_seq)
SELECT e.key, e.t_us, e.seq, 'x' AS signal, e.x AS value, coalesce(o.n, 0)::INT AS n_outputs, o.last AS last_t_us FROM ev e LEFT JOIN o ON o.key = e.key AND o.at_seq = e.seq""")
_register("m6_latest", lambda spark, d: _WATCH.latest(events_trace(spark, d)), f"{_CLOSED} SELECT key, t_us, value, at_seq FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY at_seq DESC, t_us DESC) = 1")
_register("m8_evaluations", lambda spark, d: _WATCH.evaluations(events_trace(spark, d)).select("key", "at", F.size("outputs").alias("n_outputs"), F.element_at("outputs", -1)["t_us"].alias("last_t_us")), f"{_CLOSED} SELECT key, at_seq AS at, count(*)::INT AS n_outputs, max(t_us) AS last_t_us FROM m GROUP BY key, at_seq")
_register(
    "m7_dropped", lambda spark, d: Monitor("x > 1").dropped(orders_trace(spark, d)).select("key", "t_us", "seq"),
    """WITH o AS (SELECT o_custkey AS key, epoch_us(o_orderdate) AS t_us, o_orderkey AS seq FROM orders),
p AS (SELECT *, max(t_us) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT key, t_us, seq FROM p WHERE before IS NOT NULL AND t_us <= before""",
)


# -- streams over the events, in micro-batches of their arrival ------------------------------

_PUSHED = P.always(0, 2 * DAY, P.gt("x", 5))


def _pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    KeyedMonitor(_PUSHED).start(replay(events_trace(spark, sf_dir), 5), f"{out}/verdicts", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/verdicts")


def _latest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, monitor = scratch(spark), KeyedMonitor(_PUSHED, "interval")
    view = LatestVerdicts(f"{out}/view", 5 * DAY * 1_000_000, every=2)
    monitor.keep(replay(events_trace(spark, sf_dir), 5), view, f"{out}/checkpoint").awaitTermination()
    return view.read(spark).select("key", "t_us", _finite("lo"), _finite("hi"))


_register("s1_push_events", _pushed, sql_verdicts(_PUSHED, "rob"))
_register("m1_latest_view", _latest_view, sql_latest_intervals(_PUSHED))


def _csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    events = events_trace(spark, sf_dir).repartitionByRange(5, "seq").sortWithinPartitions("seq")
    events.select((F.col("t_us") / 1_000_000).alias("timestep"), "value").write.csv(folder, header=True)
    return read_csv(spark, folder, rate=10).select("t_us", "value", "seq")


_register("s3_csv_row_number", _csv_rows, f"WITH {EVENTS}, n AS (SELECT x AS value, row_number() OVER (ORDER BY seq) - 1 AS seq FROM ev) SELECT seq * 100000 AS t_us, value, seq FROM n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robustness of ``always, for a day, x above 10`` for every user and closed time."""
    return E.verdicts(events_trace(spark, sf_dir), P.always(0, DAY, P.gt("x", 10)))
