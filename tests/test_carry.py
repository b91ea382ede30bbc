"""Values carried over parts of an axis, as-of joins with change logs, alignment by parts."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import evaluate as E
from tempora.operators.carry import as_of, carried, changes
from tempora.operators.sync import wide
from tempora.plans.notation import formula

TRACE = "key string, signal string, t_us long, value double, seq long"
S = 1_000_000


def test_carried_both_ways(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", None, "b"]), t, rnd.choice([None, None, float(t)])) for t in rnd.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "key string, t long, v double")
    got = carried(df, ["key"], ["t"], F.floor(F.col("t") / 50), {"before": F.col("v")}, {"after": F.col("v")})
    assert got.columns == ["key", "t", "v", "before", "after"]
    for r in got.collect():
        own = sorted(t for k, t, v in rows if k == r.key and v is not None)
        i, j = bisect.bisect_right(own, r.t), bisect.bisect_left(own, r.t)
        assert (r.before, r.after) == (float(own[i - 1]) if i else None, float(own[j]) if j < len(own) else None)
    assert got.count() == len(rows)


@pytest.mark.parametrize("width", [7, 1 << 20])
def test_as_of_takes_the_latest_change(spark, width):
    rnd = random.Random(2)
    trace = [(rnd.choice("ab"), "x", q * S, rnd.random(), q) for q in range(200)]
    log = [("hi", rnd.choice("ab"), rnd.randrange(-5, 230), rnd.random()) for _ in range(40)] + [("hi", "a", None, 9.0), ("hi", "a", 3, None), ("hi", "b", 100, 0.1), ("hi", "b", 100, 0.9)]
    log += [("lo", rnd.choice("ab"), rnd.randrange(230), rnd.random()) for _ in range(3)]
    samples, table = spark.createDataFrame(trace, TRACE), spark.createDataFrame(log, "name string, key string, effective_seq long, value double")
    for keyed in (True, False):
        logs = changes(table if keyed else table.drop("key"), "hi", "lo")
        got = as_of(samples.withColumn("extra", F.lit(1)), logs, width).collect()
        assert len(got) == 200
        for r in got:
            for name in ("hi", "lo"):
                own = [(q, v) for n, k, q, v in log if n == name and q is not None and v is not None and q <= r.seq and (not keyed or k == r.key)]
                assert r[name] == (max(own)[1] if own else None)


def test_variables_of_a_table_in_formulas(spark):
    rnd = random.Random(3)
    trace = [("a", s, (3 * t + (s == "y")) * S, rnd.uniform(-1, 1), 2 * t + (s == "y")) for t in range(60) for s in "xy"]
    log = [(0, -0.5), (30, 0.1), (77, 0.4)]
    table = spark.createDataFrame([(q, v) for q, v in log], "effective_seq long, value double")
    df, some = spark.createDataFrame(trace, TRACE), 0
    for text, how in (("G[0,9](x > $c) || y < $c", "zoh"), ("F[0,9](x > $c && y > $d)", "linear"), ("x > $c U[0,6] x < $d", "none")):
        f, bound = formula(text), {"c": table, "d": 0.3}
        for semantics in (lambda b, f=f, how=how: E.verdicts(df, f, "rob", how, b), lambda b, f=f, how=how: E.verdicts(df, f, "bool", how, b, chunk=40 * S), lambda b, f=f, how=how: E.eager(df, f, how, b), lambda b, f=f, how=how: E.intervals(df, f, how, b)):
            want = sorted(map(tuple, semantics({"c": log, "d": 0.3}).collect()))
            assert sorted(map(tuple, semantics(bound).collect())) == want
            some += len(want)
    assert some > 500


@pytest.mark.parametrize("how", ["zoh", "linear"])
def test_alignment_by_parts_equals_whole_keys(spark, how):
    rnd = random.Random(4)
    trace = [(rnd.choice("aab"), rnd.choice("xxxyz"), t * S, rnd.uniform(-1, 1), t) for t in rnd.sample(range(2000), 500)]
    df = spark.createDataFrame(sorted(trace, key=lambda r: r[4]), TRACE)
    want = sorted(map(tuple, wide(df, ["x", "y", "z"], how).collect()), key=str)
    for width in (3 * S, 100 * S, 10_000 * S):
        assert sorted(map(tuple, wide(df, ["x", "y", "z"], how, width=width).select(*wide(df, ["x", "y", "z"], how).columns).collect()), key=str) == want


def test_one_long_key_is_filled_in_many_tasks(spark):
    """No sort of the plan holds more than a part of the key's time."""
    n = 200_000
    x = spark.range(n).select(F.lit("").alias("key"), F.lit("x").alias("signal"), (F.col("id") * 1000).alias("t_us"), F.col("id").cast("double").alias("value"), F.col("id").alias("seq"))
    y = spark.range(0, n, 1000).select(F.lit("").alias("key"), F.lit("y").alias("signal"), (F.col("id") * 1000 + 500).alias("t_us"), F.col("id").cast("double").alias("value"), F.col("id").alias("seq"))
    out = wide(x.unionByName(y), ["x", "y"], "zoh", arrivals=10_000, width=10_000_000)
    got = out.agg(F.count("*"), F.sum("v_0"), F.sum("v_1")).first()
    assert got[0] == n + n // 1000 and got[1] == n * (n - 1) / 2 + sum(range(0, n, 1000))
    assert got[2] == sum((i - 1) // 1000 * 1000 for i in range(1, n - 999)) + sum(range(0, n, 1000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows into one task
    try:
        assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 0.6 * n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
