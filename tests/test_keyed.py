"""The keyed state operator against the batch plans: order, lateness, replays, restarts, bounded state."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.operators import evaluate as E
from tempora.plans.notation import formula
from tempora.sources.traces import events_trace
from tempora.streaming.keyed import KeyedMonitor, _LEAVES, _SAMPLE, _packed, _unpacked, replayed

SCHEMA = "key long, signal string, t_us long, value double, seq long"
SF = "/root/testdata/sf0.001"
S = 1_000_000


def samples(signals, n=150, keys=3, seed=1):
    """Rows in order of arrival; signals lag behind each other at times."""
    rnd = random.Random(seed)
    rows, at = [], {k: {s: 0 for s in signals} for k in range(keys)}
    for seq in range(n):
        k, s = rnd.randrange(keys), rnd.choice(signals)
        at[k][s] = max(at[k].values()) + rnd.randint(-2, 3) if rnd.random() < 0.3 else at[k][s] + rnd.randint(0, 2)
        rows.append((k, s, max(1, at[k][s]) * S, rnd.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) + rnd.random() * (seq % 2), seq))
    return rows


def write(spark, rows, source):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def read(spark, source):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)


def run(spark, tmp, monitor, batches, name="run"):
    for b in batches:
        write(spark, b, f"{tmp}/in-{name}")
    query = monitor.start(read(spark, f"{tmp}/in-{name}"), f"{tmp}/out-{name}", f"{tmp}/check-{name}")
    query.awaitTermination()
    return query, [tuple(r) for r in spark.read.parquet(f"{tmp}/out-{name}").collect()]


def parts(rows, n):
    return [list(b) for b in itertools.batched(rows, -(-len(rows) // n))]


@pytest.mark.parametrize(
    "text, signals, synchronize, semantics",
    [
        ("G[0,5](x > -0.5 -> F[1,4](x < 0.6))", ["x"], "none", "delayed_rob"), ("(x > 0) U[1,6] (y > 0.5)", ["x", "y"], "zoh", "delayed_rob"),
        ("F[0,6](x > 0 && y < 0.2) || !(y > 1)", ["x", "y"], "linear", "delayed_rob"), ("G[0,3](x > 0) && y >= 0", ["x", "y"], "none", "delayed_bool"),
        ("true U[0,4] (x > $limit)", ["x"], "none", "delayed_bool"),
    ],
)
def test_closing_by_data_gives_the_batch_verdicts_once(spark, tmp_path, text, signals, synchronize, semantics):
    rows, bound = samples(signals), {"limit": [(-1, 0.3), (70, 1.2)]}
    f = formula(text)
    want = sorted(map(tuple, E.verdicts(spark.createDataFrame(rows, SCHEMA), f, semantics.removeprefix("delayed_"), synchronize, bound).collect()))
    _, got = run(spark, tmp_path, KeyedMonitor(f, semantics, synchronize, bound), parts(rows, 4))
    assert sorted(got) == want and len(got) > 15


def test_intervals_leave_when_they_change(spark, tmp_path):
    rows, f = samples(["x"], keys=1), formula("G[0,4](x > 0) || F[0,2](x < 0.4)")
    latest, batches = {}, parts(rows, 5)
    write_all = KeyedMonitor(f, "interval")
    _, got = run(spark, tmp_path, write_all, batches)
    want = []
    for k in range(len(batches)):  # what batch plans see after each part, and only what has changed
        for r in E.intervals(spark.createDataFrame(sum(batches[: k + 1], []), SCHEMA), f).collect():
            if latest.get((r.key, r.t_us)) != (r.lo, r.hi):
                latest[r.key, r.t_us] = (r.lo, r.hi)
                want.append(tuple(r))
    assert sorted(got) == sorted(want)


def test_any_order_within_the_lateness_and_each_batch_twice(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, "x", t * S, rnd.uniform(-1, 1), 10 * t + k) for t in range(1, 121) for k in range(2)]
    shuffled = sorted(rows, key=lambda r: r[2] + rnd.randint(0, 9 * S))
    f, n = formula("G[0,7](x > -0.8)"), 4
    batches = [b for part in parts(shuffled, n) for b in (part, part)]
    query, got = run(spark, tmp_path, KeyedMonitor(f, lateness=10 * S), batches)
    closed = [r for r in E.verdicts(spark.createDataFrame(rows, SCHEMA), f).collect() if r.t_us + 7 * S <= (120 - 10) * S]
    assert sorted(got) == sorted(map(tuple, closed)) and len(got) > 190
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * 2 * (7 + 10 + 10 + 4)


def test_windows_close_by_timers_where_nothing_follows(spark, tmp_path):
    rows = [(1, "x", S, 1.0, 0), (1, "x", 2 * S, -1.0, 1), (2, "x", 60 * S, 1.0, 2)]
    query, got = run(spark, tmp_path, KeyedMonitor(formula("F[0,5](x > 0)"), "delayed_bool", lateness=S), [rows[:2], rows[2:]])
    assert sorted(got) == [(1, S, True), (1, 2 * S, False)]


def test_keys_of_text(spark, tmp_path):
    source = f"{tmp_path}/in"
    for b in ([("a", "x", S, 1.0, 0)], [("a", "x", 4 * S, 1.0, 1), ("b", "x", S, 1.0, 2)]):
        spark.createDataFrame(b, SCHEMA.replace("key long", "key string")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA.replace("key long", "key string")).option("maxFilesPerTrigger", 1).parquet(source)
    KeyedMonitor(formula("G[0,2](x > 0)")).start(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("a", S, 1.0)]


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    rows, f = samples(["x"], 120), formula("F[0,6](x > 1) && G[0,2](x > -2)")
    monitor, all_parts = KeyedMonitor(f), parts(rows, 4)
    run(spark, tmp_path, monitor, all_parts[:2])
    _, got = run(spark, tmp_path, monitor, all_parts[2:])
    assert sorted(got) == sorted(map(tuple, E.verdicts(spark.createDataFrame(rows, SCHEMA), f).collect()))


def test_two_streams_wait_for_the_slower(spark, tmp_path):
    rnd = random.Random(5)
    x, y = ([(k, s, t * S, rnd.uniform(-1, 1), 2 * t + (s == "y")) for t in range(60) for k in range(2)] for s in "xy")
    for source, rows in (("x", parts(x, 6)), ("y", parts(y[:60], 3))):  # y stops at half
        for b in rows:
            write(spark, b, f"{tmp_path}/{source}")
    both = read(spark, f"{tmp_path}/x").unionByName(read(spark, f"{tmp_path}/y"))
    f = formula("G[0,4](x > -0.5 || y > 0)")
    KeyedMonitor(f).start(both, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, E.verdicts(spark.createDataFrame(x + y[:60], SCHEMA), f).collect())) and len(got) == 2 * 26


def test_replayed_samples_are_left_out(spark, tmp_path):
    rows = samples(["x"], 60)
    for b in parts(rows, 3):
        write(spark, b, f"{tmp_path}/in")
        write(spark, b, f"{tmp_path}/in")
    out = replayed(read(spark, f"{tmp_path}/in"), "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
    out.trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_events_in_twenty_batches(spark, tmp_path):
    f = formula("G[0,86400](x < 200)")
    trace = events_trace(spark, SF)
    rows = sorted((tuple(r) for r in trace.collect()), key=lambda r: r[4])
    query, got = run(spark, tmp_path, KeyedMonitor(f), parts(rows, 20))
    assert sorted(got) == sorted(map(tuple, E.verdicts(trace, f).collect()))
    assert len(query.recentProgress) >= 20
    # a day of each key, what has left of it, and its last sample and bound
    day = trace.groupBy("key", F.floor(F.col("t_us") / (86400 * S))).count().agg(F.max("count")).first()[0]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= trace.select("key").distinct().count() * (4 * day + 4)


def test_arguments():
    with pytest.raises(ValueError):
        KeyedMonitor(formula("x > 0"), "eager")
    with pytest.raises(ValueError):
        KeyedMonitor(formula("x > $c"))
    with pytest.raises(ValueError):
        KeyedMonitor(formula("x > 0"), lateness=1, idle=1)


def test_a_key_is_one_value_in_the_state():
    samples, left = np.array([(1, 5, 0.5, 9), (0, -3, float("inf"), 2)], _SAMPLE), np.array([(5, -1.0, 1.0)], _LEAVES)
    for bound in (None, 0, -(2**62)):
        for a, b in ((samples, left), (samples[:0], left[:0])):
            x, y, z = _unpacked(_packed(a, b, bound))
            assert x.tolist() == a.tolist() and y.tolist() == b.tolist() and z == bound
    assert _unpacked(None)[2] is None
