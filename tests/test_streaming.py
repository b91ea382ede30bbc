from pyspark.sql import functions as F

from tempora.operators import evaluate as E
from tempora.plans.notation import formula
from tempora.streaming.online import OnlineMonitor

SCHEMA = "key long, signal string, t_us long, value double, seq long"


def feed(spark, tmp_path, text, synchronize, signals, semantics="delayed_rob"):
    rows = spark.range(240).select(
        (F.col("id") % 3).alias("key"), F.element_at(F.array(*map(F.lit, signals)), (F.col("id") % len(signals) + 1).cast("int")).alias("signal"),
        (F.col("id") * 700_000).alias("t_us"), F.sin(F.col("id") * 0.37).alias("value"), F.col("id").alias("seq"),
    )
    source = str(tmp_path / "in")
    for k in range(4):
        rows.where((F.col("seq") >= 60 * k) & (F.col("seq") < 60 * k + 60)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    monitor = OnlineMonitor(formula(text), str(tmp_path / "run"), semantics, synchronize)
    monitor.start(stream, str(tmp_path / "check")).awaitTermination()
    return rows, monitor


def test_stream_gives_the_batch_verdicts_once(spark, tmp_path):
    text = "G[0,5](x > -0.5 -> F[0,4](x < 0))"
    rows, monitor = feed(spark, tmp_path, text, "none", ["x"])
    want = sorted(E.verdicts(rows, formula(text)).collect())
    got = sorted(monitor.verdicts(spark).select("key", "t_us", "value").collect())
    assert got == want and len(got) > 100


def test_stream_of_two_signals_is_held(spark, tmp_path):
    text = "F[0,6](x > 0 && y < 0.2)"
    rows, monitor = feed(spark, tmp_path, text, "zoh", ["x", "y"])
    batch = E.verdicts(rows, formula(text), synchronize="zoh")
    want = {(r.key, r.t_us): r.value for r in batch.collect()}
    got = [(r.key, r.t_us, r.value) for r in monitor.verdicts(spark).collect()]
    assert len(got) == len({g[:2] for g in got}) and len(got) > 50
    assert all(want[k, t] == v for k, t, v in got)


def test_eager_stream_gives_the_batch_decisions_once(spark, tmp_path):
    text = "F[0,6](x > 0.3) && G[0,2](x > -2)"
    rows, monitor = feed(spark, tmp_path, text, "none", ["x"], "eager")
    want = sorted(E.eager(rows, formula(text)).collect())
    got = sorted(monitor.verdicts(spark).select("key", "t_us", "value", "at_seq").collect())
    assert got == want and len(got) > 100


def test_interval_stream_tightens_to_the_batch_intervals(spark, tmp_path):
    text = "G[0,6](x > -0.5)"
    rows, monitor = feed(spark, tmp_path, text, "none", ["x"], "interval")
    latest = {}
    for r in sorted(monitor.verdicts(spark).collect(), key=lambda r: r.batch):
        lo, hi = latest.get((r.key, r.t_us), (float("-inf"), float("inf")))
        assert lo <= r.lo <= r.hi <= hi
        latest[r.key, r.t_us] = (r.lo, r.hi)
    assert latest == {(r.key, r.t_us): (r.lo, r.hi) for r in E.intervals(rows, formula(text)).collect()}


def test_variables_are_read_anew_and_old_state_goes(spark, tmp_path):
    limits = iter([0.0, 0.5, -0.5])
    monitor = OnlineMonitor(formula("x > $limit"), str(tmp_path / "run"), "delayed_bool", bindings=lambda: {"limit": next(limits)})
    for batch in range(3):
        rows = [(1, "x", batch * 10 + t, v, batch * 10 + t) for t, v in enumerate((-0.7, -0.2, 0.2, 0.7))]
        monitor.process(spark.createDataFrame(rows, SCHEMA), batch)
    got = [r.value for r in sorted(monitor.verdicts(spark).collect(), key=lambda r: r.t_us)]
    assert got == [False, False, True, True] + [False, False, False, True] + [False, True, True, True]
    assert sorted(p.name for p in (tmp_path / "run" / "state").iterdir() if not p.name.startswith(".")) == ["1", "2"]


def test_idle_keys_are_forgotten(spark, tmp_path):
    monitor = OnlineMonitor(formula("x > 0 && y > 0"), str(tmp_path / "run"), "delayed_bool", idle=50)
    monitor.process(spark.createDataFrame([(1, "x", 0, 1.0, 0), (2, "x", 5, 1.0, 1)], SCHEMA), 0)
    monitor.process(spark.createDataFrame([(2, "x", 60, 1.0, 2), (2, "y", 60, 1.0, 3)], SCHEMA), 1)
    assert {r.key for r in spark.read.parquet(str(tmp_path / "run" / "state" / "1")).select("key").collect()} == {2}
    assert [(r.key, r.t_us, r.value) for r in monitor.verdicts(spark).collect()] == [(2, 60, True)]
