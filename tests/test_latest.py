"""The view of latest verdicts: one row per time, a bounded number of files, batches that come again."""

import random

from pyspark.sql import functions as F

from tempora.streaming.latest import LatestVerdicts

S = 1_000_000


def test_one_row_per_time_and_bounded_files(spark, tmp_path):
    rnd = random.Random(1)
    view, want, most = LatestVerdicts(str(tmp_path / "view"), 10 * S, 5), {}, 0
    for batch in range(40):
        rows = {(rnd.choice("ab"), (batch + rnd.randint(0, 6)) * S): (float(batch), rnd.random()) for _ in range(6)}
        df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "key string, t_us long, lo double, hi double")
        view.merge(df, batch)
        if batch in (3, 17, 24):  # again, also after a merge
            view.merge(df, batch)
        want |= {k: (*v, batch) for k, v in rows.items()}
        most = max(most, len([p for p in (tmp_path / "view").rglob("*.parquet")]))
        if batch in (0, 9, 39):
            got = view.read(spark).select("key", "t_us", "lo", "hi", "batch").collect()
            assert {(r.key, r.t_us): (r.lo, r.hi, r.batch) for r in got} == want and len(got) == len(want)
    assert most <= 5 + 1 + 5 + 2  # new ones of five batches, and a file for each bucket of time


def test_a_merge_that_was_cut_short_changes_nothing(spark, tmp_path):
    view = LatestVerdicts(str(tmp_path / "view"), 10 * S, 2)
    frame = lambda v: spark.createDataFrame([("a", S, v), ("a", 30 * S, v)], "key string, t_us long, value double")
    view.merge(frame(1.0), 0)
    view.merge(frame(2.0), 1)
    view._delete = lambda *_: None  # what was merged stays beside
    for batch in (2, 3, 4, 5):
        view.merge(frame(float(batch + 1)), batch)
    got = LatestVerdicts(view.folder, 10 * S, 2).read(spark).collect()
    assert sorted((r.t_us, r.value) for r in got) == [(S, 6.0), (30 * S, 6.0)]


def test_what_yields_a_batch_keeps_its_tasks(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.col("id").alias("key"), (F.col("id") * S).alias("t_us"), F.spark_partition_id().alias("task"))
    view = LatestVerdicts(str(tmp_path / "view"))
    view.merge(rows, 0)
    assert {r.task for r in view.read(spark).select("task").collect()} == {0, 1, 2, 3}
    assert len(list((tmp_path / "view").rglob("*.parquet"))) == 1
