"""Domains with values of other types, and row numbers of CSV files."""

import random

from pyspark.sql import functions as F

from tempora.functions.algebra import Robustness
from tempora.operators import evaluate as E
from tempora.plans.formula import always, eventually, gt, lt, until
from tempora.sources import traces

TRACE = "key string, signal string, t_us long, value double, seq long"
S = 1_000_000


def test_witness_is_where_the_value_comes_from(spark):
    rnd = random.Random(3)
    rows = [("k", s, t * S, float(rnd.randint(-9, 9)), 2 * t + (s == "y")) for t in range(80) for s in "xy"]
    at = {(r[1], r[2]): r[3] for r in rows}
    df = spark.createDataFrame(rows, TRACE)
    for f in (always(0, 6, gt("x", 1) | lt("y", 2)), until(2, 7, gt("x", -5), lt("y", 3)), ~eventually(1, 5, gt("x", 0) & ~gt("y", 0))):
        plain = {r.t_us: r.value for r in E.verdicts(df, f).collect()}
        for options in ({}, {"block_from": 1}, {"chunk": 20 * S}):
            got = {r.t_us: r.value for r in E.verdicts(df, f, "witness", **options).collect()}
            assert {t: w.v for t, w in got.items()} == plain and plain
            for t, w in got.items():
                assert t <= w.at <= t + f.depth()
                assert w.v in {abs_ for s, c in (("x", 1), ("x", -5), ("x", 0), ("y", 2), ("y", 3), ("y", 0)) for abs_ in (at[s, w.at] - c, c - at[s, w.at])}


class Count(Robustness):
    """Robustness in whole numbers."""

    name, sql_type = "count", "bigint"

    @staticmethod
    def compare(x, op, c):
        return F.round(Robustness.compare(x, op, c)).cast("long")

    @staticmethod
    def constant(value):
        return F.lit(2**62 if value else -(2**62))


def test_a_domain_of_the_users(spark):
    rows = [("k", "x", t * S, t % 5 + 0.2, t) for t in range(30)]
    df = spark.createDataFrame(rows, TRACE)
    got = {r.t_us // S: r.value for r in E.verdicts(df, always(0, 2, gt("x", 1)), Count).collect()}
    assert got == {t: min(u % 5 - 1 for u in range(t, t + 3)) for t in range(28)}
    got = {r.t_us // S: r.value for r in E.verdicts(df, until(0, 2, lt("x", 4), gt("x", 1)), Count, block_from=1).collect()}
    assert got == {t: max(min(u % 5 - 1, min(4 - w % 5 for w in range(t, u + 1))) for u in range(t, t + 3)) for t in range(28)}


def test_row_numbers_over_files_and_their_pieces(spark, tmp_path):
    lines = [f"{t / 10},{t * 7 % 101}" for t in range(5000)]
    lines[77], lines[4000], lines[4500] = "not a number,1", "5,6,7", "450,"
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"part-{k}.csv").write_text("\n".join(["timestep,value", *lines[1000 * k : 1000 * (k + 1)]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several pieces a file
    try:
        got = traces.read_csv(spark, str(tmp_path / "in"), rate=2).orderBy("seq").collect()
        assert [r.seq for r in got] == [t for t in range(5000) if t not in (77, 4000, 4500)]
        assert all(r.t_us == r.seq * 500_000 and r.value == r.seq * 7 % 101 for r in got)
        assert [tuple(r) for r in traces.rejected_csv(spark, str(tmp_path / "in")).orderBy("row").collect()] == [(77, "not a number,1"), (4000, "5,6,7"), (4500, None)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert traces.read_csv(spark, str(tmp_path / "in")).where("seq = 100000").count() == 1  # by the column: 0.1 s a step
