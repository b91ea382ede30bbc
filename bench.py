"""Headline queries timed on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

The ``chirp_*`` queries monitor many traces of 20,000 samples at once, the shape that the published
single-trace figures have; ``samples_per_s`` gives their throughput.  Each query runs once to warm
its code up and then REPEATS times, of which the median counts.  ``chirp_{u,g,f}_<b>`` are until,
globally and eventually over 0 to b seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tempora import queries as Q  # noqa: E402
from tempora.operators import evaluate as E  # noqa: E402
from tempora.plans.catalog import BENCHMARK, HIGH, LOW  # noqa: E402
from tempora.plans.formula import always, eventually, until  # noqa: E402
from tempora.sources.traces import chirp  # noqa: E402

KEYS, SAMPLES, REPEATS = 64, 20_000, 3
FAMILY = {f"{n}_{b}": f for b in (100, 1000, 5000) for n, f in (("u", until(0, b, LOW, HIGH)), ("g", always(0, b, LOW)), ("f", eventually(0, b, LOW)))}
NAMES = (
    "p1_gt_rob", "b2_and_bool", "t2_globally_rob", "t1_eventually_bool", "t3_until_bool", "t3_until_rob", "nested_g_f_rob", "catalog_15_and_eventually_5",
    "phi1", "phi2", "phi3", "t2_globally_by_blocks", "eager_g", "eager_until", "interval_latest_g", "interval_trace", "y1_strict_increasing", "y_zoh_and", "y_linear_and", "m3_counts", "eager_until_lower_bound", "var_table", "y_zoh_by_chunks", "witness_g",
)


def chirps(spark: SparkSession) -> DataFrame:
    keys = spark.range(KEYS).select(F.col("id").cast("string").alias("key"))
    return chirp(spark, SAMPLES).drop("key").crossJoin(F.broadcast(keys)).select("key", "signal", "t_us", "value", "seq")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(2 * cpus)).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {n: (lambda n=n: Q.QUERIES[n](spark, sf_dir)) for n in NAMES}
    trace = chirps(spark).repartition(2 * cpus, "key").persist()
    trace.count()
    for name, f in (BENCHMARK | FAMILY).items():
        for domain in ("bool", "rob"):
            runs[f"chirp_{name}_{domain}"] = lambda f=f, d=domain: E.verdicts(trace, f, d, block_from=200_000_000)
    for name, f in BENCHMARK.items():
        runs[f"chirp_{name}_eager"] = lambda f=f: E.eager(trace, f)
        runs[f"chirp_{name}_interval"] = lambda f=f: E.intervals(trace, f, block_from=200_000_000)
    Q.QUERIES["phi2"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    took = {}
    for name, run in runs.items():
        several = []
        for _ in range(2 if name.removeprefix("chirp_")[:2] in ("u_", "g_", "f_") else 1 + REPEATS):
            start = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            several.append(time.perf_counter() - start)
        took[name] = round(median(several[1:] or several), 3)
    speed = {n: round(KEYS * SAMPLES / s) for n, s in took.items() if n.startswith("chirp_")}
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "samples_per_s": speed}))


if __name__ == "__main__":
    main()
