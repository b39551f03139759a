"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ["cumulative_all", "cumulative_grouped", "incremental_tail", "dedup_overlap", "log_replay_all", "log_replay_from", "json_decode", "join_inner", "join_asof", "agg_basic", "win_rows", "topk", "session"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    own = tempfile.mkdtemp()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", f"{own}/warehouse").config("spark.checkpoint.dir", f"{own}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from seqlake import catalog
    from seqlake.plans.dataset import Dataset

    every, took = catalog.queries(), {}
    t = time.time()
    catalog.engine(spark, sf_dir)
    took["materialize_cold"] = round(time.time() - t, 3)  # the session's first job
    each = []
    for k in range(runs):
        t = time.time()
        Dataset(spark, f"{own}/shared/again-{k}", catalog.N).publish(catalog.as_records(catalog.table(spark, sf_dir, "events")))
        each.append(time.time() - t)
    took["materialize"] = round(statistics.median(each), 3)
    for name in HEADLINE:
        each = []
        for _ in range(runs + 1):  # the first run compiles, and writes what the query needs once
            t = time.time()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.time() - t)
        took[name] = round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
