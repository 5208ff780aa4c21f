"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to compile and then twice into a sink that keeps nothing; the faster run counts. Rates are
rows of work (commands folded, keys probed, pairs scored) a second.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from keyfold.plans import catalog

#: What each rate counts.
WORK = {
    "replay_array": ("commands", "events", 1),
    "replay_rbtree": ("commands", "events", 1),
    "replay_hash": ("commands", "events", 1),
    "replay_skiplist": ("commands", "events", 1),
    "replay_mixed": ("commands", "events", 4),
    "state_array": ("commands", "events", 1),
    "aof_effective_log": ("commands", "events", 1),
    "kv_get": ("probes", "orders", 2),
    "kv_exist": ("probes", "lineitem", 2),
    "kv_ttl": ("probes", "lineitem", 2),
    "kv_set_upsert": ("writes", "orders", 1),
    "kv_expire": ("writes", "lineitem", 1),
    "expired_scan": ("rows", "orders", 1),
    "resp_encode_set": ("frames", "part", 1),
    "vsearch_topk": ("scores", "embeddings", 1),
    "vsearch_threshold": ("scores", "embeddings", 1),
    "vsearch_multi": ("scores", "embeddings", lambda n: n // 20),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds, rates = catalog.queries(), {}, {}
    for name, (unit, table, times) in WORK.items():
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(min(runs[1:]), 4)
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
        rates[name] = {"unit": f"{unit}/s", "value": round(rows * (times(rows) if callable(times) else times) / min(runs[1:]))}
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "rates": rates, "cpus": cpus, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
