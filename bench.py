"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from qaaudit.plans.queries import REGISTRY  # noqa: E402
from qaaudit.sources.io import release  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("qaaudit-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="qaaudit-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one pass to start the JVM's code paths and Python workers, then the timed one
    warm = ["split_metadata", "rouge_l", "length_percentiles"]
    for name in warm:
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    only = set(sys.argv[1:])
    times: dict[str, float] = {}
    for name, run in REGISTRY.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("/")[-1]}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
