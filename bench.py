"""Wall time of the catalog's queries; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` (default all)
and ``BENCH_QUERIES`` (comma separated, default all) select what is run. Every
query computes all its columns and rows; the sink discards them.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from buzzlens.plans.catalog import QUERIES
from buzzlens.session import configure


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",")
    names = [n for n in QUERIES if n in chosen] or list(QUERIES)
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("buzzlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    configure(spark)
    QUERIES["signals"](spark, directory).count()  # start the engine before timing
    seconds: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    result = {
        "metric": "total wall time of all queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(directory.rstrip("/")).removeprefix("sf")),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
