"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is fully executed (written to a no-op sink), timed warm after
one untimed warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from yearlink.functions.indel import indel  # noqa: E402
from yearlink.plans.catalog import QUERIES  # noqa: E402
from yearlink.session import get_spark  # noqa: E402

HEADLINE = [
    "match_year_pair",
    "match_forward",
    "chain_by_code",
    "chain_by_description",
    "reconcile",
    "hierarchy_match",
    "merge_back",
    "era_summary",
    "search",
    "batch_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(
        app="yearlink-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=max(8, cpus * 2),
        extra={"spark.driver.memory": "16g"},
    )
    names = [n for n in HEADLINE if n in QUERIES]
    # warm-up (untimed): JVM classes, parquet footers, and one Arrow UDF job
    # over every task slot so that the Python workers are forked once
    QUERIES["adjacent_pairs"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    warm = spark.range(0, cpus * 4096, numPartitions=cpus * 2).select(
        indel(F.col("id").cast("string"), F.lit("12345"))
    )
    warm.write.format("noop").mode("overwrite").save()
    # and the flagship once on the smallest data set (cogroup, checkpoints, codegen)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    QUERIES["match_year_pair"](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode(
        "overwrite"
    ).save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
