"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs in full into Spark's no-op sink: one warm-up run, then the median of three."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.queries import QUERIES  # noqa: E402

HEADLINES = (
    "redact_documents",
    "html_to_text",
    "email_parts",
    "mail_envelope",
    "model_request",
    "verdict_flag",
    "section_html",
    "triage_batch",
    "triage_stream",
    "outbox",
    "tickets",
    "replay_batch",
    "missing_objects",
    "object_listing",
)
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mailtriage-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.mailtriage.tasks", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINES:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
        print(name, seconds[name], file=sys.stderr)
    found = re.search(r"sf([\d.]+)", sf_dir)
    line = {
        "metric": "total of median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(found.group(1)) if found else None,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
