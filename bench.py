"""Time the headline jobs on one table folder and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from callflow.catalog import registry  # noqa: E402
from callflow.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_talk_time",
    "k1_assemble_transcripts",
    "k2_label_roles",
    "k3_enrich",
    "k4_diarize_segments",
    "k5_evaluate",
    "k6_ops_report",
    "k7_admit",
    "a12_k8_deliver",
    "k9_retention",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine outside the timings
    queries, seconds, rows = registry.queries(), {}, {}
    for name in HEADLINE:
        began = time.perf_counter()
        seen = Observation(name)
        queries[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        rows[name] = seen.get["n"]  # every column was produced; a count would have pruned them
        seconds[name] = round(time.perf_counter() - began, 3)
    counts = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("conversations", "events", "orders")}
    print(
        json.dumps(
            {
                "metric": "headline_jobs_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "rows": rows,
                "input_rows": counts,
                "cores": cores,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
