"""Headline jobs, timed: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input
and the local cores. Every job is run to completion into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import time

from daftar.plans.catalog import QUERIES
from daftar.session import local_session

JOBS = [
    "extract_headers",
    "items_from_text",
    "items_from_layout",
    "extract_and_validate",
    "document_summary",
    "decode_qr_table",
    "validate_invoices",
    "validation_summary",
    "suggest_mappings",
    "approval_decisions",
    "post_inventory",
    "trial_balance",
    "stock_balance",
    "current_status",
    "ocr_error_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start-up is not part of any job
    times = {}
    for name in JOBS:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
