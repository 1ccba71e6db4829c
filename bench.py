"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` the cores.
Every query is evaluated in full into a sink that discards the rows. The first run of a query
also pays for code generation, so each is timed once, cold, and the sum is the headline value.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from somnotab.session import local_session  # noqa: E402

HEADLINE = (
    "normalize_text",
    "classify_documents",
    "classify_labels",
    "extract_basal_doc",
    "extract_basal_rtf",
    "extract_bpap_doc",
    "extract_dam_rtf",
    "extract_all",
    "audit_missing",
    "curate_basal_doc",
    "to_double",
    "to_date",
    "unknown_units",
    "month_histogram",
    "profile",
    "top10_others",
    "ingest_status_duplicate",
    "ingest_status_existing",
    "cells_pivot",
    "file_inventory",
    "keyword_buckets",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, "somnotab-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
