"""Wall time of the headline queries, warm, as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query runs once to warm up and is then timed while its
whole result is computed and discarded, without bringing rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import QUERIES  # noqa: E402
from trustgrain.session import build_session  # noqa: E402

HEADLINE = (
    "trust_report",
    "duplicate_content",
    "phrase_repetition",
    "rating_anomaly",
    "review_burst",
    "product_summary",
    "dedupe_documents",
    "document_red_flags",
    "document_language",
    "keywords",
    "jsonld_reviews",
    "visit_metrics",
    "rolling_counts",
    "users_with_activity",
    "rate_limit_audit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, cold = {}, {}
    for name in names:
        for record in (cold, took):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            record[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm wall time",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "cold": cold,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
