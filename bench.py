"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mnemora import build_session  # noqa: E402
from mnemora.plans import registry  # noqa: E402

HEADLINE = [
    "search_standard",
    "search_multi_level",
    "vector_levels",
    "analytics_category_similarity",
    "text_content_entropy",
    "text_repetitive_patterns",
    "text_context_overflow",
    "text_content_quality",
    "confidence_sliding_window",
    "confidence_patterns",
    "classify_questions",
    "classify_subcategories",
    "classify_memory_metadata",
    "source_imported_lines",
    "store_update",
    "store_saved_and_loaded",
    "talk_topic_shifts",
    "talk_sessions",
    "talk_verdicts",
    "stream_topic_shifts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry()
    names = HEADLINE if len(sys.argv) < 2 else [n for n in queries if n.startswith(tuple(sys.argv[1:]))]
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
