"""Headline queries at one scale; prints a single JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is run three times; the median counts.  Building the plan (with the jobs that this
takes, such as staged tables) and running it are told apart.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lurewatch.plans.registered import QUERIES  # noqa: E402
from lurewatch.session import drop_staged, local_session  # noqa: E402

HEADLINE = [
    "verdict_summary", "rule_profile", "text_features", "url_features", "clean_dedupe",
    "sanity_stats", "stratified_split", "lookalike_features", "brand_match_domains", "html_text",
    "href_links", "parse_messages", "tfidf_terms", "roc_auc", "score_bands", "load_all",
    "preprocess_pipeline", "outlier_share",
]
RUNS = 3


def run(query, spark, folder: str) -> tuple[float, float]:
    """Seconds to build the query, and to compute every column of every row."""
    start = time.time()
    table = query(spark, folder)
    built = time.time()
    table.write.format("noop").mode("overwrite").save()
    return built - start, time.time() - built


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores)
    # One pass over a small query starts the JVM's and Python's workers.
    run(QUERIES["verdict_summary"], spark, folder)
    total, build = {}, {}
    for name in HEADLINE:
        times = [run(QUERIES[name], spark, folder) for _ in range(RUNS)]
        total[name] = round(median(b + r for b, r in times), 3)
        build[name] = round(median(b for b, _ in times), 3)
        drop_staged(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(total.values()), 3),
                "unit": "sec",
                "queries": total,
                "build": build,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
