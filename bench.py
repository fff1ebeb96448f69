"""Time the headline queries: one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vacatlas.catalog.queries import QUERIES  # noqa: E402
from vacatlas.session import session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "dedup_postings", "clean_postings", "geocode", "yoe", "salary_annual", "skills_long", "summaries",
    "responsibilities", "title_words", "kpis", "region_stats", "cluster_summary", "box_stats_region",
    "crosstab_long", "top_skills", "city_density", "cluster_labels", "suggestions", "silhouette", "weekly_counts",
    "filters_combined", "tfidf_weights", "kmeans_embeddings", "report_tables", "choose_k",
]


def main() -> None:
    spark = session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "20g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
