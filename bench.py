"""Time the headline queries and print one JSON line.

Every query is run once unmeasured at the smallest scale, so that starting Python workers and
compiling do not count, and then once over whole tables, its result written to the
no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storystream.plans.catalog import QUERIES
from storystream.session import get_spark

HEADLINE = [
    "classify_topic",
    "html_text",
    "story_summaries",
    "list_stories",
    "title_dedup",
    "title_pairs",
    "cosine_pairs",
    "ingest_articles",
    "backfill_stories",
    "threshold_sweep",
    "link_entities",
    "merge_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            run(name, warm_dir)
    seconds = {name: run(name, sf_dir) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
