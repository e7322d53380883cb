"""Times headline queries on one data folder and prints one JSON line.

BENCH_SF_DIR picks the folder, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated list (``all`` runs every registered query).
"""

from __future__ import annotations

import json
import os
import time

from threadloom.plans import catalogue
from threadloom.plans.base import Tables
from threadloom.session import get_session

HEADLINE = (
    "query_rows ref_query ref_leaf_hits library_search bright_set graph_links neighbors related linked_refs boards_with suggest_pairs "
    "connected_component company resurface follow_diff dedupe_follow diff_boards item_meta card_stats strength_score timeline_days "
    "as_of_sets reading_order outline_order text_to_blocks gram_postings search_parts search_fulltext bm25_rank nearest_vectors "
    "repeated_furniture paragraphs spelling_consensus table_grid numeric_column_repair table_f1 adjacency_f1 kendall_tau paired_compare "
    "stall_to_gesture nearest_input_context hover_moments latency_summary change_feed_latest"
).split()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = get_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "threadloom.scan.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    table = catalogue()
    names = list(table) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    Tables(spark, root).lineitem.count()
    spent: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        table[name].build(Tables(spark, root)).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - t0, 3)
        if os.environ.get("BENCH_TRACE"):
            print(name, spent[name], flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": os.path.basename(root.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
