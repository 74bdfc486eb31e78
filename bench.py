"""Time the headline queries once each, warm session, and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from ledgerloom.registry import all_queries, views
from ledgerloom.session import build_session

HEADLINE = (
    "category_summary", "kth_highest_debit", "amount_ranks", "load_summary", "user_net_ranking", "top_decile_users",
    "cohort_cells", "cohort_grid", "table_totals", "line_price_ntiles", "line_price_quartiles", "load_statistics",
    "load_histogram", "load_box_plot", "line_price_uniformity", "load_normality", "printed_records", "sheet_line_items",
    "imported_tasks", "eligibility", "settled_orders", "line_item_matches", "merged_events", "not_yet_returned",
    "reconciled_confirmations", "confirmation_outcomes", "returns_outcomes", "returns_tasks", "returns_report",
    "folded_events", "streamed_events", "compacted_events", "table_of_tasks",
)
PREPARED = ("sheet_grid", "tasks", "task_items", "confirmations")  # tables made from the given ones, timed too


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory(prefix="ledgerloom-bench-") as folder:
        run(sf_dir, cpus, folder)


def run(sf_dir: str, cpus: str, folder: str) -> None:
    spark = build_session(
        "ledgerloom-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=folder,
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = {q.name: q.build for q in all_queries()}
    chosen = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in PREPARED:
        started = time.perf_counter()
        getattr(views, name)(spark, sf_dir).count()
        seconds[f"prepare_{name}"] = round(time.perf_counter() - started, 3)
    for name in chosen:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
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
