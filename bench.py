"""Time the headline queries and print one JSON line.

Every query runs from the raw tables (shared inputs are forgotten before each
one) and writes all its columns to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vanflow import catalog  # noqa: E402
from vanflow.catalog import helpers, learned, orders  # noqa: E402
from vanflow.session import get_spark  # noqa: E402

HEADLINE = [
    "A1_customer_data", "A5_incremental_merge", "H2_sales_totals", "H9_item_route_window_stats",
    "B3_build_panel_daily", "C4_pair_explainability", "D2_lag_features", "D3_rolling_features",
    "E6_ets", "F9_best_model_per_pair", "G1_comparison", "I12_calibration", "J12_priority",
    "K7_top_peers", "K13_co_occurrence", "L8_generation_run", "M6_feedback_run",
    "N1_adoption_merge", "O3_customer_scores", "O7_session_replay", "P1_customer_history",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(
        "vanflow-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        helpers.forget()
        orders._RUNS.clear()
        learned._TRAINED.clear()
        learned._PREPARED.clear()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("H2_sales_totals")  # start the JVM's code generation and file listing
    times = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
