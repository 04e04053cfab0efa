"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pulseframe import catalog
from pulseframe.session import build_session

HEADLINE = (
    "b1_clean_signals", "i1_intent_label", "d1_parent_scores", "c1_asof_events", "d3_event_windows", "d6_demand_proxy",
    "d9_coverage_audit", "e1_gap_runs", "d66_scalar_metrics", "e7_gains_curve", "e16_threshold_f1", "d34_error_slices",
    "k3_backtest", "d50_bias_flags", "d49_ranking_sensitivity", "f10_model_selection", "c6_attach_probabilities",
    "h3_group_split", "h5_temporal_split", "f7_quota_queue", "l1_scenario_by_step", "l7_scenario_comparison", "e10_channel_adstock",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
