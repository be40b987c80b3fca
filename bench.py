"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "det_all", "det_large_q95", "det_velocity", "det_extremes", "det_branch_volume", "det_branch_large_ratio",
    "clean_dedup", "zscore_numeric", "feat_days_since_prev", "branch_summary_daily", "branch_summary_rollup", "branch_trend",
    "mis_revenue_change", "pat_burst", "pat_location_jump", "pat_takeover", "pat_customer_z", "alert_related", "alerts_basic",
    "txn_text", "topk_per_group", "merge_union", "drift_response_time", "drift_embedding", "emb_hash", "emb_tfidf", "knn_exact",
    "ctx_retrieve", "processed_snapshot", "ingest_version",
]


def main() -> None:
    from alertlake.plans.catalog import load_all
    from alertlake.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.log.level": "ERROR"})
    catalog = load_all()
    wanted = sys.argv[1:] or HEADLINES
    # Two queries before the clock starts, so that no number is the start of the JVM or of the Python workers.
    for name in ("det_general_insight", "emb_hash_seed"):
        catalog[name].build(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        catalog[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
