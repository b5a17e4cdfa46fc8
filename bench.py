"""Wall-clock of the headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfsight.plans.catalog import QUERIES  # noqa: E402
from shelfsight.session import bench_cores, local_session  # noqa: E402

HEADLINES = [
    "fk_check", "cap_outliers", "promo_month", "inventory_month", "monthly_facts", "monthly_features",
    "top_categories", "shop_profit", "correlation_matrix", "sample_exact", "stratified_split",
    "sequence_frames_by_series", "arima_backtest", "seasonal_regression_backtest", "standard_scale",
    "sequence_regression", "whatif_price", "inventory_plan", "isolation_forest", "linear_regression",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = bench_cores()
    spark = local_session(cores, "shelfsight-bench", **{"spark.sql.shuffle.partitions": cores})
    seconds: dict[str, float] = {}
    QUERIES["calendar_month"](spark, sf_dir).collect()  # start the executors before the clock
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
