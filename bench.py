"""Headline queries timed on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from slotwise.plans.catalog import QUERIES
from slotwise.session import RECOMMENDED_CONF

HEADLINE = [
    "daily_naive_error", "repeated_keys_first_kept", "tukey_winsorise", "gap_report", "price_lags", "price_rolling",
    "volume_rolling", "same_slot_week", "weather_history", "full_feature_fill", "daily_driver_lags", "daily_price_history",
    "shipment_vwap", "vintage_as_of_cutoff", "model_fold_scores", "spike_harness", "band_comparison", "widening_gate_sweep",
    "nowcast_bands", "corrector_scores", "innovation_grid", "persistence_decay", "kruskal_wallis_months",
    "spearman_importance", "risk_days_over_years", "recursive_rollout", "level_sweep", "streamed_slots",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    b = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g"))
    for k, v in RECOMMENDED_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
