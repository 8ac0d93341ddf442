"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "regional_period_summary", "annual_trend_by_region", "period_intensity_mean_pivot", "tertile_bin_mean", "spearman_by_group", "ols_by_group",
    "event_window_join", "asof_latest_before", "ngroup_first_appearance", "storm_metrics", "rolling_max_sum", "peak_cell_argmax", "threshold_footprint",
    "fine_to_coarse_mean_area_volume", "fine_to_coarse_mode", "slope_grid", "dataset_diff_report",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from stormgrid.plans import registry

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(2):  # the first compiles
            t = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t)
        seconds[name] = round(min(took), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
