"""Benchmark: build the warehouse once, then run the headline queries on the built marts.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # insight library
    "kpi_snapshot", "data_quality", "dq_reconciliation", "weekday_rhythm", "hourly_curve",
    "weekend_vs_weekday_hours", "intensity_mix", "step_bands_energy", "calorie_drivers", "sleep_overview",
    "sleep_bands", "bedtime_effect", "sitting_vs_sleep", "heart_rate_profile", "engagement_decay",
    "feature_adoption", "who_guideline",
    # dashboard slices and statistics
    "v_activity_kpi", "weekday_hour_pivot", "trend_grid", "v_sleep_page_kpi", "wear_calendar",
    "welch_weekend", "kruskal_weekday", "spearman_sit_sleep", "anova_bedtime", "corr_matrix",
    "box_steps_weekday", "describe", "hexbin", "dq_checks", "persona_profile", "elbow",
    "mean_ci_bootstrap", "regression_ci_bootstrap", "users_by_week", "sketch_quantiles", "points_by_persona",
]
DIRECT = ["kpi_snapshot", "dim_user", "data_quality"]


def main() -> None:
    from strideframe.plans import catalog
    from strideframe.plans.warehouse import Warehouse
    from strideframe.session import local_session, scratch_path

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * cpus), app="strideframe-bench")
    # the build goes under the session's shared checkpoint folder (any Hadoop file system)
    out_dir = scratch_path(spark, "bench-warehouse")
    times: dict[str, float] = {}

    lazy = Warehouse.from_driver(spark, sf_dir)
    t0 = time.perf_counter()
    built = lazy.materialize(out_dir, force=True)
    times["build_warehouse"] = round(time.perf_counter() - t0, 3)
    built.raw = lazy.raw          # profiling queries read the landing layer
    built.sf_dir = sf_dir

    for name in HEADLINE:
        spec = catalog.REGISTRY[name]
        t0 = time.perf_counter()
        spec.build(built).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    # as the driver binds them: straight from the driver tables, no built mart
    for name in DIRECT:
        t0 = time.perf_counter()
        catalog.REGISTRY[name].build(Warehouse.from_driver(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        times[f"direct_{name}"] = round(time.perf_counter() - t0, 3)

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "warehouse_build_plus_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
