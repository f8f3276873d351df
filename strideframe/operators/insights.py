"""Insight query library (A1-A18).  Each function takes the warehouse and returns a DataFrame.

Results are aggregates over marts; every aggregation is partial (map-side) then final, and the
only whole-frame window (A11) runs over the handful of already-aggregated band rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.compat import clock_hhmm, rnd
from strideframe.functions.stats_exprs import avg_of_rounded, pct, pearson_rounded

def mvpa():
    return F.col("very_active_min") + F.col("fairly_active_min")


def _valid(wh) -> DataFrame:
    return wh.fct_daily.filter(F.col("is_valid_day"))


def kpi_snapshot(wh) -> DataFrame:
    return _valid(wh).agg(
        F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("valid_days"),
        rnd(F.avg("steps")).alias("avg_steps"), rnd(F.avg("calories")).alias("avg_calories"),
        rnd(F.avg("sedentary_min") / F.lit(60), 1).alias("avg_sedentary_h"),
        rnd(F.avg(mvpa()), 1).alias("avg_mvpa_min"),
        rnd(pct(F.col("steps") >= 10000), 1).alias("pct_days_10k"),
        rnd(pct(F.col("met_30_min_mvpa")), 1).alias("pct_days_30min_mvpa"))


def data_quality(wh) -> DataFrame:
    return wh.dq_log.orderBy("step")


def reconciliation(wh) -> DataFrame:
    return wh.dq_reconciliation


def weekday_rhythm(wh) -> DataFrame:
    return (_valid(wh).groupBy("weekday", "weekday_num")
            .agg(rnd(F.avg("steps")).alias("avg_steps"), rnd(F.avg("sedentary_min")).alias("avg_sedentary_min"),
                 rnd(F.avg(mvpa()), 1).alias("avg_mvpa_min"), F.count(F.lit(1)).alias("valid_days"))
            .orderBy("weekday_num").drop("weekday_num"))


def hourly_curve(wh) -> DataFrame:
    return (wh.fct_hourly.groupBy("hour_of_day")
            .agg(rnd(F.avg("steps")).alias("avg_steps"), rnd(F.avg("calories"), 1).alias("avg_calories"),
                 rnd(F.avg("total_intensity"), 1).alias("avg_intensity"))
            .orderBy("hour_of_day"))


def weekend_vs_weekday_hours(wh) -> DataFrame:
    return (wh.fct_hourly.groupBy("hour_of_day")
            .agg(rnd(F.avg(F.when(~F.col("is_weekend"), F.col("steps")))).alias("weekday_steps"),
                 rnd(F.avg(F.when(F.col("is_weekend"), F.col("steps")))).alias("weekend_steps"))
            .orderBy("hour_of_day"))


def intensity_mix(wh) -> DataFrame:
    """Four intensity sums as % of tracked time, unpivoted with ``stack``."""
    t = _valid(wh).agg(*(F.sum(c).alias(c) for c in
                         ("sedentary_min", "lightly_active_min", "fairly_active_min", "very_active_min",
                          "tracked_min")))
    tot = F.col("tracked_min").cast("double")
    return t.select(F.expr(
        "stack(4, 'Sedentary', sedentary_min, 'Light', lightly_active_min, "
        "'Fairly active', fairly_active_min, 'Very active', very_active_min) AS (level, s)"), "tracked_min") \
        .select("level", (F.col("s").cast("double") * F.lit(100.0) / tot).alias("pct_of_tracked_time"))


def step_bands_energy(wh) -> DataFrame:
    return (_valid(wh).groupBy("step_band")
            .agg(F.count(F.lit(1)).alias("valid_days"), rnd(F.avg("calories")).alias("avg_calories"),
                 rnd(F.avg("very_active_min"), 1).alias("avg_very_active_min"))
            .orderBy("step_band"))


CALORIE_METRICS = ["very_active_min", "distance_km", "steps", "fairly_active_min", "lightly_active_min",
                   "sedentary_min"]


def calorie_drivers(wh, frame: DataFrame | None = None, digits: int = 2) -> DataFrame:
    """Six correlations with calories in ONE aggregate, then unpivoted and ranked."""
    df = frame if frame is not None else _valid(wh)
    row = df.agg(*(pearson_rounded(m, "calories", digits).alias(m) for m in CALORIE_METRICS))
    pairs = ", ".join(f"'{m}', `{m}`" for m in CALORIE_METRICS)
    return (row.select(F.expr(f"stack({len(CALORIE_METRICS)}, {pairs}) AS (metric, corr_with_calories)"))
            .orderBy(F.col("corr_with_calories").desc_nulls_last()))


def sleep_overview(wh) -> DataFrame:
    s = wh.fct_sleep
    mean_min = F.sum(F.round(F.col("bedtime_hour") * 60)) / F.count("bedtime_hour")
    return s.agg(
        F.count(F.lit(1)).alias("nights"), F.count_distinct("user_id").alias("users"),
        rnd(avg_of_rounded("hours_asleep", 2), 2).alias("avg_hours_asleep"),
        rnd(avg_of_rounded("efficiency_pct", 1), 1).alias("avg_efficiency_pct"),
        rnd(F.avg("minutes_awake_in_bed")).alias("avg_awake_in_bed_min"),
        rnd(pct(F.col("minutes_asleep") < 420), 1).alias("pct_nights_under_7h"),
        # mean clock time: the minutes are rounded half-to-even, like a double -> integer cast
        clock_hhmm(F.rint(mean_min)).alias("avg_bedtime"))


def sleep_bands(wh) -> DataFrame:
    g = wh.fct_sleep.groupBy("sleep_band").agg(F.count(F.lit(1)).alias("nights"))
    # whole-frame window over <= 4 aggregated rows (not over raw rows)
    total = F.sum("nights").over(Window.partitionBy(F.lit(1)))
    return g.select("sleep_band", "nights",
                    rnd(F.lit(100.0) * F.col("nights") / total, 1).alias("pct_nights")).orderBy("sleep_band")


def bedtime_window(c=None):
    c = F.col("bedtime_hour") if c is None else c
    return (F.when(c < 23, "1 Before 11 PM").when(c < 24.5, "2 11 PM - 12:30 AM")
            .otherwise("3 After 12:30 AM"))


def bedtime_effect(wh) -> DataFrame:
    return (wh.fct_sleep.filter(F.col("bedtime_hour").isNotNull())
            .groupBy(bedtime_window().alias("bedtime_window"))
            .agg(F.count(F.lit(1)).alias("nights"),
                 rnd(avg_of_rounded("hours_asleep", 2), 2).alias("avg_hours_asleep"),
                 rnd(avg_of_rounded("efficiency_pct", 1), 1).alias("avg_efficiency"))
            .orderBy("bedtime_window"))


def sitting_vs_sleep(wh) -> DataFrame:
    sed = F.col("sedentary_min")
    b = F.when(sed < 600, "1 Under 10 h").when(sed < 780, "2 10-13 h").otherwise("3 Over 13 h")
    return (wh.fct_daily_sleep.groupBy(b.alias("sedentary_band"))
            .agg(F.count(F.lit(1)).alias("nights"), rnd(avg_of_rounded("hours_asleep", 2), 2).alias("avg_hours_asleep"))
            .orderBy("sedentary_band"))


def heart_rate_profile(wh) -> DataFrame:
    return (wh.fct_heartrate_hourly.groupBy("hour_of_day")
            .agg(rnd(avg_of_rounded("avg_bpm", 1), 1).alias("avg_bpm"), F.max("max_bpm").alias("peak_bpm"))
            .orderBy("hour_of_day"))


def engagement_decay(wh) -> DataFrame:
    return (wh.fct_daily.filter(F.col("study_week") <= 4).groupBy("study_week")
            .agg(F.count_distinct("user_id").alias("active_users"),
                 F.sum(F.col("is_valid_day").cast("int")).alias("valid_days"),
                 rnd(F.avg(F.when(F.col("is_valid_day"), F.col("steps")))).alias("avg_steps"))
            .orderBy("study_week"))


def feature_adoption(wh) -> DataFrame:
    row = wh.dim_user.agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("sleep_nights") > 0).alias("s"),
                          F.count_if(F.col("hr_days") > 0).alias("h"), F.count_if(F.col("weight_logs") > 0).alias("w"))
    return row.select(F.expr("stack(4, 'Activity', a, 'Sleep', s, 'Heart rate', h, 'Weight', w) AS (feature, users)"))


def persona_profile(wh, personas: DataFrame) -> DataFrame:
    """Persona sizes and means (persona table is one row per user)."""
    j = wh.dim_user.join(personas.select("user_id", "persona"), "user_id")
    return (j.groupBy("persona")
            .agg(F.count(F.lit(1)).alias("users"), rnd(F.avg("avg_steps")).alias("avg_steps"),
                 rnd(avg_of_rounded("avg_mvpa_min", 1), 1).alias("avg_mvpa_min"),
                 rnd(F.avg("avg_sedentary_min")).alias("avg_sedentary_min"),
                 rnd(F.avg("avg_sedentary_min") / 60, 1).alias("sed_h"),
                 rnd(F.avg("valid_days"), 1).alias("avg_valid_days"),
                 rnd(F.avg("features_used"), 1).alias("avg_features_used"))
            .orderBy(F.col("avg_steps").desc()))


def who_guideline(wh) -> DataFrame:
    weekly = F.col("avg_mvpa_min") * 7
    return (wh.dim_user.groupBy(F.when(weekly >= 150, "Meets guideline").otherwise("Below guideline").alias("status"))
            .agg(F.count(F.lit(1)).alias("users"),
                 rnd(F.sum(F.round(F.col("avg_mvpa_min") * 10)) * 7 / F.count("avg_mvpa_min") / 10).alias("avg_weekly_mvpa_min")))
