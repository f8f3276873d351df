"""Data-quality assertions (Q1-Q7) as one-row DataFrames: (check_name, failing, detail)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, failing, detail=None) -> DataFrame:
    return df.agg(F.lit(name).alias("check_name"), failing.cast("long").alias("failing"),
                  (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def check_wear(wh) -> DataFrame:
    """Q1: valid days obey the wear rule."""
    bad = F.col("is_valid_day") & ((F.col("steps") == 0) | (F.col("tracked_min") < wh.cfg.min_wear_min))
    return _row(wh.fct_daily, "valid_days_follow_wear_rule", F.count_if(bad))


def check_unique(wh) -> DataFrame:
    """Q2: one night per (user, date); tuple distinct counts NULL members too."""
    return _row(wh.fct_sleep, "no_duplicate_nights",
                F.count(F.lit(1)) - F.count_distinct(F.struct("user_id", "sleep_date")))


def check_max_date(wh) -> DataFrame:
    """Q3: the last kept day is the last full day."""
    mx = F.max("activity_date")
    return _row(wh.fct_daily, "partial_day_removed", F.when(mx == F.lit(wh.cfg.last_full_day), 0).otherwise(1),
                mx.cast("string"))


def check_hours(wh) -> DataFrame:
    """Q4: hour of day within 0..23."""
    return _row(wh.fct_hourly, "hours_in_range", F.count_if(~F.col("hour_of_day").between(0, 23)))


def check_resting(wh, lo: int = 30, hi: int = 120) -> DataFrame:
    """Q5: resting heart-rate estimate within a plausible range."""
    return _row(wh.fct_heartrate_daily, "heart_rate_plausible",
                F.count_if(~F.col("resting_bpm_est").between(lo, hi)))


def check_reconcile(wh) -> DataFrame:
    """Q6: daily sub-files reconcile with the activity file."""
    return _row(wh.dq_reconciliation, "daily_subfiles_reconcile", F.coalesce(F.sum("mismatches"), F.lit(0)))


def check_coverage(wh, personas: DataFrame) -> DataFrame:
    """Q7: every user has exactly one persona; also names how many users have none."""
    p = personas.agg(F.count_distinct("user_id")).scalar()
    m = wh.dim_user.join(personas, "user_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    return wh.dim_user.agg(F.count(F.lit(1)).alias("u")).select(
        F.lit("every_user_has_one_persona").alias("check_name"), F.abs(F.col("u") - p).cast("long").alias("failing"),
        F.concat(m.cast("string"), F.lit(" users without persona")).alias("detail"))


def all_checks(wh) -> DataFrame:
    parts = [check_wear(wh), check_unique(wh), check_max_date(wh), check_hours(wh), check_resting(wh),
             check_reconcile(wh)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
