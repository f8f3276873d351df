"""Marts (M1-M9): fact and dimension tables built from the cleaned layer.

Each builder is a pure DataFrame function.  Group keys are user-scoped, so every shuffle is
hash-partitioned on ``user_id`` (+ a date); the user dimension pre-aggregates each source
before its left joins, so the joins are one-row-per-user on both sides.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.config import STEP_BAND_TOP, STEP_BANDS, StudyConfig
from strideframe.functions.compat import band, iso_dow, rnd, safe_div, study_week, weekday_name


def fct_daily(cln_daily: DataFrame, cfg: StudyConfig) -> DataFrame:
    d = F.col("activity_date")
    return cln_daily.withColumns({
        "weekday": weekday_name(d),
        "weekday_num": iso_dow(d),
        "is_weekend": iso_dow(d) >= 6,
        "study_week": study_week(d, cfg.study_start),
        "step_band": band("steps", STEP_BANDS, STEP_BAND_TOP),
        "met_30_min_mvpa": (F.col("very_active_min") + F.col("fairly_active_min")) >= 30,
    })


def fct_sleep_sessions(cln_minute_sleep: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row per (user, log): start, end (+1 minute), wake date, minutes by state, clock hours."""
    s = (cln_minute_sleep.groupBy("user_id", "log_id")
         .agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_ts"),
              F.count(F.lit(1)).alias("minutes_in_bed"),
              F.count_if(F.col("sleep_state") == 1).alias("minutes_asleep"),
              F.count_if(F.col("sleep_state") == 2).alias("minutes_restless"),
              F.count_if(F.col("sleep_state") == 3).alias("minutes_awake")))
    start_h = F.hour("session_start")
    return s.select(
        "user_id", "log_id", "session_start",
        F.timestamp_add("MINUTE", F.lit(1), F.col("last_ts")).alias("session_end"),
        F.col("last_ts").cast("date").alias("wake_date"),
        "minutes_in_bed", "minutes_asleep", "minutes_restless", "minutes_awake",
        (F.when(start_h < cfg.bedtime_wrap_hour, start_h + 24).otherwise(start_h)
         + F.minute("session_start") / F.lit(60.0)).alias("bedtime_hour"),
        (F.hour("last_ts") + F.minute("last_ts") / F.lit(60.0)).alias("wake_hour"),
    )


def main_sessions(sessions: DataFrame) -> DataFrame:
    """M3: the longest session per (user, wake date); ties broken by start then log id.

    ``row_number() = 1`` is planned as a WindowGroupLimit below the shuffle, so only one
    candidate per group and partition travels.
    """
    w = Window.partitionBy("user_id", "wake_date").orderBy(
        F.col("minutes_in_bed").desc(), F.col("session_start").asc(), F.col("log_id").asc())
    return sessions.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1).drop("rn")


def fct_sleep(cln_sleep_day: DataFrame, sessions: DataFrame) -> DataFrame:
    s = cln_sleep_day.alias("s")
    m = main_sessions(sessions).select(
        F.col("user_id").alias("m_user"), F.col("wake_date").alias("m_date"),
        "bedtime_hour", "wake_hour", "minutes_restless")
    j = s.join(m, (F.col("s.user_id") == F.col("m_user")) & (F.col("s.sleep_date") == F.col("m_date")), "left")
    asleep, in_bed = F.col("minutes_asleep"), F.col("minutes_in_bed")
    return j.select(
        "user_id", "sleep_date",
        weekday_name(F.col("sleep_date")).alias("weekday"), iso_dow(F.col("sleep_date")).alias("weekday_num"),
        "sleep_records", "minutes_asleep", "minutes_in_bed",
        rnd(asleep / F.lit(60.0), 2).alias("hours_asleep"),
        (in_bed - asleep).alias("minutes_awake_in_bed"),
        rnd(safe_div(F.lit(100.0) * asleep, in_bed), 1).alias("efficiency_pct"),
        F.when(asleep < 360, "Short (< 6 h)").when(asleep < 420, "Borderline (6-7 h)")
        .when(asleep <= 540, "Healthy (7-9 h)").otherwise("Long (> 9 h)").alias("sleep_band"),
        "bedtime_hour", "wake_hour", "minutes_restless",
    )


def fct_hourly(cln_hourly: DataFrame) -> DataFrame:
    h = F.col("activity_hour")
    return cln_hourly.select(
        "user_id", h.cast("date").alias("activity_date"), F.hour(h).alias("hour_of_day"),
        weekday_name(h.cast("date")).alias("weekday"), iso_dow(h.cast("date")).alias("weekday_num"),
        (iso_dow(h.cast("date")) >= 6).alias("is_weekend"),
        "steps", "calories", "total_intensity", "avg_intensity")


def fct_heartrate_hourly(cln_hr: DataFrame) -> DataFrame:
    return (cln_hr.groupBy("user_id", F.col("ts").cast("date").alias("activity_date"),
                           F.hour("ts").alias("hour_of_day"))
            .agg(F.sum("bpm").alias("_s"), F.min("bpm").alias("min_bpm"), F.max("bpm").alias("max_bpm"),
                 F.count(F.lit(1)).alias("readings"))
            .select("user_id", "activity_date", "hour_of_day",
                    rnd(F.col("_s") / F.col("readings"), 1).alias("avg_bpm"),
                    "min_bpm", "max_bpm", "readings"))


def fct_heartrate_daily(cln_hr: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Daily resting estimate = exact 5th percentile of the day's readings.

    Groups are one user-day (bounded by the sensor rate), so the exact ``percentile``
    buffer per group is bounded; it is rounded to 6 digits before display rounding so the
    last-bit interpolation differences between engines cannot flip a digit.
    """
    return (cln_hr.groupBy("user_id", F.col("ts").cast("date").alias("activity_date"))
            .agg(F.percentile(F.col("bpm"), F.lit(cfg.resting_quantile)).alias("_p"),
                 F.sum("bpm").alias("_s"), F.max("bpm").alias("peak_bpm"),
                 F.count(F.lit(1)).alias("readings"))
            .select("user_id", "activity_date",
                    rnd(rnd(F.col("_p"), 6), 1).alias("resting_bpm_est"),
                    rnd(F.col("_s") / F.col("readings"), 1).alias("avg_bpm"),
                    "peak_bpm", "readings"))


def fct_daily_sleep(daily: DataFrame, sleep: DataFrame) -> DataFrame:
    s = sleep.select(F.col("user_id").alias("s_user"), F.col("sleep_date"), "hours_asleep",
                     F.col("minutes_in_bed").alias("s_minutes_in_bed"), "efficiency_pct", "sleep_band",
                     "bedtime_hour")
    j = (daily.filter(F.col("is_valid_day"))
         .join(s, (F.col("s_user") == F.col("user_id")) & (F.col("sleep_date") == F.col("activity_date")),
               "inner"))
    return j.select(*daily.columns, "hours_asleep", F.col("s_minutes_in_bed").alias("minutes_in_bed"),
                    "efficiency_pct", "sleep_band", "bedtime_hour")


def _avg_valid(c):
    return F.avg(F.when(F.col("is_valid_day"), c))


def dim_user(daily: DataFrame, sleep: DataFrame, hr_daily: DataFrame, weight: DataFrame) -> DataFrame:
    """One row per user with an activity record; sleep/heart/weight profiles left-joined."""
    act = daily.groupBy("user_id").agg(
        F.count_if("is_valid_day").alias("valid_days"),
        F.count(F.lit(1)).alias("logged_days"),
        rnd(_avg_valid(F.col("steps")), 0).alias("avg_steps"),
        rnd(_avg_valid(F.col("calories")), 0).alias("avg_calories"),
        rnd(_avg_valid(F.col("sedentary_min")), 0).alias("avg_sedentary_min"),
        rnd(_avg_valid(F.col("lightly_active_min")), 0).alias("avg_light_min"),
        rnd(_avg_valid(F.col("very_active_min") + F.col("fairly_active_min")), 1).alias("avg_mvpa_min"),
        rnd(_avg_valid(F.col("tracked_min")), 0).alias("avg_tracked_min"),
        rnd(F.lit(100.0) * _avg_valid(F.when(F.col("steps") >= 10000, 1).otherwise(0)), 1).alias("pct_days_10k"),
    )
    # averages of rounded doubles are taken on exact integer hundredths / tenths (order-free sums)
    slp = sleep.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sleep_nights"),
        rnd(F.sum(F.round(F.col("hours_asleep") * 100)) / F.count("hours_asleep") / 100, 2).alias("avg_sleep_h"),
        rnd(F.sum(F.round(F.col("efficiency_pct") * 10)) / F.count("efficiency_pct") / 10, 1).alias("avg_efficiency"),
        rnd(F.sum(F.round(F.col("bedtime_hour") * 60)) / F.count("bedtime_hour") / 60, 2).alias("avg_bedtime"))
    hr = hr_daily.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("hr_days"),
        rnd(F.sum(F.round(F.col("resting_bpm_est") * 10)) / F.count("resting_bpm_est") / 10, 1).alias("resting_bpm"))
    wt = weight.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("weight_logs"),
        rnd(F.sum(F.round(F.col("bmi") * 100)) / F.count("bmi") / 100, 1).alias("avg_bmi"))
    j = act.join(slp, "user_id", "left").join(hr, "user_id", "left").join(wt, "user_id", "left")
    sn, hd, wl = (F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("sleep_nights", "hr_days", "weight_logs"))
    return j.select(
        *act.columns,
        sn.alias("sleep_nights"), "avg_sleep_h", "avg_efficiency", "avg_bedtime",
        hd.alias("hr_days"), "resting_bpm", wl.alias("weight_logs"), "avg_bmi",
        (F.lit(1) + (sn > 0).cast("int") + (hd > 0).cast("int") + (wl > 0).cast("int")).alias("features_used"),
        F.when(F.col("avg_steps") < 5000, "Sedentary").when(F.col("avg_steps") < 7500, "Low Active")
        .when(F.col("avg_steps") < 10000, "Somewhat Active").otherwise("Active").alias("step_segment"),
        F.when(F.col("valid_days") >= 25, "Committed").when(F.col("valid_days") >= 15, "Regular")
        .otherwise("Occasional").alias("engagement_tier"),
    )
