"""Landing layer: the ten text-typed raw inputs the warehouse reads.

Two ways to get them:

* ``RawSources.from_folder`` reads real landing parquet files (every column text), S1/S2.
* ``RawSources.from_driver_tables`` derives the same ten inputs from the driver's ``events``
  table, so that every layer above runs on data that grows with the driver tables.  The
  derivation is a fixed binding (documented in README.md) computed with grouped aggregates
  and one ``explode`` for the minute-level sleep file; it never collects anything.

All columns are formatted as text in the export style ('4/12/2016', '4/12/2016 1:05:00 AM').
"""
from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.config import StudyConfig
from strideframe.functions.compat import DATE_FMT, TS_FMT

# Raw file name -> text columns the staging layer reads.
RAW_FILES: dict[str, list[str]] = {
    "dailyActivity": ["Id", "ActivityDate", "TotalSteps", "TotalDistance", "TrackerDistance",
                      "LoggedActivitiesDistance", "VeryActiveDistance", "ModeratelyActiveDistance",
                      "LightActiveDistance", "SedentaryActiveDistance", "VeryActiveMinutes",
                      "FairlyActiveMinutes", "LightlyActiveMinutes", "SedentaryMinutes", "Calories"],
    "dailySteps": ["Id", "ActivityDay", "StepTotal"],
    "dailyCalories": ["Id", "ActivityDay", "Calories"],
    "sleepDay": ["Id", "SleepDay", "TotalSleepRecords", "TotalMinutesAsleep", "TotalTimeInBed"],
    "minuteSleep": ["Id", "date", "value", "logId"],
    "hourlySteps": ["Id", "ActivityHour", "StepTotal"],
    "hourlyCalories": ["Id", "ActivityHour", "Calories"],
    "hourlyIntensities": ["Id", "ActivityHour", "TotalIntensity", "AverageIntensity"],
    "heartrate_seconds": ["Id", "Time", "Value"],
    "weightLogInfo": ["Id", "Date", "WeightKg", "Fat", "BMI", "IsManualReport"],
}

REQUIRED_FILES = ["dailyActivity", "sleepDay"]


@dataclass
class RawSources:
    daily_activity: DataFrame
    daily_steps: DataFrame
    daily_calories: DataFrame
    sleep_day: DataFrame
    minute_sleep: DataFrame
    hourly_steps: DataFrame
    hourly_calories: DataFrame
    hourly_intensities: DataFrame
    heartrate: DataFrame
    weight: DataFrame

    _FILE_OF = {
        "daily_activity": "dailyActivity", "daily_steps": "dailySteps",
        "daily_calories": "dailyCalories", "sleep_day": "sleepDay", "minute_sleep": "minuteSleep",
        "hourly_steps": "hourlySteps", "hourly_calories": "hourlyCalories",
        "hourly_intensities": "hourlyIntensities", "heartrate": "heartrate_seconds",
        "weight": "weightLogInfo",
    }

    def items(self):
        for f in fields(self):
            yield self._FILE_OF[f.name], getattr(self, f.name)

    # ---- S1 / S2 / S4: read a landing folder -------------------------------------------
    @classmethod
    def from_folder(cls, spark: SparkSession, raw_dir: str) -> "RawSources":
        """Read the ten landing files with an explicit all-text schema (no inference)."""
        check_required_inputs(spark, raw_dir)
        frames = {}
        for attr, fname in cls._FILE_OF.items():
            schema = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_FILES[fname]])
            frames[attr] = spark.read.schema(schema).parquet(os.path.join(raw_dir, f"{fname}.parquet"))
        return cls(**frames)

    # ---- driver-table binding ------------------------------------------------------------
    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str,
                           cfg: StudyConfig | None = None) -> "RawSources":
        cfg = cfg or StudyConfig()
        ev = read_events(spark, sf_dir)
        return derive_landing(ev, cfg)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
            .select("event_id", "ts", "user_id", "event_type", "value", "props"))


def check_required_inputs(spark: SparkSession, raw_dir: str, required=REQUIRED_FILES) -> None:
    """Fail fast, naming every missing required input (works on any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for name in required:
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(raw_dir, f"{name}.parquet"))
        if not p.getFileSystem(conf).exists(p):
            missing.append(f"{name}.parquet")
    if missing:
        raise FileNotFoundError(f"Raw files missing in {raw_dir}: {missing}")


def _txt(c) -> F.Column:
    return c.cast("string")


def _enriched(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        F.round(F.col("value") * F.lit(100.0), 0).cast("long").alias("cents"),
        F.coalesce(F.expr("try_cast(regexp_extract(props, '\"k\": (\\\\d+)', 1) AS BIGINT)"),
                   F.lit(0).cast("long")).alias("k"),
    )


def _sum_if(cond, x) -> F.Column:
    return F.sum(F.when(cond, x).otherwise(F.lit(0)))


def _km(cents) -> F.Column:
    # distance in km with 2 decimals: round(cents / 13) / 100
    return F.round(cents / F.lit(13.0), 0) / F.lit(100.0)


def _clock_texts() -> F.Column:
    """The 1,440 minutes of a day in the export's 12-hour clock, one literal array."""
    return F.lit([f"{m // 60 % 12 or 12}:{m % 60:02d}:00 {'AM' if m < 720 else 'PM'}" for m in range(1440)])


def derive_landing(events: DataFrame, cfg: StudyConfig) -> RawSources:
    e = _enriched(events)
    t = F.col("event_type")
    is_purchase, is_click, is_view = t == "purchase", t == "click", t == "view"
    is_sed = t.isin("error", "signup")

    # ---- daily files: one aggregation per (user, day), three projections ------------------
    daily = (e.groupBy("user_id", F.col("ts").cast("date").alias("d"))
             .agg(F.sum("cents").alias("steps"),
                  F.expr("sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) div 1000").alias("very"),
                  F.expr("sum(CASE WHEN event_type = 'click' THEN cents ELSE 0 END) div 1000").alias("fairly"),
                  F.expr("sum(CASE WHEN event_type = 'view' THEN cents ELSE 0 END) div 500").alias("light"),
                  F.expr("(unix_micros(CAST(max(ts) AS TIMESTAMP)) - unix_micros(CAST(min(ts) AS TIMESTAMP))) div 60000000").alias("span_min"),
                  F.sum("k").alias("k_sum"),
                  _sum_if(is_purchase, F.col("cents")).alias("c_very"),
                  _sum_if(is_click, F.col("cents")).alias("c_fair"),
                  _sum_if(is_view, F.col("cents")).alias("c_light"),
                  _sum_if(is_sed, F.col("cents")).alias("c_sed"),
                  F.count_if(t != "signup").alias("n_cal"),
                  _sum_if(t != "signup", F.col("cents")).alias("cal_cents"),
                  _sum_if(t != "signup", F.col("k")).alias("cal_k")))
    day_txt = F.date_format(F.col("d"), DATE_FMT)
    calories = F.lit(1400) + F.expr("steps div 20") + F.lit(3) * F.col("k_sum")
    daily_activity = daily.select(
        _txt(F.col("user_id")).alias("Id"), day_txt.alias("ActivityDate"),
        _txt(F.col("steps")).alias("TotalSteps"),
        _txt(_km(F.col("steps"))).alias("TotalDistance"),
        _txt(_km(F.col("steps"))).alias("TrackerDistance"),
        _txt(F.lit(0.0)).alias("LoggedActivitiesDistance"),
        _txt(_km(F.col("c_very"))).alias("VeryActiveDistance"),
        _txt(_km(F.col("c_fair"))).alias("ModeratelyActiveDistance"),
        _txt(_km(F.col("c_light"))).alias("LightActiveDistance"),
        _txt(_km(F.col("c_sed"))).alias("SedentaryActiveDistance"),
        _txt(F.col("very")).alias("VeryActiveMinutes"),
        _txt(F.col("fairly")).alias("FairlyActiveMinutes"),
        _txt(F.col("light")).alias("LightlyActiveMinutes"),
        _txt(F.greatest(F.col("span_min") - F.col("very") - F.col("fairly") - F.col("light"),
                        F.lit(0).cast("long"))).alias("SedentaryMinutes"),
        _txt(calories).alias("Calories"))
    daily_steps = daily.select(_txt(F.col("user_id")).alias("Id"), day_txt.alias("ActivityDay"),
                               _txt(F.col("steps")).alias("StepTotal"))
    daily_calories = (daily.filter(F.col("n_cal") > 0)
                      .select(_txt(F.col("user_id")).alias("Id"), day_txt.alias("ActivityDay"),
                              _txt(F.lit(1400) + F.expr("cal_cents div 20") + F.lit(3) * F.col("cal_k"))
                              .alias("Calories")))

    # ---- optional features: user sets by a value rule (left joins then see real NULLs) -----
    def users_where(cond) -> DataFrame:
        return e.filter(cond).select("user_id").distinct()

    sleep_users = users_where(is_purchase & (F.col("cents") > 15000))
    heart_users = users_where(F.col("cents") > 20000)
    weight_users = users_where(F.col("cents") > 30000)

    # ---- minute sleep: each event is a segment of 1..240 minutes --------------------------
    seg = (e.join(sleep_users, "user_id", "left_semi")
           .select("user_id",
                   F.date_trunc("minute", F.col("ts")).alias("start"),
                   (F.lit(1) + F.pmod(F.col("cents"), F.lit(240))).cast("int").alias("n"),
                   F.when(t.isin("view", "click", "error"), 1).when(t == "signup", 2)
                   .otherwise(3).alias("state"),
                   (F.col("user_id") * F.lit(1000) + F.datediff(
                       (F.col("ts") - F.expr(f"INTERVAL {cfg.bedtime_wrap_hour} HOURS")).cast("date"),
                       F.lit(cfg.study_start)) + F.lit(1)).cast("long").alias("log_id")))
    # The explode multiplies rows ~100x: rebalance the (small) segment rows first, so that the expansion
    # is not stuck in the scan's few partitions and adaptive execution chooses how many there are.  Not by
    # user: one user may own a large share of the rows.
    # A segment's days and ids are written as text once; its minutes (less than a day: it touches two dates at most)
    # only join the day's text and the clock's.
    first_day = F.col("start").cast("date")
    by_segment = seg.hint("rebalance").select(
        _txt(F.col("user_id")).alias("Id"), _txt(F.col("state")).alias("value"), _txt(F.col("log_id")).alias("logId"),
        F.array(F.date_format(first_day, DATE_FMT), F.date_format(F.date_add(first_day, 1), DATE_FMT)).alias("days"),
        F.coalesce(F.hour("start") * F.lit(60) + F.minute("start"), F.lit(0)).alias("m0"), "n")
    minute_sleep = (by_segment.select("Id", "value", "logId", "days", F.explode(F.sequence(F.col("m0"), F.col("m0") + F.col("n") - F.lit(1))).alias("m"))
                    .select("Id", F.concat(F.get("days", F.expr("m div 1440").cast("int")), F.lit(" "), F.get(_clock_texts(), F.pmod(F.col("m"), F.lit(1440))))
                            .alias("date"), "value", "logId"))

    # sleep day totals per wake date (export totals count overlapping minutes twice)
    per_log = (seg.groupBy("user_id", "log_id")
               .agg(F.max(F.timestamp_add("MINUTE", F.col("n") - F.lit(1), F.col("start")))
                    .cast("date").alias("wake"),
                    _sum_if(F.col("state") == 1, F.col("n")).alias("asleep"),
                    F.sum("n").alias("in_bed")))
    per_day = (per_log.groupBy("user_id", "wake")
               .agg(F.count(F.lit(1)).alias("records"), F.sum("asleep").alias("asleep"),
                    F.sum("in_bed").alias("in_bed")))
    # every night whose minutes in bed is a multiple of 13 was exported twice (rule R1 target)
    per_day = per_day.unionByName(per_day.filter(F.pmod(F.col("in_bed"), F.lit(13)) == 0))
    sleep_day = per_day.select(
        _txt(F.col("user_id")).alias("Id"),
        F.date_format(F.col("wake").cast("timestamp_ntz"), TS_FMT).alias("SleepDay"),
        _txt(F.col("records")).alias("TotalSleepRecords"),
        _txt(F.col("asleep")).alias("TotalMinutesAsleep"),
        _txt(F.col("in_bed")).alias("TotalTimeInBed"))

    # ---- hourly files: one aggregation per (user, hour), three projections ----------------
    hourly = (e.groupBy("user_id", F.date_trunc("hour", F.col("ts")).alias("h"))
              .agg(F.expr("sum(cents) div 10").alias("steps"),
                   F.count_if(t != "error").alias("n_cal"),
                   _sum_if(t != "error", F.col("k")).alias("cal_k"),
                   F.count_if(t != "signup").alias("n_int"),
                   _sum_if(t != "signup", F.col("cents")).alias("int_cents")))
    hour_txt = F.date_format(F.col("h"), TS_FMT)
    hourly_steps = hourly.select(_txt(F.col("user_id")).alias("Id"), hour_txt.alias("ActivityHour"),
                                 _txt(F.col("steps")).alias("StepTotal"))
    hourly_calories = (hourly.filter(F.col("n_cal") > 0)
                       .select(_txt(F.col("user_id")).alias("Id"), hour_txt.alias("ActivityHour"),
                               _txt(F.lit(60) + F.col("cal_k")).alias("Calories")))
    total_int = F.col("n_int") * F.lit(10) + F.expr("int_cents div 1000")
    hourly_intensities = (hourly.filter(F.col("n_int") > 0)
                          .select(_txt(F.col("user_id")).alias("Id"), hour_txt.alias("ActivityHour"),
                                  _txt(total_int).alias("TotalIntensity"),
                                  _txt(total_int / F.lit(60.0)).alias("AverageIntensity")))

    # ---- heart rate: one reading per event of heart-rate users ----------------------------
    heartrate = (e.join(heart_users, "user_id", "left_semi")
                 .select(_txt(F.col("user_id")).alias("Id"),
                         F.date_format(F.col("ts"), TS_FMT).alias("Time"),
                         _txt(F.round(F.col("cents") / F.lit(100.0), 0).cast("int")).alias("Value")))

    # ---- weight log: signup events of weight users ---------------------------------------
    c = F.col("cents")
    weight = (e.filter(t == "signup").join(weight_users, "user_id", "left_semi")
              .select(_txt(F.col("user_id")).alias("Id"),
                      F.date_format(F.col("ts"), TS_FMT).alias("Date"),
                      _txt((F.lit(5000) + F.expr("cents div 5")) / F.lit(100.0)).alias("WeightKg"),
                      _txt(F.when(F.pmod(c, F.lit(4)) == 0,
                                  (F.lit(1000) + F.pmod(c, F.lit(2000))) / F.lit(100.0))).alias("Fat"),
                      _txt(F.round((F.lit(5000) + F.expr("cents div 5")) / F.lit(2.89), 0) / F.lit(100.0))
                      .alias("BMI"),
                      F.when(F.pmod(c, F.lit(3)) == 0, "True").when(F.pmod(c, F.lit(3)) == 1, "false")
                      .alias("IsManualReport")))

    return RawSources(daily_activity, daily_steps, daily_calories, sleep_day, minute_sleep,
                      hourly_steps, hourly_calories, hourly_intensities, heartrate, weight)
