"""Staging (G1-G8): typed copies of the landing files.  No rows are removed here."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.compat import (parse_date, parse_ts, text_to_double, text_to_int,
                                          text_to_long)
from strideframe.sources.landing import RawSources


def stage_daily_activity(raw: DataFrame) -> DataFrame:
    return raw.select(
        text_to_long("Id").alias("user_id"),
        parse_date("ActivityDate").alias("activity_date"),
        text_to_int("TotalSteps").alias("steps"),
        text_to_double("TotalDistance").alias("distance_km"),
        text_to_double("TrackerDistance").alias("tracker_distance_km"),
        text_to_double("LoggedActivitiesDistance").alias("logged_distance_km"),
        text_to_double("VeryActiveDistance").alias("very_active_km"),
        text_to_double("ModeratelyActiveDistance").alias("moderate_km"),
        text_to_double("LightActiveDistance").alias("light_km"),
        text_to_double("SedentaryActiveDistance").alias("sedentary_km"),
        text_to_int("VeryActiveMinutes").alias("very_active_min"),
        text_to_int("FairlyActiveMinutes").alias("fairly_active_min"),
        text_to_int("LightlyActiveMinutes").alias("lightly_active_min"),
        text_to_int("SedentaryMinutes").alias("sedentary_min"),
        text_to_int("Calories").alias("calories"),
    )


def stage_daily_steps(raw: DataFrame) -> DataFrame:
    return raw.select(text_to_long("Id").alias("user_id"), parse_date("ActivityDay").alias("activity_date"),
                      text_to_int("StepTotal").alias("steps"))


def stage_daily_calories(raw: DataFrame) -> DataFrame:
    return raw.select(text_to_long("Id").alias("user_id"), parse_date("ActivityDay").alias("activity_date"),
                      text_to_int("Calories").alias("calories"))


def stage_sleep_day(raw: DataFrame) -> DataFrame:
    return raw.select(text_to_long("Id").alias("user_id"),
                      parse_ts("SleepDay").cast("date").alias("sleep_date"),
                      text_to_int("TotalSleepRecords").alias("sleep_records"),
                      text_to_int("TotalMinutesAsleep").alias("minutes_asleep"),
                      text_to_int("TotalTimeInBed").alias("minutes_in_bed"))


def stage_minute_sleep(raw: DataFrame) -> DataFrame:
    # sleep_state: 1 asleep, 2 restless, 3 awake
    return raw.select(text_to_long("Id").alias("user_id"), parse_ts("date").alias("ts"),
                      text_to_int("value").alias("sleep_state"), text_to_long("logId").alias("log_id"))


def stage_hourly(steps: DataFrame, calories: DataFrame, intensities: DataFrame) -> DataFrame:
    """Three hourly files inner-joined on their *text* keys (Id, ActivityHour), then typed."""
    j = (steps.join(calories, ["Id", "ActivityHour"], "inner")
         .join(intensities, ["Id", "ActivityHour"], "inner"))
    return j.select(text_to_long("Id").alias("user_id"), parse_ts("ActivityHour").alias("activity_hour"),
                    text_to_int("StepTotal").alias("steps"), text_to_int("Calories").alias("calories"),
                    text_to_int("TotalIntensity").alias("total_intensity"),
                    text_to_double("AverageIntensity").alias("avg_intensity"))


def stage_heartrate(raw: DataFrame) -> DataFrame:
    return raw.select(text_to_long("Id").alias("user_id"), parse_ts("Time").alias("ts"),
                      text_to_int("Value").alias("bpm"))


def stage_weight(raw: DataFrame) -> DataFrame:
    return raw.select(text_to_long("Id").alias("user_id"), parse_ts("Date").cast("date").alias("log_date"),
                      text_to_double("WeightKg").alias("weight_kg"), text_to_double("Fat").alias("fat_pct"),
                      text_to_double("BMI").alias("bmi"),
                      (F.lower(F.col("IsManualReport")) == F.lit("true")).alias("is_manual"))


@dataclass
class Staged:
    daily_activity: DataFrame
    daily_steps: DataFrame
    daily_calories: DataFrame
    sleep_day: DataFrame
    minute_sleep: DataFrame
    hourly: DataFrame
    heartrate: DataFrame
    weight: DataFrame


def stage_all(raw: RawSources) -> Staged:
    return Staged(
        daily_activity=stage_daily_activity(raw.daily_activity),
        daily_steps=stage_daily_steps(raw.daily_steps),
        daily_calories=stage_daily_calories(raw.daily_calories),
        sleep_day=stage_sleep_day(raw.sleep_day),
        minute_sleep=stage_minute_sleep(raw.minute_sleep),
        hourly=stage_hourly(raw.hourly_steps, raw.hourly_calories, raw.hourly_intensities),
        heartrate=stage_heartrate(raw.heartrate),
        weight=stage_weight(raw.weight),
    )
