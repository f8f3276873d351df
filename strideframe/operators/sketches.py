"""Mergeable sketches per date: distinct users (HyperLogLog) and quantiles (KLL) of any span of days without its rows.

The build stores a row per date; a slice merges the rows of its dates.  Sketches have a fixed size whatever they
hold, so a date or a span with any number of users and readings merges in any order and in bounded memory.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the HLL's registers (relative standard error about 1.04 / sqrt(4096) = 1.6 %), and the KLL's k (rank
#: error about 0.9 % for single quantiles at 99 % confidence).
LG_K, KLL_K = 12, 400
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def sketch_daily(daily: DataFrame) -> DataFrame:
    """Per date: users with a record, users with a valid day, and the steps of valid days."""
    worn = F.col("is_valid_day")
    return daily.groupBy("activity_date").agg(
        F.min("study_week").alias("study_week"),
        F.hll_sketch_agg("user_id", LG_K).alias("users"),
        F.hll_sketch_agg(F.when(worn, F.col("user_id")), LG_K).alias("valid_users"),
        F.kll_sketch_agg_bigint(F.when(worn, F.col("steps").cast("long")), KLL_K).alias("steps"))


def sketch_heart(heartrate: DataFrame) -> DataFrame:
    """Per date: users with a reading, and the readings."""
    return heartrate.groupBy(F.col("ts").cast("date").alias("activity_date")).agg(
        F.hll_sketch_agg("user_id", LG_K).alias("users"), F.kll_sketch_agg_bigint(F.col("bpm").cast("long"), KLL_K).alias("bpm"))


def users_of(sketch: str) -> Column:
    """Distinct users over all merged dates."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0).cast("long"))


def users_between(sketches: DataFrame, first, last) -> DataFrame:
    """Users with a record and with a valid day from ``first`` to ``last``, one row."""
    return sketches.where(F.col("activity_date").between(F.lit(first), F.lit(last))) \
        .agg(users_of("users").alias("users"), users_of("valid_users").alias("valid_users"))


def users_by_week(sketches: DataFrame) -> DataFrame:
    """The same for each study week."""
    return sketches.groupBy("study_week").agg(users_of("users").alias("users"), users_of("valid_users").alias("valid_users"))


def quantiles(sketches: DataFrame, column: str, probs=QUANTILES) -> DataFrame:
    """p, q: approximate quantiles over all merged dates (values that occur; their ranks are off by the KLL's error)."""
    merged = sketches.agg(F.kll_merge_agg_bigint(column).alias("s")).where(F.kll_sketch_get_n_bigint("s") > 0)
    found = F.kll_sketch_get_quantile_bigint("s", F.array(*(F.lit(float(p)) for p in probs)))
    return merged.select(F.explode(F.arrays_zip(F.array(*(F.lit(float(p)) for p in probs)).alias("p"), found.alias("q"))).alias("x")).select("x.p", "x.q")
