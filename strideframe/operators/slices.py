"""Dashboard aggregates (V1-V41): the data behind each chart and KPI tile.

Every function takes the warehouse and a ``Filters`` (default: no restriction) and returns
an aggregated DataFrame; charts themselves are out of scope.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.config import SLEEP_BAND_ORDER
from strideframe.functions.compat import rnd
from strideframe.functions.stats_exprs import avg_of_rounded, complete_pair, pct, pearson, scalars
from strideframe.operators.filters import Filters
from strideframe.operators.insights import bedtime_window, mvpa

ALL = Filters()


def _daily_valid(wh, f: Filters) -> DataFrame:
    return f.apply(wh.fct_daily.filter(F.col("is_valid_day")), "activity_date")


# ---- overview page -------------------------------------------------------------------------
def v_hour_curve(wh, f: Filters = ALL) -> DataFrame:
    return f.apply(wh.fct_hourly, "activity_date").groupBy("hour_of_day").agg(F.avg("steps").alias("avg_steps"))


def v_kpi(wh, f: Filters = ALL) -> DataFrame:
    return _daily_valid(wh, f).agg(rnd(F.avg("steps")).alias("steps"),
                                   rnd(F.avg("sedentary_min") / F.lit(60), 1).alias("sed_h"),
                                   rnd(pct(F.col("steps") >= 10000)).alias("p10k"),
                                   rnd(F.avg(mvpa())).alias("mvpa"))


def v_sleep_kpi(wh, f: Filters = ALL) -> DataFrame:
    return f.apply(wh.fct_sleep, "sleep_date").agg(
        rnd(avg_of_rounded("hours_asleep", 2), 2).alias("h"),
        rnd(pct(F.col("minutes_asleep") < 420)).alias("short"))


def v_hr_curve(wh, f: Filters = ALL) -> DataFrame:
    return (f.apply(wh.fct_heartrate_hourly, "activity_date").groupBy("hour_of_day")
            .agg(avg_of_rounded("avg_bpm", 1).alias("bpm")))


def v_intensity_wide(wh, f: Filters = ALL) -> DataFrame:
    return _daily_valid(wh, f).agg(F.sum("sedentary_min").alias("s"), F.sum("lightly_active_min").alias("l"),
                                   F.sum("fairly_active_min").alias("f"), F.sum("very_active_min").alias("v"))


def hour_two_sensor(wh, f: Filters = ALL) -> DataFrame:
    """Steps and heart rate on one hour axis (two hourly aggregates joined on the hour)."""
    return v_hour_curve(wh, f).join(v_hr_curve(wh, f), "hour_of_day", "full").orderBy("hour_of_day")


# ---- activity page -------------------------------------------------------------------------
def v_activity_kpi(wh, f: Filters = ALL) -> DataFrame:
    return _daily_valid(wh, f).agg(
        F.count_distinct("user_id").alias("u"), F.count(F.lit(1)).alias("d"),
        rnd(F.avg("steps")).alias("s"), rnd(F.avg("calories")).alias("c"),
        rnd(F.avg(mvpa()), 1).alias("m"), rnd(pct(F.col("met_30_min_mvpa"))).alias("p30"))


def v_weekday_extremes(wh, f: Filters = ALL) -> DataFrame:
    """Weekday means in week order, best and worst day flagged (window over 7 rows)."""
    g = (_daily_valid(wh, f).groupBy("weekday", "weekday_num")
         .agg(F.avg("steps").alias("s"), (F.avg("sedentary_min") / F.lit(60)).alias("sed")))
    whole = Window.partitionBy(F.lit(1))
    return (g.select("weekday", "weekday_num", "s", "sed",
                     (F.col("s") == F.max("s").over(whole)).alias("is_best"),
                     (F.col("s") == F.min("s").over(whole)).alias("is_worst"))
            .orderBy("weekday_num"))


def v_intraday(wh, f: Filters = ALL) -> DataFrame:
    return (f.apply(wh.fct_hourly, "activity_date").groupBy("hour_of_day")
            .agg(F.avg(F.when(~F.col("is_weekend"), F.col("steps"))).alias("wd"),
                 F.avg(F.when(F.col("is_weekend"), F.col("steps"))).alias("we"))
            .orderBy("hour_of_day"))


def weekday_hour_pivot(wh, f: Filters = ALL) -> DataFrame:
    """Weekday x hour mean steps; the pivot values are given, so no extra distinct pass."""
    p = (f.apply(wh.fct_hourly, "activity_date").groupBy("weekday", "weekday_num")
         .pivot("hour_of_day", list(range(24))).agg(F.avg("steps")))
    return p.select("weekday", "weekday_num", *(F.col(str(h)).alias(f"h{h:02d}") for h in range(24))) \
        .orderBy("weekday_num")


def v_drivers(wh, f: Filters = ALL) -> DataFrame:
    from strideframe.operators.insights import calorie_drivers
    return calorie_drivers(wh, frame=_daily_valid(wh, f), digits=6)


def linear_trend(wh, f: Filters = ALL, x: str = "steps", y: str = "calories") -> DataFrame:
    """Least-squares line y = slope*x + intercept (needs more than 2 rows, else NULL)."""
    px, py = complete_pair(x, y)
    slope = F.try_divide(F.covar_samp(px, py), F.var_samp(px))
    g = _daily_valid(wh, f).agg(F.count(px).alias("n"), slope.alias("slope"), F.avg(px).alias("mx"), F.avg(py).alias("my"),
                                F.min(px).alias("x_min"), F.max(px).alias("x_max"))
    ok = F.col("n") > 2
    return g.select("n", F.when(ok, rnd(F.col("slope"), 6)).alias("slope"),
                    F.when(ok, rnd(F.col("my") - F.col("slope") * F.col("mx"), 6)).alias("intercept"),
                    "x_min", "x_max")


def trend_grid(wh, f: Filters = ALL, points: int = 50) -> DataFrame:
    """The fitted line sampled at ``points`` evenly spaced x values."""
    t = linear_trend(wh, f).filter(F.col("slope").isNotNull())
    step = (F.col("x_max") - F.col("x_min")).cast("double") / F.lit(points - 1)
    g = t.select("slope", "intercept", "x_min", step.alias("dx"),
                 F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    xs = F.col("x_min") + F.col("i") * F.col("dx")
    return g.select("i", rnd(xs, 6).alias("x"), rnd(F.col("slope") * xs + F.col("intercept"), 6).alias("y"))


def v_bands(wh, f: Filters = ALL) -> DataFrame:
    return (_daily_valid(wh, f).groupBy("step_band")
            .agg(F.avg("calories").alias("c"), F.avg("very_active_min").alias("v"), F.count(F.lit(1)).alias("n"))
            .select("step_band", F.substr("step_band", F.lit(3)).alias("label"), "c", "v", "n")
            .orderBy("step_band"))


def wear_by_date(wh, f: Filters = ALL) -> DataFrame:
    return (f.apply(wh.fct_daily, "activity_date").groupBy("activity_date")
            .agg(F.count_if("is_valid_day").alias("n_valid"), F.count_if(~F.col("is_valid_day")).alias("n_invalid"))
            .orderBy("activity_date"))


def wear_by_user(wh, f: Filters = ALL) -> DataFrame:
    v = F.col("v")
    return (f.apply(wh.fct_daily, "activity_date").groupBy(F.col("user_id").cast("string").alias("u"))
            .agg(F.sum(F.col("is_valid_day").cast("int")).alias("v"))
            .select("u", "v", F.when(v >= 25, "Committed").when(v >= 15, "Regular").otherwise("Occasional")
                    .alias("tier")).orderBy("v", "u"))


# ---- sleep page ----------------------------------------------------------------------------
def v_sleep_page_kpi(wh, f: Filters = ALL) -> DataFrame:
    """Mean bedtime wrapped to 24 h and shown with truncated minutes."""
    s = f.apply(wh.fct_sleep, "sleep_date")
    g = s.agg(F.count(F.lit(1)).alias("n"), rnd(avg_of_rounded("hours_asleep", 2), 2).alias("h"),
              rnd(avg_of_rounded("efficiency_pct", 1), 1).alias("e"),
              rnd(pct(F.col("minutes_asleep") < 420)).alias("p7"),
              (F.sum(F.round(F.col("bedtime_hour") * 60)) / F.count("bedtime_hour")).alias("bt_min"))
    bt = F.pmod(F.col("bt_min") / F.lit(60.0), F.lit(24.0))
    return g.select("n", "h", "e", "p7", rnd(bt, 6).alias("bt"),
                    F.format_string("%02d:%02d", F.floor(bt).cast("int"),
                                    F.floor(F.pmod(bt, F.lit(1.0)) * 60).cast("int")).alias("bt_clock"))


def v_bedtime(wh, f: Filters = ALL) -> DataFrame:
    s = f.apply(wh.fct_sleep.filter(F.col("bedtime_hour").isNotNull()), "sleep_date")
    w = bedtime_window()
    return (s.groupBy(F.substr(w, F.lit(3)).alias("w"))
            .agg(F.min("bedtime_hour").alias("o"), avg_of_rounded("hours_asleep", 2).alias("h"),
                 F.count(F.lit(1)).alias("n"))
            .orderBy("o"))


def v_sit_sleep_r(wh, f: Filters = ALL) -> DataFrame:
    d = f.apply(wh.fct_daily_sleep, "activity_date")
    g = d.agg(F.count(F.lit(1)).alias("n"), pearson(F.col("sedentary_min") / F.lit(60), "hours_asleep").alias("r"))
    return g.select("n", F.when(F.col("n") > 2, rnd(rnd(F.col("r"), 6), 6)).alias("r"))


def band_reindex(wh, f: Filters = ALL) -> DataFrame:
    """Counts per sleep band in the fixed band order; missing bands become 0."""
    spark = wh.spark
    domain = spark.createDataFrame(list(enumerate(SLEEP_BAND_ORDER, 1)), "band_order int, sleep_band string")
    counts = f.apply(wh.fct_sleep, "sleep_date").groupBy("sleep_band").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(domain).join(counts, "sleep_band", "left")
            .select("band_order", "sleep_band", F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n"))
            .orderBy("band_order"))


def v_sleep_weekday(wh, f: Filters = ALL) -> DataFrame:
    return (f.apply(wh.fct_sleep, "sleep_date").groupBy("weekday", "weekday_num")
            .agg(avg_of_rounded("hours_asleep", 2).alias("h"),
                 (F.sum(F.round(F.col("bedtime_hour") * 60)) / F.count("bedtime_hour") / 60).alias("b"))
            .orderBy("weekday_num"))


def v_hr_band(wh, f: Filters = ALL) -> DataFrame:
    return (f.apply(wh.fct_heartrate_hourly, "activity_date").groupBy("hour_of_day")
            .agg(avg_of_rounded("avg_bpm", 1).alias("bpm"), F.avg("min_bpm").alias("lo"),
                 F.avg("max_bpm").alias("hi"))
            .orderBy("hour_of_day"))


def v_resting(wh, f: Filters = ALL) -> DataFrame:
    return (f.apply(wh.dim_user.filter(F.col("resting_bpm").isNotNull()))
            .select(F.col("user_id").cast("string").alias("u"), "resting_bpm").orderBy("resting_bpm", "u"))


# ---- explorer page -------------------------------------------------------------------------
def user_series(wh, user_id: int | None = None) -> DataFrame:
    """Daily series (one user, or every user when ``user_id`` is None)."""
    d = wh.fct_daily if user_id is None else wh.fct_daily.filter(F.col("user_id") == user_id)
    return d.select("user_id", "activity_date", "steps", "is_valid_day", mvpa().alias("mvpa"), "sedentary_min")


def cohort_daily(wh, f: Filters = ALL) -> DataFrame:
    return (_daily_valid(wh, f).groupBy("activity_date").agg(F.avg("steps").alias("s")).orderBy("activity_date"))


def wear_calendar(wh, user_id: int | None = None) -> DataFrame:
    """Week since the user's first day x ISO weekday (0 = Monday); invalid days show 0."""
    d = wh.fct_daily if user_id is None else wh.fct_daily.filter(F.col("user_id") == user_id)
    first = F.min("activity_date").over(Window.partitionBy("user_id"))
    return d.select("user_id", "activity_date",
                    (F.datediff(F.col("activity_date"), first) / F.lit(7)).cast("int").alias("week"),
                    F.weekday("activity_date").alias("dow"),
                    F.when(F.col("is_valid_day"), F.col("steps")).otherwise(F.lit(0)).alias("fill"))


def user_nights(wh, user_id: int | None = None) -> DataFrame:
    s = wh.fct_sleep if user_id is None else wh.fct_sleep.filter(F.col("user_id") == user_id)
    return s.select("user_id", "sleep_date", "hours_asleep", "efficiency_pct",
                    (F.col("hours_asleep") >= 7).alias("meets_7h"))


def user_card(wh) -> DataFrame:
    """The profile card of every user (weekly MVPA vs 150, sitting hours, sleep or 'not tracked')."""
    u = wh.dim_user
    return u.select(
        "user_id", "valid_days", "logged_days", "avg_steps", "avg_mvpa_min",
        rnd(F.col("avg_mvpa_min") * 7).alias("weekly_mvpa_min"),
        (F.col("avg_mvpa_min") * 7 >= 150).alias("meets_who"),
        rnd(F.col("avg_sedentary_min") / F.lit(60), 1).alias("sitting_h"),
        F.when(F.col("sleep_nights") > 0, F.format_string("%.2f h", F.col("avg_sleep_h")))
        .otherwise(F.lit("not tracked")).alias("sleep_label"),
        "sleep_nights", "features_used")


def valid_days(wh) -> DataFrame:
    """The valid-day extract used by the statistics page."""
    return wh.fct_daily.filter(F.col("is_valid_day"))


# ---- pipeline page / workbench ---------------------------------------------------------------
def dq_filtered_sum(wh) -> DataFrame:
    return wh.dq_log.agg(F.sum(F.when(F.col("table_name") == "heartrate", F.col("rows_before"))).alias("hr"))


def dq_subset(wh, tables=("daily_activity", "sleep_day", "hourly", "weight")) -> DataFrame:
    return (wh.dq_log.filter(F.col("table_name").isin(list(tables)))
            .select(F.concat_ws(" ", "step", "table_name").alias("label"), "rows_before", "rows_after"))


def top_k_least_sleep(wh, k: int = 10) -> DataFrame:
    """The k users with the least sleep after valid days (top-k is the feature; ties by id)."""
    return (wh.fct_daily_sleep.groupBy("user_id")
            .agg(rnd(avg_of_rounded("hours_asleep", 2), 2).alias("avg_sleep_h"),
                 rnd(F.avg("sedentary_min") / F.lit(60), 1).alias("avg_sitting_h"))
            .orderBy(F.col("avg_sleep_h").asc_nulls_last(), F.col("user_id")).limit(k))


# The published comparison's metrics.
PERCENTILE_METRICS = ["avg_steps", "avg_mvpa_min", "avg_light_min", "avg_sedentary_min", "valid_days", "avg_calories"]


def percentile_rank(wh, metrics=PERCENTILE_METRICS) -> DataFrame:
    """For every clustered user and metric, 100 x share of users whose value is <= theirs.

    Counts come from distributed value counts with running sums (no global sort window); a
    NULL value compares false (0), and NULL users still count in the denominator.
    """
    from strideframe.operators.ranks import value_counts_cum
    users = wh.dim_user.filter(F.col("valid_days") > 0)
    n_all = users.agg(F.count(F.lit(1))).scalar()
    items = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    values = users.select("user_id", F.expr(f"stack({len(metrics)}, {items}) AS (metric, v)"))
    counts = value_counts_cum(values, "v", ["metric"]).select("metric", "v", (F.col("before") + F.col("n")).alias("le"))
    return values.join(counts, ["metric", "v"], "left").select(
        "user_id", "metric", (F.lit(100.0) * F.coalesce(F.col("le"), F.lit(0)) / n_all).alias("pct"))


def curve_minmax(wh, eps: float = 1e-9) -> DataFrame:
    """The 24-hour step curve scaled to 0..1 by its min and max (+eps), for the header line."""
    c = v_hour_curve(wh)
    mm = scalars(c.agg(F.min("avg_steps").alias("lo"), F.max("avg_steps").alias("hi")))
    return c.select("hour_of_day",
                    ((F.col("avg_steps") - mm["lo"]) / (mm["hi"] - mm["lo"] + F.lit(eps))).alias("scaled"))
