"""Hypothesis tests (H1-H10) as one distributed aggregate of sufficient statistics each.

The statistic is computed in Spark; the p-value is a pandas UDF over the one-row result.
Rank tests use the distributed mid-ranks of ``operators.ranks``.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.config import CORR_COLUMNS
from strideframe.functions.bootstrap import replicate_sums
from strideframe.functions.compat import rnd
from strideframe.functions.distributions import p_value, t_ppf
from strideframe.functions.stats_exprs import complete_pair, pearson, scalars
from strideframe.operators.insights import bedtime_window
from strideframe.operators.ranks import mid_ranks


@F.pandas_udf(T.DoubleType())
def p_value_udf(kind: pd.Series, stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([p_value(k, s, a, b) if pd.notna(s) else float("nan")
                      for k, s, a, b in zip(kind, stat, d1, d2)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile_udf(q: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_ppf(a, b) if pd.notna(b) else float("nan") for a, b in zip(q, df)], dtype="float64")


def _round6(c):
    return rnd(c, 6)


# ---- H1 Welch t ------------------------------------------------------------------------------
def welch_t(df: DataFrame, value: str, group_cond) -> DataFrame:
    """Welch's two-sample t: group A = rows where group_cond, B = the rest (NULL cond dropped).

    Both groups' moments come from one conditional aggregate; no row when a group is empty.
    """
    x = F.col(value)
    d = df.filter(group_cond.isNotNull() & x.isNotNull())
    j = d.agg(F.count_if(group_cond).alias("n1"), F.avg(F.when(group_cond, x)).alias("m1"),
              F.var_samp(F.when(group_cond, x)).alias("v1"),
              F.count_if(~group_cond).alias("n2"), F.avg(F.when(~group_cond, x)).alias("m2"),
              F.var_samp(F.when(~group_cond, x)).alias("v2")).filter((F.col("n1") > 0) & (F.col("n2") > 0))
    se1, se2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(se1 + se2))
    dof = F.try_divide((se1 + se2) * (se1 + se2),
                       se1 * se1 / (F.col("n1") - 1) + se2 * se2 / (F.col("n2") - 1))
    return j.select("n1", "n2", _round6(F.col("m1")).alias("mean1"), _round6(F.col("m2")).alias("mean2"),
                    _round6(t).alias("t"), _round6(dof).alias("dof"))


# ---- H2 Kruskal-Wallis -----------------------------------------------------------------------
def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H over pooled mid-ranks; groups are summed, never collected."""
    d = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    pooled = mid_ranks(d, value)
    per = d.groupBy(F.col(group).alias("grp"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("ngv"))
    rs = (per.join(pooled.select("v", "midrank"), "v")
          .groupBy("grp").agg(F.sum(F.col("ngv") * F.col("midrank")).alias("R"), F.sum("ngv").alias("ng")))
    s = rs.agg(F.sum(F.col("R") * F.col("R") / F.col("ng")).alias("sr"), F.sum("ng").alias("N"),
               F.count(F.lit(1)).alias("k")).filter(F.col("k") > 0)
    # the ties' sum needs the value counts alone; they are the ranks' own first aggregate, whose shuffle is reused
    counts = d.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    tt = counts.agg(F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n"))).scalar()
    N = F.col("N").cast("double")
    h = F.lit(12.0) / (N * (N + 1)) * F.col("sr") - F.lit(3.0) * (N + 1)
    corr = F.lit(1.0) - F.try_divide(tt, N * N * N - N)
    return s.select("N", "k", _round6(F.try_divide(h, corr)).alias("H"))


# ---- H3 / H4 correlation ------------------------------------------------------------------------
def pearson_test(df: DataFrame, x, y) -> DataFrame:
    g = df.agg(F.count(complete_pair(x, y)[0]).alias("n"), pearson(x, y).alias("r"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("r") * F.col("r")))
    return g.select("n", _round6(F.col("r")).alias("r"), _round6(t).alias("t"))


def spearman_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of the mid-ranks over distinct pairs of values with their counts: rows are read for the counts alone,
    and a value that many rows have joins its rank once for each value it is paired with.  Ranks have the mean (n + 1) / 2."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = d.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    rx, ry = (mid_ranks(d, c).select(F.col("v").alias(k), (F.col("midrank") - (F.col("total") + 1) / F.lit(2.0)).alias(f"d{k}")) for c, k in ((x, "x"), (y, "y")))
    j = pairs.join(rx, "x").join(ry, "y")
    c, dx, dy = F.col("c"), F.col("dx"), F.col("dy")
    g = j.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n"), F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"), F.sum(c * dy * dy).alias("yy"))
    g = g.select("n", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("rho"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("rho") * F.col("rho")))
    return g.select("n", _round6(F.col("rho")).alias("rho"), _round6(t).alias("t"))


# ---- H5 one-way ANOVA -----------------------------------------------------------------------------
def anova(df: DataFrame, value: str, group) -> DataFrame:
    g = (df.filter(F.col(value).isNotNull()).groupBy(group.alias("grp"))
         .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")))
    gm = g.agg(F.sum(F.col("n") * F.col("m")) / F.sum("n")).scalar()
    s = g.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"),
              F.sum(F.col("n") * (F.col("m") - gm) * (F.col("m") - gm)).alias("ssb"),
              F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw")).filter(F.col("k") > 0)
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k")))
    return s.select("N", "k", _round6(f).alias("F"))


# ---- the registered tests on the warehouse ------------------------------------------------------
def weekend_welch(wh) -> DataFrame:
    d = wh.fct_daily.filter(F.col("is_valid_day"))
    return welch_t(d, "steps", ~F.col("is_weekend"))


def weekday_kruskal(wh) -> DataFrame:
    return kruskal(wh.fct_daily.filter(F.col("is_valid_day")), "steps", "weekday")


def sit_sleep_pearson(wh) -> DataFrame:
    return pearson_test(wh.fct_daily_sleep, "sedentary_min", "hours_asleep")


def active_calories_pearson(wh) -> DataFrame:
    return pearson_test(wh.fct_daily.filter(F.col("is_valid_day")), "very_active_min", "calories")


def sit_sleep_spearman(wh) -> DataFrame:
    return spearman_test(wh.fct_daily_sleep, "sedentary_min", "hours_asleep")


def _windows(wh) -> DataFrame:
    return wh.fct_sleep.filter(F.col("bedtime_hour").isNotNull()).withColumn("window", bedtime_window())


def bedtime_anova(wh) -> DataFrame:
    return anova(_windows(wh), "hours_asleep", F.col("window"))


def bedtime_welch(wh) -> DataFrame:
    d = _windows(wh).filter(F.col("window").isin("1 Before 11 PM", "3 After 12:30 AM"))
    return welch_t(d, "hours_asleep", F.col("window") == "1 Before 11 PM")


def persona_kruskal(wh, personas: DataFrame, value: str) -> DataFrame:
    u = wh.dim_user.join(personas.select("user_id", "persona"), "user_id")
    return kruskal(u, value, "persona")


def test_summary(wh, personas: DataFrame | None = None) -> DataFrame:
    """H6 / H7: one row per hypothesis with statistic, p-value and verdict."""
    rows = [
        weekend_welch(wh).select(F.lit("Weekday vs weekend steps").alias("hypothesis"), F.lit("Welch t-test").alias("test"),
                                 F.lit("t").alias("kind"), F.col("t").alias("statistic"), F.col("dof").alias("d1"),
                                 F.lit(None).cast("double").alias("d2")),
        weekday_kruskal(wh).select(F.lit("Steps differ across 7 weekdays"), F.lit("Kruskal-Wallis"), F.lit("chi2"),
                                   F.col("H"), (F.col("k") - 1).cast("double"), F.lit(None).cast("double")),
        sit_sleep_pearson(wh).select(F.lit("Sitting vs sleep"), F.lit("Pearson r"), F.lit("t"), F.col("r"),
                                     (F.col("n") - 2).cast("double"), F.col("t")),
        active_calories_pearson(wh).select(F.lit("Very active minutes vs calories"), F.lit("Pearson r"), F.lit("t"), F.col("r"),
                                           (F.col("n") - 2).cast("double"), F.col("t")),
        sit_sleep_spearman(wh).select(F.lit("Sitting vs sleep"), F.lit("Spearman rho"), F.lit("t"), F.col("rho"),
                                      (F.col("n") - 2).cast("double"), F.col("t")),
        bedtime_anova(wh).select(F.lit("Sleep across bedtime windows"), F.lit("One-way ANOVA"), F.lit("F"), F.col("F"),
                                 (F.col("k") - 1).cast("double"), (F.col("N") - F.col("k")).cast("double")),
        bedtime_welch(wh).select(F.lit("Before 11 PM vs after 12:30 AM"), F.lit("Welch t-test"), F.lit("t"), F.col("t"),
                                 F.col("dof"), F.lit(None).cast("double")),
    ]
    if personas is not None:
        for label, col in (("Steps across personas", "avg_steps"), ("Sitting across personas", "avg_sedentary_min")):
            rows.append(persona_kruskal(wh, personas, col).select(
                F.lit(label), F.lit("Kruskal-Wallis"), F.lit("chi2"), F.col("H"), (F.col("k") - 1).cast("double"),
                F.lit(None).cast("double")))
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r.toDF(*u.columns))
    # correlation rows carry their t statistic in d2; the p-value uses it
    stat_for_p = F.when(F.col("test").isin("Pearson r", "Spearman rho"), F.col("d2")).otherwise(F.col("statistic"))
    p = p_value_udf(F.col("kind"), stat_for_p, F.col("d1"), F.coalesce(F.col("d2"), F.lit(0.0)))
    out = u.select("hypothesis", "test", "statistic", p.alias("p_value"))
    return out.withColumn("result", F.when(F.col("p_value") < 0.05, "Significant").otherwise("Not significant"))


def corr_matrix(wh, cols=CORR_COLUMNS) -> DataFrame:
    """H8: lower-triangle Pearson matrix, every pair in ONE aggregate, unpivoted with stack."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[: i + 1]]
    d = wh.fct_daily_sleep
    aggs = [rnd(rnd(pearson(a, b), 6), 6).alias(f"{a}__{b}") for a, b in pairs]
    row = d.agg(*aggs)
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return row.select(F.expr(f"stack({len(pairs)}, {stack}) AS (var_a, var_b, r)"))


def regression_ci(wh, points: int = 50, level: float = 0.95) -> DataFrame:
    """H9: OLS line of hours asleep on sedentary minutes with a closed-form confidence band."""
    d = wh.fct_daily_sleep.filter(F.col("sedentary_min").isNotNull() & F.col("hours_asleep").isNotNull())
    x, y = F.col("sedentary_min").cast("double"), F.col("hours_asleep")
    g = d.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
              F.var_samp(x).alias("vx"), F.covar_samp(x, y).alias("cxy"), F.var_samp(y).alias("vy"),
              F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    slope = F.try_divide(F.col("cxy"), F.col("vx"))
    g = g.select("*", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))
    # residual variance s^2 = (n-1)(vy - slope*cxy)/(n-2); Sxx = (n-1) vx
    g = g.select("*", F.try_divide((F.col("n") - 1) * (F.col("vy") - F.col("slope") * F.col("cxy")),
                                   F.col("n") - 2).alias("s2"),
                 t_quantile_udf(F.lit(0.5 + level / 2), (F.col("n") - 2).cast("double")).alias("tq"))
    grid = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    xs = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / F.lit(points - 1)
    fit = F.col("intercept") + F.col("slope") * xs
    se = F.sqrt(F.col("s2") * (F.lit(1.0) / F.col("n") + (xs - F.col("mx")) * (xs - F.col("mx"))
                               / ((F.col("n") - 1) * F.col("vx"))))
    return grid.select("i", xs.alias("x"), fit.alias("fit"), (fit - F.col("tq") * se).alias("lo"),
                       (fit + F.col("tq") * se).alias("hi"))


def mean_sd(wh) -> DataFrame:
    """Calories of valid days per step band: n, mean and sample sd."""
    d = wh.fct_daily.filter(F.col("is_valid_day"))
    return d.groupBy("step_band").agg(F.count("calories").alias("n"), F.avg("calories").alias("mean"),
                                      F.stddev_samp("calories").alias("sd"))


def mean_ci(wh, level: float = 0.95) -> DataFrame:
    """Mean calories per step band with a t interval."""
    tq = t_quantile_udf(F.lit(0.5 + level / 2), (F.col("n") - 1).cast("double"))
    half = tq * F.col("sd") / F.sqrt(F.col("n"))
    return mean_sd(wh).select("step_band", "n", "mean", "sd", (F.col("mean") - half).alias("lo"),
                              (F.col("mean") + half).alias("hi")).orderBy("step_band")


def _day() -> Column:
    return F.unix_date("activity_date").alias("day")


def _limits(value: Column, level: float) -> list[Column]:
    return [rnd(F.percentile(value, F.lit(p)), 6).alias(n) for n, p in (("lo", 0.5 - level / 2), ("hi", 0.5 + level / 2))]


def mean_ci_bootstrap(wh, level: float = 0.95) -> DataFrame:
    """H10 by bootstrap: percentiles of the mean calories per step band over all replicates, from one aggregate of
    whole-number sums.  Of the days only partial sums (bands x replicates rows a batch) leave a task."""
    d = wh.fct_daily.filter(F.col("is_valid_day") & F.col("calories").isNotNull())
    sums = replicate_sums(d.select("user_id", _day(), "step_band", "calories"), "user_id", "day", "step_band", ["calories"])
    return sums.groupBy("step_band").agg(*_limits(F.col("calories").cast("double") / F.col("n").cast("double"), level))


def regression_ci_bootstrap(wh, points: int = 50, level: float = 0.95) -> DataFrame:
    """H9 by bootstrap: each replicate's weighted normal equations in one aggregate, its line on the grid between the
    smallest and largest x, and percentiles of the lines at each grid point."""
    d = wh.fct_daily_sleep.filter(F.col("sedentary_min").isNotNull() & F.col("hours_asleep").isNotNull())
    x, y = F.col("sedentary_min").cast("long"), F.round(F.col("hours_asleep") * 100).cast("long")
    rows = d.select("user_id", _day(), F.lit(0).alias("all"), x.alias("sx"), y.alias("sy"), (x * x).alias("sxx"), (x * y).alias("sxy"))
    sums = replicate_sums(rows, "user_id", "day", "all", ["sx", "sy", "sxx", "sxy"])
    sums = sums.select(*(F.col(c).cast("double").alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    below = n * F.col("sxx") - sx * sx
    lines = sums.where(below > 0).select("n", "sx", "sy", ((n * F.col("sxy") - sx * sy) / below).alias("slope"))
    ends = scalars(d.agg(F.min("sedentary_min").alias("lo"), F.max("sedentary_min").alias("hi")))
    at = ends["lo"] + F.col("i") * (ends["hi"] - ends["lo"]) / F.lit(float(points - 1))
    grid = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")) \
        .select("i", ((sy - F.col("slope") * sx) / n + F.col("slope") * at).alias("v"))
    return grid.groupBy("i").agg(*(rnd(F.percentile("v", F.lit(p)) / 100, 6).alias(k) for k, p in (("lo", 0.5 - level / 2), ("hi", 0.5 + level / 2))))


def regression_line(wh) -> DataFrame:
    """The line of H9 alone: hours asleep on sedentary minutes."""
    x, y = complete_pair("sedentary_min", "hours_asleep")
    slope = F.try_divide(F.covar_samp(x, y), F.var_samp(x))
    g = wh.fct_daily_sleep.agg(F.count(x).alias("n"), slope.alias("slope"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    return g.select("n", _round6(F.col("slope")).alias("slope"),
                    _round6(F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))
