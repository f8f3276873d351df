"""Query catalogue: name -> Spark builder (+ DuckDB oracle SELECT over the oracle chain).

Builders take a ``Warehouse``; ``__spark_entry__`` binds them to (spark, sf_dir).
Queries without an oracle are checked rows-only (model fits, p-values).
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.config import CORR_COLUMNS, CORR_COLUMNS_ALL, PAIR_COLUMNS, PERSONA_FEATURES, PERSONA_Z_FEATURES, StudyConfig
from strideframe.functions import bootstrap as B
from strideframe.functions.compat import rnd
from strideframe.operators import insights as A
from strideframe.operators import sketches as K
from strideframe.plans.oracle_sql import rnd as r
from strideframe.plans.warehouse import MART_NAMES


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[..., DataFrame]
    oracle: str | None
    doc: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, build: Callable[..., DataFrame], oracle: str | None, doc: str = "", once: Sequence[str] = ()) -> None:
    """``once``: tables that the query reads several times; they are derived once (``Warehouse.once``)."""
    if name in REGISTRY:
        raise ValueError(f"duplicate query {name}")
    REGISTRY[name] = QuerySpec(name, (lambda wh: build(wh.once(*once))) if once else build, oracle, doc)


def _avg_r(col: str, k: int) -> str:
    """oracle twin of avg_of_rounded"""
    p = 10 ** k
    return f"(sum(round({col} * {p})) / count({col}) / {p})"


# ---------------------------------------------------------------- marts and layers (§2.2-2.4)
for _name, _doc in [("fct_daily", "M1 daily fact"), ("fct_sleep_sessions", "M2 sleep sessions"),
                    ("fct_sleep", "M4 night fact"), ("fct_hourly", "M5 hourly fact"),
                    ("fct_heartrate_hourly", "M6 heart rate by hour"), ("fct_heartrate_daily", "M7 resting estimate"),
                    ("fct_daily_sleep", "M8 day + night"), ("dim_user", "M9 user dimension"),
                    ("cln_weight", "C10 weight without fat column"),
                    ("dq_reconciliation", "C12/C13 reconciliation")]:
    register(_name, (lambda n: lambda wh: wh.table(n))(_name), f"SELECT * FROM {_name}", _doc)

# ---------------------------------------------------------------- insight library (§2.5)
_WORN = "(SELECT * FROM fct_daily WHERE is_valid_day) d"
_MVPA = "fairly_active_min + very_active_min"
_SHARE = "100.0::DOUBLE * count(*) FILTER (WHERE {}) / NULLIF(count(*), 0)"


def _mean(col: str, k: int = 0) -> str:
    """Rounded mean of an integer column, as one division of whole sums."""
    return r(f"CAST(sum({col}) AS DOUBLE) / NULLIF(count({col}), 0)", k)


register("kpi_snapshot", A.kpi_snapshot, f"""SELECT count(DISTINCT user_id) AS users, count(*) AS valid_days,
    {_mean('steps')} AS avg_steps, {_mean('calories')} AS avg_calories,
    {r('CAST(sum(sedentary_min) AS DOUBLE) / count(*) / 60', 1)} AS avg_sedentary_h, {_mean(_MVPA, 1)} AS avg_mvpa_min,
    {r(_SHARE.format('steps >= 10000'), 1)} AS pct_days_10k, {r(_SHARE.format('met_30_min_mvpa'), 1)} AS pct_days_30min_mvpa
    FROM {_WORN}""", "A1")
register("data_quality", A.data_quality, "SELECT * FROM dq_log ORDER BY step", "A2 / C9 audit log")
register("weekday_rhythm", A.weekday_rhythm, f"""SELECT weekday, {_mean('steps')} AS avg_steps,
    {_mean('sedentary_min')} AS avg_sedentary_min, {_mean(_MVPA, 1)} AS avg_mvpa_min, count(*) AS valid_days
    FROM {_WORN} GROUP BY weekday ORDER BY any_value(weekday_num)""", "A4")
register("hourly_curve", A.hourly_curve, f"""SELECT hour_of_day, {_mean('steps')} AS avg_steps, {_mean('calories', 1)} AS avg_calories,
    {_mean('total_intensity', 1)} AS avg_intensity FROM fct_hourly GROUP BY hour_of_day""", "A5")
register("weekend_vs_weekday_hours", A.weekend_vs_weekday_hours, f"""SELECT hour_of_day, max(m) FILTER (WHERE NOT is_weekend) AS weekday_steps,
    max(m) FILTER (WHERE is_weekend) AS weekend_steps
    FROM (SELECT hour_of_day, is_weekend, {_mean('steps')} AS m FROM fct_hourly GROUP BY hour_of_day, is_weekend) GROUP BY hour_of_day""", "A6")
register("intensity_mix", A.intensity_mix, """SELECT level, minutes * 100.0::DOUBLE / total AS pct_of_tracked_time FROM (
    UNPIVOT (SELECT CAST(sum(tracked_min) AS DOUBLE) AS total, CAST(sum(sedentary_min) AS DOUBLE) AS "Sedentary",
                    CAST(sum(lightly_active_min) AS DOUBLE) AS "Light", CAST(sum(fairly_active_min) AS DOUBLE) AS "Fairly active",
                    CAST(sum(very_active_min) AS DOUBLE) AS "Very active" FROM fct_daily WHERE is_valid_day)
    ON "Sedentary", "Light", "Fairly active", "Very active" INTO NAME level VALUE minutes)""", "A7")
register("step_bands_energy", A.step_bands_energy, f"""SELECT step_band, count(*) AS valid_days, {_mean('calories')} AS avg_calories,
    {_mean('very_active_min', 1)} AS avg_very_active_min FROM {_WORN} GROUP BY step_band""", "A8")


def _r(x: str, y: str) -> str:
    """DuckDB's own correlation of the complete pairs; a constant column's NaN is NULL."""
    return f"NULLIF(corr(CAST({y} AS DOUBLE), CAST({x} AS DOUBLE)), 'nan'::DOUBLE)"


def _corr_sql(x: str, y: str, k: int) -> str:
    return r(r(_r(x, y), 6), k)


register("calorie_drivers", A.calorie_drivers, f"""SELECT unnest({A.CALORIE_METRICS!r}) AS metric,
    unnest([{', '.join(_corr_sql(m, 'calories', 2) for m in A.CALORIE_METRICS)}]) AS corr_with_calories
    FROM fct_daily WHERE is_valid_day ORDER BY corr_with_calories DESC""", "A9")
_BED_RANGES = """(VALUES (-1e9, 23, '1 Before 11 PM'), (23, 24.5, '2 11 PM - 12:30 AM'), (24.5, 1e9, '3 After 12:30 AM')) w(lo, hi, label)"""
_SIT_RANGES = "(VALUES (0, 600, '1 Under 10 h'), (600, 780, '2 10-13 h'), (780, NULL, '3 Over 13 h')) w(lo, hi, label)"
register("sleep_overview", A.sleep_overview, f"""SELECT t.* EXCLUDE (bed),
    lpad(CAST(bed // 60 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(bed % 60 AS VARCHAR), 2, '0') AS avg_bedtime
    FROM (SELECT count(*) AS nights, count(DISTINCT user_id) AS users, {r(_avg_r('hours_asleep', 2), 2)} AS avg_hours_asleep,
            {r(_avg_r('efficiency_pct', 1), 1)} AS avg_efficiency_pct, {_mean('minutes_awake_in_bed')} AS avg_awake_in_bed_min,
            {r(_SHARE.format('minutes_asleep < 420'), 1)} AS pct_nights_under_7h,
            CAST(sum(round(bedtime_hour * 60)) / count(bedtime_hour) AS BIGINT) AS bed FROM fct_sleep) t""", "A10")
register("sleep_bands", A.sleep_bands, f"""SELECT sleep_band, n AS nights, {r('n * 100.0::DOUBLE / (SELECT count(*) FROM fct_sleep)', 1)} AS pct_nights
    FROM (SELECT sleep_band, count(*) AS n FROM fct_sleep GROUP BY sleep_band)""", "A11")
register("bedtime_effect", A.bedtime_effect, f"""SELECT w.label AS bedtime_window, count(*) AS nights,
    {r(_avg_r('hours_asleep', 2), 2)} AS avg_hours_asleep, {r(_avg_r('efficiency_pct', 1), 1)} AS avg_efficiency
    FROM fct_sleep JOIN {_BED_RANGES} ON bedtime_hour >= w.lo AND bedtime_hour < w.hi GROUP BY w.label""", "A12")
register("sitting_vs_sleep", A.sitting_vs_sleep, f"""SELECT w.label AS sedentary_band, count(*) AS nights,
    {r(_avg_r('hours_asleep', 2), 2)} AS avg_hours_asleep
    FROM fct_daily_sleep JOIN {_SIT_RANGES} ON sedentary_min >= w.lo AND (sedentary_min < w.hi OR w.hi IS NULL) GROUP BY w.label""", "A13")
register("heart_rate_profile", A.heart_rate_profile, f"""SELECT hour_of_day, {r(_avg_r('avg_bpm', 1), 1)} AS avg_bpm, max(max_bpm) AS peak_bpm
    FROM fct_heartrate_hourly GROUP BY hour_of_day""", "A14")
register("engagement_decay", A.engagement_decay, f"""SELECT e.study_week, e.active_users, coalesce(v.valid_days, 0) AS valid_days, v.avg_steps
    FROM (SELECT study_week, count(*) AS active_users FROM (SELECT DISTINCT study_week, user_id FROM fct_daily) GROUP BY 1) e
    LEFT JOIN (SELECT study_week, count(*) AS valid_days, {_mean('steps')} AS avg_steps FROM {_WORN} GROUP BY 1) v USING (study_week)
    WHERE e.study_week <= 4""", "A15")
_FEATURE_COUNTS = """(SELECT 'Activity' AS feature, count(*) AS users FROM dim_user UNION ALL
    SELECT feature, count(*) FILTER (WHERE days > 0) FROM (UNPIVOT dim_user ON sleep_nights AS 'Sleep', hr_days AS 'Heart rate',
        weight_logs AS 'Weight' INTO NAME feature VALUE days) GROUP BY feature)"""
register("feature_adoption", A.feature_adoption, f"SELECT * FROM {_FEATURE_COUNTS}", "A16")
register("who_guideline", A.who_guideline, f"""SELECT CASE ok WHEN TRUE THEN 'Meets guideline' ELSE 'Below guideline' END AS status, count(*) AS users,
    {r('sum(round(avg_mvpa_min * 10)) * 7 / count(avg_mvpa_min) / 10')} AS avg_weekly_mvpa_min
    FROM (SELECT avg_mvpa_min, coalesce(avg_mvpa_min * 7 >= 150, FALSE) AS ok FROM dim_user) GROUP BY ok""", "A18")

# ---------------------------------------------------------------- dashboard slices (§2.6)
from strideframe.config import StudyConfig as _Cfg  # noqa: E402
from strideframe.operators import slices as V  # noqa: E402
from strideframe.operators.filters import (  # noqa: E402
    Filters, default_slice, default_slice_sql, persona_filter, persona_members)

_C = _Cfg()


def _w(date_col: str | None, col: str = "user_id") -> str:
    return default_slice_sql(_C, date_col, col)


def _sliced(fn):
    return lambda wh: fn(wh, default_slice(wh))


_BT_MIN = "(sum(round(bedtime_hour * 60)) / count(bedtime_hour))"
_VALID = f"FROM fct_daily WHERE is_valid_day AND {_w('activity_date')}"

register("v_hour_curve", V.v_hour_curve,
         "SELECT hour_of_day, avg(steps) AS avg_steps FROM fct_hourly GROUP BY 1", "V1")
register("v_kpi", V.v_kpi, f"""SELECT {r('avg(steps)')} AS steps, {r('avg(sedentary_min) / 60', 1)} AS sed_h,
    {r('100 * avg((steps >= 10000)::INT)')} AS p10k, {r('avg(very_active_min + fairly_active_min)')} AS mvpa
    FROM fct_daily WHERE is_valid_day""", "V2")
register("v_sleep_kpi", V.v_sleep_kpi, f"""SELECT {r(_avg_r('hours_asleep', 2), 2)} AS h,
    {r('100 * avg((minutes_asleep < 420)::INT)')} AS short FROM fct_sleep""", "V3")
register("v_hr_curve", V.v_hr_curve, f"""SELECT hour_of_day, {_avg_r('avg_bpm', 1)} AS bpm
    FROM fct_heartrate_hourly GROUP BY 1""", "V4")
register("v_intensity_wide", V.v_intensity_wide, """SELECT CAST(sum(sedentary_min) AS BIGINT) AS s,
    CAST(sum(lightly_active_min) AS BIGINT) AS l, CAST(sum(fairly_active_min) AS BIGINT) AS f,
    CAST(sum(very_active_min) AS BIGINT) AS v
    FROM fct_daily WHERE is_valid_day""", "V5")
register("hour_two_sensor", V.hour_two_sensor, f"""SELECT coalesce(a.hour_of_day, b.hour_of_day) AS hour_of_day,
    a.avg_steps, b.bpm FROM
    (SELECT hour_of_day, avg(steps) AS avg_steps FROM fct_hourly GROUP BY 1) a
    FULL JOIN (SELECT hour_of_day, {_avg_r('avg_bpm', 1)} AS bpm FROM fct_heartrate_hourly
               GROUP BY 1) b USING (hour_of_day)""", "V40")
register("v_activity_kpi", _sliced(V.v_activity_kpi), f"""SELECT count(DISTINCT user_id) AS u, count(*) AS d,
    {r('avg(steps)')} AS s, {r('avg(calories)')} AS c, {r('avg(very_active_min + fairly_active_min)', 1)} AS m,
    {r('100 * avg(met_30_min_mvpa::INT)')} AS p30 {_VALID}""", "V7 / F3")
register("v_weekday_extremes", _sliced(V.v_weekday_extremes), f"""SELECT weekday, weekday_num, s, sed,
    s = max(s) OVER () AS is_best, s = min(s) OVER () AS is_worst FROM
    (SELECT weekday, weekday_num, avg(steps) AS s, avg(sedentary_min) / 60 AS sed {_VALID} GROUP BY ALL)""", "V8 / E16")
register("v_intraday", _sliced(V.v_intraday), f"""SELECT hour_of_day, avg(steps) FILTER (WHERE NOT is_weekend) AS wd,
    avg(steps) FILTER (WHERE is_weekend) AS we FROM fct_hourly WHERE {_w('activity_date')} GROUP BY 1""", "V9")
register("weekday_hour_pivot", _sliced(V.weekday_hour_pivot), "SELECT weekday, weekday_num, "
         + ", ".join(f"avg(steps) FILTER (WHERE hour_of_day = {h}) AS h{h:02d}" for h in range(24))
         + f" FROM fct_hourly WHERE {_w('activity_date')} GROUP BY ALL", "V10")
register("v_drivers", _sliced(V.v_drivers), f"""SELECT unnest({A.CALORIE_METRICS!r}) AS metric,
    unnest([{', '.join(_corr_sql(m, 'calories', 6) for m in A.CALORIE_METRICS)}]) AS corr_with_calories {_VALID}""", "V11")
_NUM = "CAST(CASE WHEN {0} IS NOT NULL THEN {1} END AS DOUBLE)"
_XS, _YS = _NUM.format("calories", "steps"), _NUM.format("steps", "calories")
_TREND = f"""SELECT regr_count({_YS}, {_XS}) AS n,
    CASE WHEN regr_count({_YS}, {_XS}) > 2 THEN {r(f"NULLIF(regr_slope({_YS}, {_XS}), 'nan'::DOUBLE)", 6)} END AS slope,
    CASE WHEN regr_count({_YS}, {_XS}) > 2 THEN {r(f"NULLIF(regr_intercept({_YS}, {_XS}), 'nan'::DOUBLE)", 6)} END AS intercept,
    min(steps) FILTER (WHERE calories IS NOT NULL) AS x_min, max(steps) FILTER (WHERE calories IS NOT NULL) AS x_max {_VALID}"""
register("linear_trend", _sliced(V.linear_trend), _TREND, "V12")
register("trend_grid", _sliced(V.trend_grid), f"""SELECT i, {r('x_min + i * (CAST(x_max - x_min AS DOUBLE) / 49)', 6)} AS x,
    {r('slope * (x_min + i * (CAST(x_max - x_min AS DOUBLE) / 49)) + intercept', 6)} AS y
    FROM ({_TREND}) t, range(50) g(i) WHERE slope IS NOT NULL""", "V13")
register("v_bands", _sliced(V.v_bands), f"""SELECT step_band, step_band[3:] AS label, avg(calories) AS c,
    avg(very_active_min) AS v, count(*) AS n {_VALID} GROUP BY 1""", "V14 / X16")
register("wear_by_date", _sliced(V.wear_by_date), f"""SELECT activity_date, count(*) FILTER (WHERE is_valid_day) AS n_valid,
    count(*) FILTER (WHERE NOT is_valid_day) AS n_invalid FROM fct_daily WHERE {_w('activity_date')} GROUP BY 1""", "V15")
register("wear_by_user", _sliced(V.wear_by_user), f"""SELECT user_id::VARCHAR AS u, CAST(sum(is_valid_day::INT) AS BIGINT) AS v,
    CASE WHEN sum(is_valid_day::INT) >= 25 THEN 'Committed' WHEN sum(is_valid_day::INT) >= 15 THEN 'Regular'
         ELSE 'Occasional' END AS tier FROM fct_daily WHERE {_w('activity_date')} GROUP BY 1""", "V16 / X18")
register("v_sleep_page_kpi", _sliced(V.v_sleep_page_kpi), f"""SELECT n, h, e, p7, {r('(bt_min / 60.0) % 24.0', 6)} AS bt,
    printf('%02d:%02d', CAST(floor((bt_min / 60.0) % 24.0) AS INTEGER),
           CAST(floor((((bt_min / 60.0) % 24.0) % 1.0) * 60) AS INTEGER)) AS bt_clock FROM
    (SELECT count(*) AS n, {r(_avg_r('hours_asleep', 2), 2)} AS h, {r(_avg_r('efficiency_pct', 1), 1)} AS e,
       {r('100 * avg((minutes_asleep < 420)::INT)')} AS p7, {_BT_MIN} AS bt_min FROM fct_sleep WHERE {_w('sleep_date')})""",
         "V17 / X17")
register("v_bedtime", _sliced(V.v_bedtime), f"""SELECT (CASE WHEN bedtime_hour < 23 THEN '1 Before 11 PM'
    WHEN bedtime_hour < 24.5 THEN '2 11 PM - 12:30 AM' ELSE '3 After 12:30 AM' END)[3:] AS w,
    min(bedtime_hour) AS o, {_avg_r('hours_asleep', 2)} AS h, count(*) AS n
    FROM fct_sleep WHERE bedtime_hour IS NOT NULL AND {_w('sleep_date')} GROUP BY 1""", "V18")
register("v_sit_sleep_r", _sliced(V.v_sit_sleep_r), f"""SELECT count(*) AS n, CASE WHEN count(*) > 2 THEN
    {_corr_sql('sedentary_min / 60.0', 'hours_asleep', 6)}
    END AS r FROM fct_daily_sleep WHERE {_w('activity_date')}""", "V20")
register("band_reindex", _sliced(V.band_reindex), f"""SELECT d.band_order, d.sleep_band, coalesce(c.n, 0) AS n
    FROM (SELECT * FROM (VALUES (1, 'Short (< 6 h)'), (2, 'Borderline (6-7 h)'), (3, 'Healthy (7-9 h)'),
                                (4, 'Long (> 9 h)')) t(band_order, sleep_band)) d
    LEFT JOIN (SELECT sleep_band, count(*) AS n FROM fct_sleep WHERE {_w('sleep_date')} GROUP BY 1) c USING (sleep_band)""",
         "V21")
register("v_sleep_weekday", _sliced(V.v_sleep_weekday), f"""SELECT weekday, weekday_num, {_avg_r('hours_asleep', 2)} AS h,
    {_BT_MIN} / 60 AS b FROM fct_sleep WHERE {_w('sleep_date')} GROUP BY ALL""", "V22")
register("v_hr_band", _sliced(V.v_hr_band), f"""SELECT hour_of_day, {_avg_r('avg_bpm', 1)} AS bpm, avg(min_bpm) AS lo,
    avg(max_bpm) AS hi FROM fct_heartrate_hourly WHERE {_w('activity_date')} GROUP BY 1""", "V23")
register("v_resting", _sliced(V.v_resting), f"""SELECT user_id::VARCHAR AS u, resting_bpm FROM dim_user
    WHERE resting_bpm IS NOT NULL AND {_w(None)}""", "V24")
register("user_series", V.user_series, """SELECT user_id, activity_date, steps, is_valid_day,
    very_active_min + fairly_active_min AS mvpa, sedentary_min FROM fct_daily""", "V29")
register("cohort_daily", V.cohort_daily, "SELECT activity_date, avg(steps) AS s FROM fct_daily WHERE is_valid_day GROUP BY 1",
         "V30")
register("wear_calendar", V.wear_calendar, """SELECT user_id, activity_date,
    CAST((activity_date - min(activity_date) OVER (PARTITION BY user_id)) // 7 AS INTEGER) AS week,
    CAST(isodow(activity_date) - 1 AS INTEGER) AS dow, CASE WHEN is_valid_day THEN steps ELSE 0 END AS fill
    FROM fct_daily""", "V31 / V41 / W3")
register("user_nights", V.user_nights, """SELECT user_id, sleep_date, hours_asleep, efficiency_pct,
    hours_asleep >= 7 AS meets_7h FROM fct_sleep""", "V32")
register("user_card", V.user_card, f"""SELECT user_id, valid_days, logged_days, avg_steps, avg_mvpa_min,
    {r('avg_mvpa_min * 7')} AS weekly_mvpa_min, avg_mvpa_min * 7 >= 150 AS meets_who,
    {r('avg_sedentary_min / 60', 1)} AS sitting_h,
    CASE WHEN sleep_nights > 0 THEN printf('%.2f h', avg_sleep_h) ELSE 'not tracked' END AS sleep_label,
    sleep_nights, features_used FROM dim_user""", "V38")
register("valid_days", V.valid_days, "SELECT * FROM fct_daily WHERE is_valid_day", "V39")
register("dq_filtered_sum", V.dq_filtered_sum,
         "SELECT CAST(sum(rows_before) FILTER (WHERE table_name = 'heartrate') AS BIGINT) AS hr FROM dq_log", "V33")
register("dq_subset", V.dq_subset, """SELECT step || ' ' || table_name AS label, rows_before, rows_after FROM dq_log
    WHERE table_name IN ('daily_activity', 'sleep_day', 'hourly', 'weight')""", "V34")
register("top_k_least_sleep", V.top_k_least_sleep, f"""SELECT user_id, {r(_avg_r('hours_asleep', 2), 2)} AS avg_sleep_h,
    {r('avg(sedentary_min) / 60', 1)} AS avg_sitting_h FROM fct_daily_sleep GROUP BY user_id
    ORDER BY avg_sleep_h, user_id LIMIT 10""", "V35")

# ---------------------------------------------------------------- statistics (§2.8, §2.10)
from strideframe.operators import checks as Q  # noqa: E402
from strideframe.operators import personas as P  # noqa: E402
from strideframe.operators import profile as E  # noqa: E402
from strideframe.operators import stats as H  # noqa: E402
from strideframe.operators.ranks import mid_ranks as _mid_ranks  # noqa: E402
from strideframe.sources import catalog as S  # noqa: E402
from strideframe.sources.landing import RAW_FILES  # noqa: E402


def _welch_sql(frm: str, cond: str, val: str) -> str:
    return f"""WITH g AS (SELECT {cond} AS g, count(*) AS n, avg({val}) AS m, var_samp({val}) AS v FROM {frm}
        AND ({cond}) IS NOT NULL AND {val} IS NOT NULL GROUP BY 1),
      j AS (SELECT a.n AS n1, a.m AS m1, a.v AS v1, b.n AS n2, b.m AS m2, b.v AS v2
            FROM (SELECT * FROM g WHERE g) a, (SELECT * FROM g WHERE NOT g) b)
      SELECT n1, n2, {r('m1', 6)} AS mean1, {r('m2', 6)} AS mean2,
        {r('(m1 - m2) / NULLIF(sqrt(v1 / n1 + v2 / n2), 0)', 6)} AS t,
        {r('(v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / NULLIF((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1), 0)', 6)} AS dof
      FROM j"""


def _kruskal_sql(frm: str, val: str, grp: str) -> str:
    return f"""WITH d AS (SELECT {grp} AS grp, {val} AS v FROM {frm} AND {val} IS NOT NULL AND {grp} IS NOT NULL),
      rk AS (SELECT grp, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS mr FROM d),
      rs AS (SELECT grp, sum(mr) AS R, count(*) AS ng FROM rk GROUP BY grp),
      s AS (SELECT sum(R * R / ng) AS sr, sum(ng) AS N, count(*) AS k FROM rs),
      t AS (SELECT sum(CAST(n AS DOUBLE) ^ 3 - n) AS tt FROM (SELECT count(*) AS n FROM d GROUP BY v))
      SELECT CAST(N AS BIGINT) AS N, k,
        {r('(12.0 / (N * (N + 1)) * sr - 3.0 * (N + 1)) / NULLIF(1.0 - tt / (CAST(N AS DOUBLE) ^ 3 - N), 0)', 6)} AS H
      FROM s, t"""


_VD = "fct_daily WHERE is_valid_day"
_WIN = ("CASE WHEN bedtime_hour < 23 THEN '1 Before 11 PM' WHEN bedtime_hour < 24.5 THEN '2 11 PM - 12:30 AM' "
        "ELSE '3 After 12:30 AM' END")
register("welch_weekend", H.weekend_welch, _welch_sql(_VD, "NOT is_weekend", "steps"), "H1 Welch t")
register("kruskal_weekday", H.weekday_kruskal, _kruskal_sql(_VD, "steps", "weekday"), "H2 Kruskal-Wallis")


def _pearson_test_sql(x: str, y: str, frm: str) -> str:
    return f"""SELECT n, {r('c', 6)} AS r, {r('c * sqrt((n - 2) / (1.0 - c * c))', 6)} AS t
        FROM (SELECT regr_count({y}, {x}) AS n, {_r(x, y)} AS c FROM {frm})"""


register("pearson_sit_sleep", H.sit_sleep_pearson, _pearson_test_sql("sedentary_min", "hours_asleep", "fct_daily_sleep"),
         "H3 Pearson")
register("pearson_active_calories", H.active_calories_pearson, _pearson_test_sql("very_active_min", "calories", _VD),
         "H3 Pearson")
register("spearman_sit_sleep", H.sit_sleep_spearman, f"""WITH d AS (SELECT sedentary_min AS x, hours_asleep AS y
      FROM fct_daily_sleep WHERE sedentary_min IS NOT NULL AND hours_asleep IS NOT NULL),
    rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d)
    SELECT n, {r('c', 6)} AS rho, {r('c * sqrt((n - 2) / (1.0 - c * c))', 6)} AS t
    FROM (SELECT count(*) AS n, {_r('rx', 'ry')} AS c FROM rk)""", "H4 Spearman (mid-ranks, W4)", once=("fct_daily_sleep",))
register("anova_bedtime", H.bedtime_anova, f"""WITH g AS (SELECT {_WIN} AS grp, count(*) AS n, avg(hours_asleep) AS m,
      var_samp(hours_asleep) AS v FROM fct_sleep WHERE bedtime_hour IS NOT NULL AND hours_asleep IS NOT NULL GROUP BY 1),
    t AS (SELECT sum(n) AS n_all, count(*) AS k_all, sum(n * m) / sum(n) AS gm FROM g)
    SELECT CAST(n_all AS BIGINT) AS N, k_all AS k, {r('(sum(n * (m - gm) * (m - gm)) / (k_all - 1)) / NULLIF(sum((n - 1) * coalesce(v, 0)) / (n_all - k_all), 0)', 6)} AS F
    FROM g, t GROUP BY n_all, k_all""", "H5 one-way ANOVA", once=("fct_sleep",))
register("welch_bedtime", H.bedtime_welch,
         _welch_sql(f"(SELECT *, {_WIN} AS bedtime_window FROM fct_sleep WHERE bedtime_hour IS NOT NULL) w "
                    "WHERE bedtime_window IN ('1 Before 11 PM', '3 After 12:30 AM')", "bedtime_window = '1 Before 11 PM'",
                    "hours_asleep"), "H1 Welch t (bedtime)")


def _matrix_sql(cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[: i + 1]]
    return ("SELECT unnest([" + ", ".join(f"'{a}'" for a, _ in pairs) + "]) AS var_a, unnest(["
            + ", ".join(f"'{b}'" for _, b in pairs) + "]) AS var_b, unnest(["
            + ", ".join(_corr_sql(a, b, 6) for a, b in pairs) + "]) AS r FROM fct_daily_sleep")


register("corr_matrix", H.corr_matrix, _matrix_sql(CORR_COLUMNS), "H8 Pearson matrix")
register("corr_matrix_all", lambda wh: H.corr_matrix(wh, CORR_COLUMNS_ALL), _matrix_sql(CORR_COLUMNS_ALL),
         "H8 Pearson matrix with time in bed and bedtime")
register("test_summary", lambda wh: H.test_summary(wh, wh.dim_user_persona), None, "H6 / H7 test table with p-values", once=("fct_daily", "fct_sleep", "fct_daily_sleep", "dim_user", "dim_user_persona"))
_POISSON = B.poisson_sql("h")
register("regression_ci", H.regression_ci, None, "H9 regression line with 95% band")
register("mean_ci", H.mean_ci, None, "H10 mean with 95% t interval")
register("mean_ci_bootstrap", H.mean_ci_bootstrap, f"""WITH w AS (SELECT step_band, calories, b, {_POISSON} AS w
      FROM (SELECT *, {B.draw_sql('user_id', "date_diff('day', DATE '1970-01-01', activity_date)", 'b')} AS h
            FROM fct_daily, range({B.REPLICATES}) t(b) WHERE is_valid_day AND calories IS NOT NULL)),
    m AS (SELECT step_band, CAST(sum(w * calories) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS m FROM w GROUP BY step_band, b HAVING sum(w) > 0)
    SELECT step_band, {r('quantile_cont(m, 0.025)', 6)} AS lo, {r('quantile_cont(m, 0.975)', 6)} AS hi FROM m GROUP BY step_band""", "H10 bootstrap interval")
register("regression_ci_bootstrap", H.regression_ci_bootstrap, f"""WITH d AS (SELECT *, CAST(round(hours_asleep * 100) AS BIGINT) AS y FROM fct_daily_sleep
      WHERE sedentary_min IS NOT NULL AND hours_asleep IS NOT NULL),
    w AS (SELECT sedentary_min AS x, y, b, {_POISSON} AS w FROM (SELECT *, {B.draw_sql('user_id', "date_diff('day', DATE '1970-01-01', activity_date)", 'b')} AS h
          FROM d, range({B.REPLICATES}) t(b))),
    s AS (SELECT b, CAST(sum(w) AS DOUBLE) AS n, CAST(sum(w * x) AS DOUBLE) AS sx, CAST(sum(w * y) AS DOUBLE) AS sy,
                 CAST(sum(w * x * x) AS DOUBLE) AS sxx, CAST(sum(w * x * y) AS DOUBLE) AS sxy FROM w GROUP BY b),
    l AS (SELECT n, sx, sy, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM s WHERE n * sxx - sx * sx > 0),
    e AS (SELECT min(sedentary_min) AS lo, max(sedentary_min) AS hi FROM d)
    SELECT CAST(i AS INTEGER) AS i, {r('quantile_cont((sy - slope * sx) / n + slope * (e.lo + i * (e.hi - e.lo) / 49.0::DOUBLE), 0.025) / 100', 6)} AS lo,
           {r('quantile_cont((sy - slope * sx) / n + slope * (e.lo + i * (e.hi - e.lo) / 49.0::DOUBLE), 0.975) / 100', 6)} AS hi
    FROM l, e, range(50) g(i) GROUP BY i""", "H9 bootstrap band", once=("fct_daily_sleep",))
register("regression_line", H.regression_line, f"""SELECT regr_count(hours_asleep, sedentary_min) AS n,
    {r('regr_slope(hours_asleep, sedentary_min)', 6)} AS slope, {r('regr_intercept(hours_asleep, sedentary_min)', 6)} AS intercept
    FROM fct_daily_sleep""", "H9 line")
register("mean_sd", lambda wh: H.mean_sd(wh).select("step_band", "n", rnd("mean", 6).alias("mean"), rnd("sd", 6).alias("sd")),
         f"""SELECT step_band, count(calories) AS n, {r('avg(calories)', 6)} AS mean, {r('stddev_samp(calories)', 6)} AS sd
    FROM fct_daily WHERE is_valid_day GROUP BY step_band""", "H10 moments")
register("mid_ranks", lambda wh: _mid_ranks(wh.fct_daily.filter("is_valid_day"), "steps").drop("total"),
         """SELECT steps AS v, count(*) AS n, min(before) + (count(*) + 1) / 2.0 AS midrank
    FROM (SELECT steps, count(*) OVER (ORDER BY steps RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 - count(*) OVER (PARTITION BY steps) AS before FROM fct_daily WHERE is_valid_day AND steps IS NOT NULL)
    GROUP BY steps""", "W4 distributed mid-ranks")

# ---------------------------------------------------------------- profiling (§2.9)
_RAW_CTE = {"dailyActivity": "raw_daily_activity", "dailySteps": "raw_daily_steps",
            "dailyCalories": "raw_daily_calories", "sleepDay": "raw_sleep_day", "minuteSleep": "raw_minute_sleep",
            "hourlySteps": "raw_hourly_steps", "hourlyCalories": "raw_hourly_calories",
            "hourlyIntensities": "raw_hourly_intensities", "heartrate_seconds": "raw_heartrate",
            "weightLogInfo": "raw_weight"}
register("profile_tables", lambda wh: E.profile_tables(wh.raw), " UNION ALL ".join(
    f"SELECT '{f}' AS file, count(*) AS rows, {len(c)} AS columns, count(DISTINCT Id) AS users FROM {_RAW_CTE[f]}"
    for f, c in RAW_FILES.items()), "E1")
register("duplicate_count", lambda wh: E.duplicate_count(wh.raw), " UNION ALL ".join(
    f"SELECT '{f}' AS file, (SELECT count(*) FROM {_RAW_CTE[f]}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_RAW_CTE[f]})) AS duplicate_rows"
    for f in RAW_FILES), "E2")
_NULLS = " UNION ALL ".join(
    f"SELECT '{f}' AS file, '{c}' AS column, count(*) AS rows, count(*) FILTER (WHERE \"{c}\" IS NULL) AS nulls FROM {_RAW_CTE[f]}"
    for f, cols in RAW_FILES.items() for c in cols)
register("null_count", lambda wh: E.null_count(wh.raw), _NULLS, "E3")
register("null_top", lambda wh: E.null_top(wh.raw), f"""SELECT file, "column", nulls * 100.0::DOUBLE / rows AS pct FROM ({_NULLS})
    ORDER BY pct DESC, file, "column" LIMIT 12""", "E4")
_DESC_COLS = RAW_FILES["dailyActivity"][2:]
register("describe", lambda wh: E.describe(wh.raw.daily_activity, _DESC_COLS), " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count(x) AS count, {r('avg(x)', 6)} AS mean, {r('stddev_samp(x)', 6)} AS std, min(x) AS min,
        {r('quantile_cont(x, 0.25)', 6)} AS q25, {r('quantile_cont(x, 0.5)', 6)} AS q50, {r('quantile_cont(x, 0.75)', 6)} AS q75,
        max(x) AS max FROM (SELECT CAST({c} AS DOUBLE) AS x FROM raw_daily_activity)""" for c in _DESC_COLS), "E5")
_NU_FILES = ["dailyActivity", "sleepDay", "weightLogInfo", "hourlySteps"]


def _nunique_all(wh):
    parts = [E.nunique(dict(wh.raw.items())[f], f) for f in _NU_FILES]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


register("nunique", _nunique_all, " UNION ALL ".join(
    f"SELECT '{f}' AS file, '{c}' AS column, count(DISTINCT \"{c}\") AS distinct_values FROM {_RAW_CTE[f]}"
    for f in _NU_FILES for c in RAW_FILES[f]), "E6")
register("crosstab", lambda wh: E.crosstab(wh.dim_user), """SELECT d.seg_order, d.step_segment,
    coalesce(count(*) FILTER (WHERE u.engagement_tier = 'Occasional'), 0) AS Occasional,
    coalesce(count(*) FILTER (WHERE u.engagement_tier = 'Regular'), 0) AS Regular,
    coalesce(count(*) FILTER (WHERE u.engagement_tier = 'Committed'), 0) AS Committed
    FROM (VALUES (1, 'Sedentary'), (2, 'Low Active'), (3, 'Somewhat Active'), (4, 'Active')) d(seg_order, step_segment)
    LEFT JOIN dim_user u USING (step_segment) GROUP BY 1, 2""", "E7")
register("ecdf", lambda wh: E.ecdf(wh.dim_user, "valid_days"), """SELECT valid_days, count(*) AS n,
    sum(count(*)) OVER (ORDER BY valid_days) / sum(count(*)) OVER () AS ecdf FROM dim_user
    WHERE valid_days IS NOT NULL GROUP BY valid_days""", "E9", once=("dim_user",))


def _box_sql(frm: str, col: str, by: str | None) -> str:
    g = f"{by}, " if by else ""
    j = f"USING ({by})" if by else "ON TRUE"
    return f"""WITH d AS (SELECT {g}{col} AS x FROM {frm} AND {col} IS NOT NULL),
      q AS (SELECT {g}quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
            FROM d {'GROUP BY ' + by if by else ''})
      SELECT {g}count(*) AS n, {r('q1', 6)} AS q1, {r('median', 6)} AS median, {r('q3', 6)} AS q3,
        min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)) AS whisker_lo, max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
        count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
      FROM d JOIN q {j} GROUP BY {g}q1, median, q3"""


register("box_steps_weekday", lambda wh: E.box_stats(wh.fct_daily.filter("is_valid_day"), "steps", ["weekday"]),
         _box_sql("fct_daily WHERE is_valid_day", "steps", "weekday"), "E10 by weekday")
register("box_sleep_window", lambda wh: E.box_stats(
    wh.fct_sleep.filter("bedtime_hour IS NOT NULL").withColumn("bedtime_window", A.bedtime_window()), "hours_asleep",
    ["bedtime_window"]),
    _box_sql(f"(SELECT *, {_WIN} AS bedtime_window FROM fct_sleep) s WHERE bedtime_hour IS NOT NULL", "hours_asleep",
             "bedtime_window"),
    "E10 by bedtime window", once=("fct_sleep",))
register("box_steps", lambda wh: E.box_stats(wh.fct_daily.filter("is_valid_day"), "steps"),
         _box_sql("fct_daily WHERE is_valid_day", "steps", None), "E10 overall")


def _hist_sql(frm: str, col: str, bins: int) -> str:
    w = f"((hi - lo) / {bins})"
    return f"""WITH d AS (SELECT {col} AS x FROM {frm} AND {col} IS NOT NULL),
      m AS (SELECT CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi FROM d),
      b AS (SELECT CAST(coalesce(least(floor((x - lo) / NULLIF({w}, 0)), {bins - 1}), 0) AS INTEGER) AS bin, lo, hi FROM d, m)
      SELECT bin, {r(f'lo + bin * {w}', 6)} AS bin_start, {r(f'lo + (bin + 1) * {w}', 6)} AS bin_end, count(*) AS n
      FROM b GROUP BY bin, lo, hi"""


register("histogram_bedtime", lambda wh: E.histogram(wh.fct_sleep, "bedtime_hour", 36),
         _hist_sql("fct_sleep WHERE TRUE", "bedtime_hour", 36), "E11 / V19 36 bins", once=("fct_sleep",))
register("histogram_steps", lambda wh: E.histogram(wh.fct_daily.filter("is_valid_day"), "steps", 35),
         _hist_sql("fct_daily WHERE is_valid_day", "steps", 35), "E11 35 bins")
register("histogram_sleep", lambda wh: E.histogram(wh.fct_sleep, "hours_asleep", 28),
         _hist_sql("fct_sleep WHERE TRUE", "hours_asleep", 28), "E11 28 bins", once=("fct_sleep",))


def _kde_sql(frm: str, col: str, by: str | None = None, grid: int = 200) -> str:
    g, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON TRUE")
    return f"""WITH d AS (SELECT {g}CAST({col} AS DOUBLE) AS v FROM {frm} AND {col} IS NOT NULL),
      m AS (SELECT {g}count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * pow(count(*), -0.2) AS h FROM d {'GROUP BY ' + by if by else ''}),
      p AS (SELECT {g}i, v, n, h, lo + i * (hi - lo) / {grid - 1} AS gx FROM d JOIN m {on}, range({grid}) t(i))
      SELECT {g}CAST(i AS INTEGER) AS i, {r('min(gx)', 6)} AS x,
        {r('sum(exp(-0.5 * ((gx - v) / NULLIF(h, 0)) * ((gx - v) / NULLIF(h, 0))) / (n * NULLIF(h, 0) * sqrt(2 * pi())))', 9)} AS density
      FROM p GROUP BY {g}i"""


register("kde_steps", lambda wh: E.kde(wh.fct_daily.filter("is_valid_day"), "steps"), _kde_sql(_VD, "steps"), "E12 kernel density")
register("kde_steps_weekday", lambda wh: E.kde(wh.fct_daily.filter("is_valid_day"), "steps", by="weekday"),
         _kde_sql(_VD, "steps", "weekday"), "E12 density per weekday")
register("hexbin", lambda wh: E.hexbin(wh.fct_daily.filter("is_valid_day"), "very_active_min", "calories", 28),
         """WITH d AS (SELECT CAST(very_active_min AS DOUBLE) AS x, CAST(calories AS DOUBLE) AS y FROM fct_daily
                       WHERE is_valid_day AND very_active_min IS NOT NULL AND calories IS NOT NULL),
      e0 AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM d),
      e AS (SELECT x0 - (x1 - x0) * 1e-9 AS xmin, x1 + (x1 - x0) * 1e-9 AS xmax,
                   y0 - (y1 - y0) * 1e-9 AS ymin, y1 + (y1 - y0) * 1e-9 AS ymax FROM e0),
      p AS (SELECT coalesce((x - xmin) / NULLIF((xmax - xmin) / 28, 0), 0) AS ix,
                   coalesce((y - ymin) / NULLIF((ymax - ymin) / 16, 0), 0) AS iy,
                   xmin, ymin, (xmax - xmin) / 28 AS sx, (ymax - ymin) / 16 AS sy FROM d, e),
      c AS (SELECT (ix - round_even(ix, 0)) * (ix - round_even(ix, 0)) + 3.0 * ((iy - round_even(iy, 0)) * (iy - round_even(iy, 0)))
                 < (ix - floor(ix) - 0.5) * (ix - floor(ix) - 0.5) + 3.0 * ((iy - floor(iy) - 0.5) * (iy - floor(iy) - 0.5)) AS lattice1,
                   ix, iy, xmin, ymin, sx, sy FROM p),
      k AS (SELECT lattice1, CAST(CASE WHEN lattice1 THEN round_even(ix, 0) ELSE floor(ix) END AS INTEGER) AS i,
                   CAST(CASE WHEN lattice1 THEN round_even(iy, 0) ELSE floor(iy) END AS INTEGER) AS j, xmin, ymin, sx, sy FROM c)
      SELECT lattice1, i, j, """ + r("xmin + (i + CASE WHEN lattice1 THEN 0.0 ELSE 0.5 END) * sx", 6) + " AS cx, "
         + r("ymin + (j + CASE WHEN lattice1 THEN 0.0 ELSE 0.5 END) * sy", 6)
         + " AS cy, count(*) AS n FROM k GROUP BY lattice1, i, j, xmin, ymin, sx, sy", "E13 gridsize 28")
register("median_mean", lambda wh: E.median_mean(wh.fct_daily.filter("is_valid_day"), "steps"),
         f"SELECT {r('quantile_cont(steps, 0.5)', 6)} AS median, {r('avg(steps)', 6)} AS mean FROM fct_daily WHERE is_valid_day",
         "E15")
register("weekend_pivot", lambda wh: E.weekend_pivot(wh.fct_hourly), """SELECT hour_of_day,
    avg(steps) FILTER (WHERE NOT is_weekend) AS weekday, avg(steps) FILTER (WHERE is_weekend) AS weekend
    FROM fct_hourly GROUP BY 1""", "E17")
register("feature_share", lambda wh: E.feature_share(wh.dim_user), f"""SELECT feature, users,
    {r('users * 100.0 / (SELECT count(*) FROM dim_user)', 1)} AS pct_users FROM {_FEATURE_COUNTS}""", "E20")

# ---------------------------------------------------------------- checks (§2.13)
register("dq_checks", Q.all_checks, f"""
    SELECT 'valid_days_follow_wear_rule' AS check_name, count(*) FILTER (WHERE is_valid_day AND (steps = 0 OR tracked_min < {_C.min_wear_min})) AS failing,
           CAST(NULL AS VARCHAR) AS detail FROM fct_daily
    UNION ALL SELECT 'no_duplicate_nights', count(*) - count(DISTINCT (user_id, sleep_date)), NULL FROM fct_sleep
    UNION ALL SELECT 'partial_day_removed', CASE WHEN max(activity_date) = DATE '{_C.last_full_day.isoformat()}' THEN 0 ELSE 1 END,
           CAST(max(activity_date) AS VARCHAR) FROM fct_daily
    UNION ALL SELECT 'hours_in_range', count(*) FILTER (WHERE hour_of_day NOT BETWEEN 0 AND 23), NULL FROM fct_hourly
    UNION ALL SELECT 'heart_rate_plausible', count(*) FILTER (WHERE resting_bpm_est NOT BETWEEN 30 AND 120), NULL FROM fct_heartrate_daily
    UNION ALL SELECT 'daily_subfiles_reconcile', CAST(coalesce(sum(mismatches), 0) AS BIGINT), NULL FROM dq_reconciliation""",
         "Q1-Q6")
register("check_coverage", lambda wh: Q.check_coverage(wh, wh.dim_user_persona), None, "Q7", once=("dim_user", "dim_user_persona"))

# ---------------------------------------------------------------- sketches per date
_USERS = "count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE is_valid_day) AS valid_users"
register("users_between", lambda wh: K.users_between(wh.sketch_daily, wh.cfg.study_start + timedelta(days=6), wh.cfg.study_start + timedelta(days=19)),
         f"""SELECT {_USERS} FROM fct_daily
    WHERE activity_date BETWEEN DATE '{StudyConfig().study_start + timedelta(days=6)}' AND DATE '{StudyConfig().study_start + timedelta(days=19)}'""",
         "distinct users over a span of days, from sketches")
register("users_by_week", lambda wh: K.users_by_week(wh.sketch_daily), f"SELECT study_week, {_USERS} FROM fct_daily GROUP BY study_week",
         "distinct users by week, from sketches")
register("sketch_quantiles", lambda wh: K.quantiles(wh.sketch_daily, "steps").select(F.lit("steps").alias("metric"), "p", "q").unionByName(
    K.quantiles(wh.sketch_heart, "bpm").select(F.lit("bpm").alias("metric"), "p", "q")), None, "quantiles over all days, from sketches")

# ---------------------------------------------------------------- persona model (§2.7)
register("dim_user_persona", lambda wh: wh.dim_user_persona, None, "P1-P5 K-Means personas")
register("persona_profile", lambda wh: A.persona_profile(wh, wh.dim_user_persona), None, "A17 / V6 / V25 / P7", once=("dim_user", "dim_user_persona"))
register("elbow", lambda wh: wh.model_elbow, None, "P6 / V27 elbow curve")
register("cluster_centres", lambda wh: P.cluster_centres(
    wh.dim_user_persona.join(P.persona_features(wh.dim_user), "user_id")), None, "P4", once=("dim_user", "dim_user_persona"))
register("persona_minmax", lambda wh: P.persona_minmax(wh.dim_user, wh.dim_user_persona), None, "V26", once=("dim_user", "dim_user_persona"))
register("persona_zscore", lambda wh: P.persona_zscore(wh.dim_user, wh.dim_user_persona), None, "E8", once=("dim_user", "dim_user_persona"))
register("pair_by_persona", lambda wh: P.pair_by_persona(wh.fct_daily_sleep, wh.dim_user_persona), None, "E19", once=("fct_daily", "fct_sleep", "fct_daily_sleep", "dim_user", "dim_user_persona"))
register("points_by_persona", lambda wh: P.points_by_persona(wh.fct_daily_sleep, wh.dim_user_persona), None, "E19 point feed", once=("fct_daily", "fct_sleep", "fct_daily_sleep", "dim_user", "dim_user_persona"))
register("persona_members", lambda wh: persona_members(wh.dim_user_persona), None, "F4", once=("dim_user", "dim_user_persona"))


def _users_sorted(wh, personas):
    return wh.dim_user.join(personas.select("user_id", "persona"), "user_id").orderBy("persona", F.desc("avg_steps"), "user_id")


register("users_sorted", lambda wh: _users_sorted(wh, wh.dim_user_persona), None, "V36 / V37", once=("dim_user", "dim_user_persona"))

# the same operators on a grouping by rule, which SQL can build: the engagement tier of clustered users
_TIER = """(SELECT *, CASE engagement_tier WHEN 'Committed' THEN 0 WHEN 'Regular' THEN 1 ELSE 2 END AS cluster,
    engagement_tier AS persona FROM dim_user WHERE valid_days > 0) u"""
_FEATS = ", ".join(f"coalesce({f}, 0) AS {f}" for f in PERSONA_FEATURES)
_FEATURES = f"(SELECT user_id, cluster, {_FEATS} FROM {_TIER}) f"
_CENTRES = f"""(SELECT cluster, {', '.join(f'avg({f}) AS {f}' for f in PERSONA_FEATURES)},
    {', '.join(f'(SELECT avg({f}) FROM {_FEATURES}) AS overall_{f}' for f in PERSONA_FEATURES)} FROM {_FEATURES} GROUP BY cluster) c"""


def _rounded(df, cols, digits=6):
    return df.select(*[rnd(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _tier_centres(wh):
    return P.cluster_centres(P.by_tier(wh.dim_user).join(P.persona_features(wh.dim_user), "user_id"))


register("persona_features", lambda wh: P.persona_features(wh.dim_user),
         f"SELECT user_id, {_FEATS} FROM dim_user WHERE valid_days > 0", "P1")
register("zscore_pop", lambda wh: _rounded(P.zscore_pop(P.persona_features(wh.dim_user)), PERSONA_FEATURES), "SELECT user_id, " + ", ".join(
    r(f"coalesce(({f} - avg({f}) OVER ()) / NULLIF(stddev_pop({f}) OVER (), 0), 0)", 6) + f" AS {f}" for f in PERSONA_FEATURES)
    + f" FROM {_FEATURES}", "P2", once=("dim_user",))
_OVER = [*PERSONA_FEATURES, *(f"overall_{f}" for f in PERSONA_FEATURES)]
register("centres_by_tier", lambda wh: _rounded(_tier_centres(wh), _OVER), "SELECT cluster, "
         + ", ".join(r(c, 6) + f" AS {c}" for c in _OVER) + f" FROM {_CENTRES}", "P4 on tiers", once=("dim_user",))
register("names_by_tier", lambda wh: P.name_personas(_tier_centres(wh)), f"""SELECT cluster,
    base || CASE row_number() OVER (PARTITION BY base ORDER BY avg_mvpa_min DESC, cluster) WHEN 1 THEN '' WHEN 2 THEN ' II' ELSE ' III' END AS persona
    FROM (SELECT *, CASE WHEN avg_mvpa_min > 1.4 * overall_avg_mvpa_min THEN 'Performance Seekers'
      WHEN avg_light_min > 1.15 * overall_avg_light_min AND avg_steps >= overall_avg_steps THEN 'Everyday Movers'
      WHEN valid_days < 0.8 * overall_valid_days THEN 'Drifting Users' ELSE 'Desk-Bound Sitters' END AS base FROM {_CENTRES})""", "P5 on tiers", once=("dim_user",))
register("profile_by_tier", lambda wh: A.persona_profile(wh, P.by_tier(wh.dim_user)), f"""SELECT persona, count(*) AS users,
    {r('avg(avg_steps)')} AS avg_steps, {r(_avg_r('avg_mvpa_min', 1), 1)} AS avg_mvpa_min, {r('avg(avg_sedentary_min)')} AS avg_sedentary_min,
    {r('avg(avg_sedentary_min) / 60', 1)} AS sed_h, {r('avg(valid_days)', 1)} AS avg_valid_days,
    {r('avg(features_used)', 1)} AS avg_features_used FROM {_TIER} GROUP BY persona""", "A17 / V6 / V25 / P7 on tiers", once=("dim_user",))
_MINMAX = ("avg_steps", "avg_mvpa_min", "avg_light_min", "avg_sedentary_min", "valid_days")
register("minmax_by_tier", lambda wh: P.persona_minmax(wh.dim_user, P.by_tier(wh.dim_user)), "SELECT persona, " + ", ".join(
    r(f"(avg({f}) - (SELECT min({f}) FROM {_TIER})) / NULLIF((SELECT max({f}) - min({f}) FROM {_TIER}), 0)", 6) + f" AS {f}"
    for f in _MINMAX) + f" FROM {_TIER} GROUP BY persona", "V26 on tiers", once=("dim_user",))
register("zscore_by_tier", lambda wh: P.persona_zscore(wh.dim_user, P.by_tier(wh.dim_user)), "SELECT persona, " + ", ".join(
    r(f"avg(z_{f})", 6) + f" AS {f}" for f in PERSONA_Z_FEATURES) + " FROM (SELECT persona, " + ", ".join(
    f"({f} - avg({f}) OVER ()) / NULLIF(stddev_samp({f}) OVER (), 0) AS z_{f}" for f in PERSONA_Z_FEATURES)
    + f" FROM {_TIER}) GROUP BY persona", "E8 on tiers", once=("dim_user",))
_PAIRS = [(a, b) for i, a in enumerate(PAIR_COLUMNS) for b in PAIR_COLUMNS[i + 1:]]
register("pairs_by_tier", lambda wh: P.pair_by_persona(wh.fct_daily_sleep, P.by_tier(wh.dim_user)), " UNION ALL ".join(
    f"SELECT persona, count(*) AS days, '{a}' AS var_a, '{b}' AS var_b, {r(_r(a, b), 6)} AS r FROM fct_daily_sleep JOIN {_TIER} USING (user_id) GROUP BY persona"
    for a, b in _PAIRS), "E19 on tiers", once=("fct_daily", "fct_sleep", "fct_daily_sleep", "dim_user"))
register("points_by_tier", lambda wh: P.points_by_persona(wh.fct_daily_sleep, P.by_tier(wh.dim_user)), f"""SELECT persona, user_id, activity_date,
    {', '.join(PAIR_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY
        {B.draw_sql('user_id', "date_diff('day', DATE '1970-01-01', activity_date)", '0')}, user_id, activity_date) AS k
    FROM fct_daily_sleep JOIN {_TIER} USING (user_id)) WHERE k <= {P.POINTS}""", "E19 point feed on tiers", once=("fct_daily", "fct_sleep", "fct_daily_sleep", "dim_user"))
register("members_by_tier", lambda wh: persona_members(P.by_tier(wh.dim_user)),
         f"SELECT persona, user_id, count(*) OVER (PARTITION BY persona) AS members FROM {_TIER}", "F4 on tiers", once=("dim_user",))
register("users_sorted_by_tier", lambda wh: _users_sorted(wh, P.by_tier(wh.dim_user)),
         f"SELECT * EXCLUDE (cluster) FROM {_TIER}", "V36 / V37 on tiers", once=("dim_user",))
register("coverage_by_tier", lambda wh: Q.check_coverage(wh, P.by_tier(wh.dim_user)), f"""SELECT 'every_user_has_one_persona' AS check_name,
    abs((SELECT count(*) FROM dim_user) - (SELECT count(DISTINCT user_id) FROM {_TIER})) AS failing,
    (SELECT count(*) FROM dim_user WHERE valid_days <= 0) || ' users without persona' AS detail""", "Q7 on tiers", once=("dim_user",))
for _col in ("avg_steps", "avg_sedentary_min"):
    register(f"kruskal_{_col}_by_tier", (lambda c: lambda wh: H.persona_kruskal(wh, P.by_tier(wh.dim_user), c))(_col),
             _kruskal_sql(f"{_TIER} WHERE TRUE", _col, "persona"), "H2 on tiers", once=("dim_user",))

# ---------------------------------------------------------------- filters (§2.6)
_IDS = (3, 7, 11, 12, 19, 40, 41, 42, 77, 100)
_FROM, _TO = _C.study_start + timedelta(days=3), _C.study_start + timedelta(days=12)


def _slice_sql(where: str) -> str:
    return f"SELECT user_id, activity_date, steps, calories FROM fct_daily WHERE {where}"


def _slice(filters):
    return lambda wh: filters(wh).apply(wh.fct_daily, "activity_date").select("user_id", "activity_date", "steps", "calories")


register("filter_users", _slice(lambda wh: Filters(_IDS)), _slice_sql(f"user_id IN {_IDS}"), "F1")
register("filter_no_users", _slice(lambda wh: Filters(())), _slice_sql("FALSE"), "F1, nothing chosen")
register("filter_dates", _slice(lambda wh: Filters(start=_FROM, end=_TO)),
         _slice_sql(f"activity_date >= DATE '{_FROM}' AND activity_date <= DATE '{_TO}'"), "F2")
register("filter_combined", _slice(lambda wh: Filters(_IDS, _FROM, _TO)),
         _slice_sql(f"user_id IN {_IDS} AND activity_date >= DATE '{_FROM}' AND activity_date <= DATE '{_TO}'"), "F3")
register("filter_personas", _slice(lambda wh: persona_filter(P.by_tier(wh.dim_user), ["Regular", "Occasional"], wh.cfg)),
         _slice_sql(f"user_id IN (SELECT user_id FROM {_TIER} WHERE persona <> 'Committed')"), "F5, chosen personas over the study")
register("filter_all_personas", _slice(lambda wh: persona_filter(P.by_tier(wh.dim_user), None, wh.cfg, end=_TO)),
         _slice_sql(f"user_id IN (SELECT user_id FROM {_TIER}) AND activity_date <= DATE '{_TO}'"), "F5, all personas")

# ---------------------------------------------------------------- sources (§2.1)
def _width_sql(table: str) -> str:
    """Number of columns, from one row unpivoted."""
    return f"(SELECT count(*) FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {table}) ON COLUMNS(*)))"


def _sizes_sql(tables: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS rows, CAST({_width_sql(t)} AS INTEGER) AS columns"
                              for t in tables)


_DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
                  "conversations").split()
register("folder_profile", lambda wh: S.folder_profile(wh.spark, wh.sf_dir), _sizes_sql(_DRIVER_TABLES), "S3 folder scan")
register("table_catalog", lambda wh: S.table_catalog({n: wh.table(n) for n in MART_NAMES}), _sizes_sql(MART_NAMES), "S14", once=("packed_minutes", "fct_daily", "fct_sleep_sessions", "fct_sleep", "fct_heartrate_daily"))
_TYPES = "CASE typeof({0}) WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(typeof({0})) END"
register("column_catalog", lambda wh: S.column_catalog({n: wh.table(n) for n in MART_NAMES}), " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, c.column_name, k.data_type, c.filled
    FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE filled) c
    JOIN (UNPIVOT (SELECT {_TYPES.format('any_value(COLUMNS(*))')} FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE data_type) k
    USING (column_name)""" for t in MART_NAMES), "S15", once=("packed_minutes", "fct_daily", "fct_sleep_sessions", "fct_sleep", "fct_heartrate_daily", "dim_user"))
register("preview", lambda wh: S.preview(wh.fct_daily, ["user_id", "activity_date"], 50),
         "SELECT * FROM fct_daily ORDER BY user_id, activity_date LIMIT 50", "S13")

# ---------------------------------------------------------------- layers as queries (§2.2, §2.3, M3)
from strideframe.operators import marts as M  # noqa: E402

for _name, _get, _doc in [
        ("stg_daily_activity", lambda wh: wh.staged.daily_activity, "G1"),
        ("stg_daily_steps", lambda wh: wh.staged.daily_steps, "G2"),
        ("stg_daily_calories", lambda wh: wh.staged.daily_calories, "G3"),
        ("stg_sleep_day", lambda wh: wh.staged.sleep_day, "G4"),
        ("stg_minute_sleep", lambda wh: wh.staged.minute_sleep, "G5"),
        ("stg_hourly", lambda wh: wh.staged.hourly, "G6 three-way join on text keys"),
        ("stg_heartrate", lambda wh: wh.staged.heartrate, "G7"),
        ("stg_weight", lambda wh: wh.staged.weight, "G8"),
        ("cln_daily_activity", lambda wh: wh.cleaned.daily, "C1-C4 R5 + wear flag"),
        ("cln_sleep_day", lambda wh: wh.cleaned.sleep_day, "C5 R1 + R5"),
        ("cln_minute_sleep", lambda wh: wh.cleaned.minute_sleep, "C6 R1"),
        ("cln_hourly", lambda wh: wh.cleaned.hourly, "C7 R5"),
        ("cln_heartrate", lambda wh: wh.cleaned.heartrate, "C8 R3 + R5")]:
    register(_name, _get, f"SELECT * FROM {_name}", _doc)
register("main_session", lambda wh: M.main_sessions(wh.fct_sleep_sessions),
         "SELECT * FROM main_session", "M3 / W1 longest session per night")
register("percentile_rank", V.percentile_rank, " UNION ALL ".join(
    f"""SELECT user_id, '{m}' AS metric, 100.0 * coalesce(le, 0) / n_all AS pct FROM
        (SELECT user_id, {m}, count({m}) OVER (ORDER BY {m} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le
         FROM dim_user WHERE valid_days > 0) u,
        (SELECT count(*) AS n_all FROM dim_user WHERE valid_days > 0) t"""
    .replace("coalesce(le, 0)", f"CASE WHEN {m} IS NULL THEN 0 ELSE le END") for m in V.PERCENTILE_METRICS), "V28", once=("dim_user",))
register("curve_minmax", V.curve_minmax, """SELECT hour_of_day, (avg_steps - lo) / (hi - lo + 1e-9) AS scaled FROM
    (SELECT hour_of_day, avg(steps) AS avg_steps FROM fct_hourly GROUP BY 1) c,
    (SELECT min(avg_steps) AS lo, max(avg_steps) AS hi FROM (SELECT hour_of_day, avg(steps) AS avg_steps
     FROM fct_hourly GROUP BY 1)) m""", "X20")
