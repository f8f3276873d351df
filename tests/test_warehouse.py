"""Warehouse layers on hand-made fixtures: rules R1-R6, marts, audit log and the data checks."""
import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fixtures import raw_sources
from strideframe.config import StudyConfig
from strideframe.operators import checks, cleaning
from strideframe.plans.warehouse import Warehouse


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse(spark, raw_sources(spark), StudyConfig.reference_study())


def test_daily_rules(wh):
    d = {r.activity_date: r for r in wh.fct_daily.filter("user_id = 1001").collect()}
    assert dt.date(2016, 5, 12) not in d                      # R5
    assert not d[dt.date(2016, 4, 12)].is_valid_day             # steps 0
    assert not d[dt.date(2016, 4, 13)].is_valid_day             # 599 tracked minutes
    assert d[dt.date(2016, 4, 14)].is_valid_day and d[dt.date(2016, 4, 14)].tracked_min == 600
    bands = {k.day: v.step_band for k, v in d.items()}
    assert bands[13] == "1 Under 5k" and bands[14] == "2 5k-7.5k" and bands[15] == "2 5k-7.5k"
    assert bands[16] == "3 7.5k-10k" and bands[17] == "3 7.5k-10k" and bands[18] == "4 10k+"
    assert d[dt.date(2016, 4, 15)].met_30_min_mvpa and not d[dt.date(2016, 4, 14)].met_30_min_mvpa
    assert d[dt.date(2016, 4, 17)].weekday == "Sunday" and d[dt.date(2016, 4, 17)].weekday_num == 7
    assert d[dt.date(2016, 4, 17)].is_weekend and d[dt.date(2016, 4, 18)].study_week == 1
    assert d[dt.date(2016, 4, 19 - 1)].study_week == 1 and d[dt.date(2016, 5, 11)].study_week == 5


def test_audit_log(wh):
    log = {r.step: r for r in wh.dq_log.collect()}
    assert (log["01"].rows_before, log["01"].rows_after) == (10, 9)
    assert (log["02"].rows_before, log["02"].rows_after) == (9, 6)
    assert (log["03"].rows_before, log["03"].rows_after) == (9, 7)      # duplicate + partial day
    assert log["04"].rows_before - log["04"].rows_after == 1             # one duplicated minute
    assert (log["05"].rows_before, log["05"].rows_after) == (3, 2)       # 3-way join, then R5
    assert (log["06"].rows_before, log["06"].rows_after) == (10, 7)      # 29, 221 and 5/12 dropped
    assert log["07"].note == "2 of 3 Fat values were missing"
    # row conservation: removed = before - after, never negative
    assert all(r.rows_before >= r.rows_after for r in log.values())


def test_reconciliation(wh):
    rec = {r.check_name: r for r in wh.dq_reconciliation.collect()}
    s = rec["dailySteps vs dailyActivity"]
    assert (s.rows_compared, s.mismatches) == (3, 1)
    c = rec["dailyCalories vs dailyActivity"]
    assert (c.rows_compared, c.mismatches) == (2, 0)


def test_sleep_sessions_and_nights(wh):
    ses = {r.log_id: r for r in wh.fct_sleep_sessions.collect()}
    a = ses[1]
    assert a.minutes_in_bed == 61 and a.wake_date == dt.date(2016, 4, 13)
    assert a.bedtime_hour == pytest.approx(23.5) and a.wake_hour == pytest.approx(0.5)
    assert a.session_end == dt.datetime(2016, 4, 13, 0, 31)
    assert a.minutes_asleep + a.minutes_restless + a.minutes_awake == 61
    assert ses[2].bedtime_hour == pytest.approx(38 + 59 / 60)     # 2:59 PM counts as the next night
    assert ses[3].bedtime_hour == pytest.approx(15.0)
    nights = {r.sleep_date: r for r in wh.fct_sleep.collect()}
    assert len(nights) == 7
    assert nights[dt.date(2016, 4, 14)].bedtime_hour == pytest.approx(38 + 59 / 60)   # tie -> earlier start
    bands = {k.day: v.sleep_band for k, v in nights.items()}
    assert bands == {13: "Short (< 6 h)", 14: "Borderline (6-7 h)", 15: "Borderline (6-7 h)", 16: "Healthy (7-9 h)",
                     17: "Healthy (7-9 h)", 18: "Long (> 9 h)", 20: "Short (< 6 h)"}
    assert nights[dt.date(2016, 4, 20)].efficiency_pct is None
    assert nights[dt.date(2016, 4, 13)].hours_asleep == 5.98
    assert nights[dt.date(2016, 4, 13)].efficiency_pct == 89.8


def test_hourly_and_heart(wh):
    hours = sorted(r.hour_of_day for r in wh.fct_hourly.collect())
    assert hours == [0, 12]
    hr = {r.activity_date.day: r for r in wh.fct_heartrate_daily.collect()}
    assert hr[14].resting_bpm_est == 60.3 and hr[13].resting_bpm_est == 75.0
    assert hr[12].resting_bpm_est == 39.5 and hr[12].readings == 2
    assert {r.activity_date.month for r in wh.fct_heartrate_daily.collect()} == {4}


def test_dim_user(wh):
    u = {r.user_id: r for r in wh.dim_user.collect()}
    assert set(u) == {1001, 1002}
    assert u[1002].valid_days == 0 and u[1002].avg_steps is None
    assert u[1002].step_segment == "Active"      # T15: NULL average falls to ELSE
    assert u[1002].engagement_tier == "Occasional" and u[1002].features_used == 1
    assert u[1001].valid_days == 6 and u[1001].sleep_nights == 7 and u[1001].weight_logs == 2
    assert u[1001].features_used == 3
    assert u[1001].avg_steps == round((5000 + 7499 + 7500 + 9999 + 10000 + 4999) / 6)


def test_checks(wh):
    res = {r.check_name: r for r in checks.all_checks(wh).collect()}
    assert res["valid_days_follow_wear_rule"].failing == 0
    assert res["no_duplicate_nights"].failing == 0
    assert res["partial_day_removed"].failing == 0 and res["partial_day_removed"].detail == "2016-05-11"
    assert res["hours_in_range"].failing == 0
    assert res["daily_subfiles_reconcile"].failing == 1


def test_same_night_other_values_is_caught(spark, wh):
    rows = wh.fct_sleep.select("user_id", "sleep_date")
    dup = rows.unionByName(rows.limit(1))
    n = dup.agg(F.count(F.lit(1)) - F.count_distinct(F.struct("user_id", "sleep_date"))).first()[0]
    assert n == 1


def test_materialize_and_switch(wh, tmp_path):
    path = str(tmp_path / "wh")
    built = wh.materialize(path, models=False)      # two users are too few for the persona model
    assert built.fct_daily.count() == wh.fct_daily.count()
    again = Warehouse.current(wh.spark, path, wh.cfg)
    assert sorted(again.dim_user.columns) == sorted(wh.dim_user.columns)

    def pointer():
        return (tmp_path / "wh" / "CURRENT").read_text()

    first = pointer()
    assert wh.materialize(path).fct_sleep.count() == wh.fct_sleep.count() and pointer() == first   # kept
    some = wh.materialize(path, names=["fct_daily"])
    assert some.fct_daily.count() == wh.fct_daily.count() and pointer() == first   # a part never becomes current
    wh.materialize(path, force=True, models=False)
    assert pointer() != first
    assert Warehouse.current(wh.spark, path, wh.cfg).dim_user.count() == 2


def test_model_tables_are_stored(spark, tmp_path):
    lazy = Warehouse.from_driver(spark, "/root/testdata/sf0.001")
    built = Warehouse.current(spark, lazy.materialize(str(tmp_path / "wh")) and str(tmp_path / "wh"))
    personas = built.dim_user_persona
    assert "KMeans" not in personas._jdf.queryExecution().toString()
    assert personas.count() == personas.select("user_id").distinct().count() > 0
    elbow = [r.inertia for r in built.model_elbow.orderBy("k").collect()]
    assert len(elbow) == 8 and elbow == sorted(elbow, reverse=True)


def test_elbow_needs_enough_users(wh):
    from strideframe.operators.personas import elbow
    with pytest.raises(ValueError, match="clusters"):
        elbow(wh.dim_user, wh.cfg)


def test_landing_folder_roundtrip(spark, tmp_path):
    """Landing parquet files are read with an all-text schema; a missing input fails fast."""
    from strideframe.sources.landing import RawSources
    raw = raw_sources(spark)
    folder = str(tmp_path / "raw")
    for name, df in raw.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    again = RawSources.from_folder(spark, folder)
    assert all(t.simpleString() == "string" for _, df in again.items() for t in [f.dataType for f in df.schema])
    wh2 = Warehouse(spark, again, StudyConfig.reference_study())
    assert wh2.fct_daily.count() == 9 and wh2.dim_user.count() == 2
    with pytest.raises(FileNotFoundError, match="sleepDay"):
        RawSources.from_folder(spark, str(tmp_path / "empty"))


def test_audit_is_taken_while_writing(wh, tmp_path):
    """The built audit log equals the counted one and reads no table."""
    counted = sorted(map(tuple, wh.dq_log.collect()))
    measured, observations = wh.measured, {n: Observation(n) for n in wh.measured}
    for name, df in vars(cleaning.clean_all(measured, observations)).items():
        df.write.parquet(str(tmp_path / name))
    log = cleaning.dq_log(cleaning.observed_counts(wh.spark, measured, observations), wh.cfg)
    assert sorted(map(tuple, log.collect())) == counted and len(counted) == 7
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Exchange" not in plan
    built = wh.materialize(str(tmp_path / "wh"), models=False)
    assert sorted(map(tuple, built.dq_log.collect())) == counted


def test_audit_counts_of_copies_and_empty_tables(spark):
    rows = [(1, 5)] * 4 + [(1, 6), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "user_id long, minute long").repartition(3)
    m = cleaning._without_copies(df, F.col("minute") < 6)
    assert tuple(m.counted().first()) == (7, 1) and [tuple(r) for r in m.observed().collect()] == [(1, 5)]
    assert tuple(cleaning._without_copies(df).counted().first()) == (7, 3)
    assert tuple(cleaning._without_copies(df.limit(0)).counted().first()) == (0, 0)


def test_last_models_stay_with_a_build_without(spark, tmp_path):
    lazy, path = Warehouse.from_driver(spark, "/root/testdata/sf0.001", StudyConfig(persona_n_init=2, elbow_n_init=1)), str(tmp_path / "wh")
    first = sorted(map(tuple, lazy.materialize(path).dim_user_persona.collect()))
    lazy.materialize(path, force=True, models=False)
    again = Warehouse.current(spark, path)
    assert "dim_user_persona" in again._tables and sorted(map(tuple, again.dim_user_persona.collect())) == first


def test_user_dimension_from_buckets_plans_no_exchange(spark, tmp_path):
    """In the session that built and in one that reads the build's files; slices by date still read their date alone."""
    from strideframe.operators import marts
    lazy, path = Warehouse.from_driver(spark, "/root/testdata/sf0.001", StudyConfig(persona_n_init=1, elbow_n_init=1)), str(tmp_path / "wh")
    built = lazy.materialize(path)
    build_id = (tmp_path / "wh" / "CURRENT").read_text()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for again in (False, True):
            if again:
                for name in Warehouse.BUCKETED:
                    spark.sql(f"DROP TABLE {Warehouse._table_name(build_id, name)}")  # as in a new session
                built = Warehouse.current(spark, path, lazy.cfg)
            plan = marts.dim_user(built.fct_daily, built.fct_sleep, built.fct_heartrate_daily, built.cln_weight)
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
            joined = built.dim_user.join(built.dim_user_persona, "user_id")
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
            day = built.fct_daily.where("activity_date = DATE'2024-01-05'")._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(activity_date" in day
            assert sorted(map(str, plan.collect())) == sorted(map(str, lazy.dim_user.select(*plan.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
