"""Semantic traps T1-T17 of the published engine, re-created with Spark expressions."""
import datetime as dt

from pyspark.sql import functions as F

from strideframe.functions.compat import (clock_hhmm, iso_dow, parse_date, parse_ts, rnd, safe_div, study_week,
                                          text_to_int, weekday_name)
from strideframe.functions.stats_exprs import pearson


def one(spark, expr, data=None, schema="x double"):
    df = spark.createDataFrame(data or [(None,)], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_round_binary_half_away(spark):
    # T5: 1.005 -> 1.0, 0.285 -> 0.28, 2.675 -> 2.68, 0.125 -> 0.13, 2.5 -> 3, -2.5 -> -3
    data = [(1.005, 2), (0.285, 2), (2.675, 2), (0.125, 2), (2.5, 0), (-2.5, 0)]
    df = spark.createDataFrame(data, "x double, k int")
    out = [spark.createDataFrame([(r.x,)], "x double").select(rnd("x", r.k)).first()[0] for r in df.collect()]
    assert out == [1.0, 0.28, 2.68, 0.13, 3.0, -3.0]


def test_division_is_double_not_decimal(spark):
    # 1 / 60.0 must be the double 0.016666..., not DECIMAL 0.016667
    v = one(spark, F.lit(1) / F.lit(60.0))[0]
    assert isinstance(v, float) and abs(v - 1 / 60) < 1e-15


def test_weekday_names_and_iso(spark):
    d = dt.date(2016, 4, 14)  # a Thursday
    df = spark.createDataFrame([(d,), (dt.date(2016, 4, 17),)], "d date")
    rows = df.select(weekday_name("d"), iso_dow("d")).collect()
    assert rows[0][0] == "Thursday" and rows[0][1] == 4
    assert rows[1][0] == "Sunday" and rows[1][1] == 7   # T3: Sunday is 7


def test_study_week_truncates(spark):
    df = spark.createDataFrame([(dt.date(2016, 4, 12),), (dt.date(2016, 4, 18),), (dt.date(2016, 4, 19),),
                                (dt.date(2016, 4, 11),)], "d date")
    got = [r[0] for r in df.select(study_week("d", dt.date(2016, 4, 12))).collect()]
    assert got == [1, 1, 2, 1]   # T4: -1 // 7 truncates to 0 -> week 1


def test_text_int_rounds(spark):
    got = one(spark, text_to_int("s"), [("1.0",), ("1.7",), ("12",)], "s string")
    assert got == [1, 2, 12]    # T7


def test_twelve_hour_parse(spark):
    data = [("4/2/2016 1:05:00 PM",), ("04/12/2016 12:00:00 AM",), ("4/12/2016 12:00:00 PM",)]
    got = one(spark, parse_ts("s"), data, "s string")
    assert got == [dt.datetime(2016, 4, 2, 13, 5), dt.datetime(2016, 4, 12, 0, 0), dt.datetime(2016, 4, 12, 12, 0)]
    assert one(spark, parse_date("s"), [("4/2/2016",), ("12/31/2016",)], "s string") == \
        [dt.date(2016, 4, 2), dt.date(2016, 12, 31)]


def test_clock_and_safe_div(spark):
    assert one(spark, clock_hhmm(F.lit(1425))) == ["23:45"]
    assert one(spark, clock_hhmm(F.lit(1530))) == ["01:30"]     # wraps past midnight
    assert one(spark, safe_div(F.lit(5), F.lit(0))) == [None]   # T17: NULL instead of inf / error


def test_pearson_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(pearson("x", "y")).first()[0] is None        # T14
    one_row = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert one_row.agg(pearson("x", "y")).first()[0] is None


def test_ids_keep_every_digit(spark):
    """Integer text goes straight to BIGINT: ids above 2**53 stay apart; a decimal point takes the exact way."""
    from strideframe.functions.compat import text_to_long
    rows = ["9007199254740993", "9007199254740992", "-3", "12.0", "7.6", None]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    assert [r[0] for r in df.select(text_to_long("x")).collect()] == [9007199254740993, 9007199254740992, -3, 12, 8, None]


def test_correlation_and_trend_use_complete_pairs(spark):
    from types import SimpleNamespace

    from strideframe.functions.stats_exprs import pearson
    from strideframe.operators.slices import linear_trend
    from strideframe.operators.stats import pearson_test
    rows = [(1, 1, True), (2, 2, True), (3, 3, True), (10, None, True), (None, 40, True)]
    df = spark.createDataFrame(rows, "steps int, calories int, is_valid_day boolean")
    assert df.agg(pearson("steps", "calories")).first()[0] == 1.0
    assert pearson_test(df, "steps", "calories").first()["n"] == 3
    t = linear_trend(SimpleNamespace(fct_daily=df)).first()
    assert (t.n, t.slope, t.intercept, t.x_min, t.x_max) == (3, 1.0, 0.0, 1, 3)
    assert spark.createDataFrame([(1, 1), (1, 2)], "x int, y int").agg(pearson("x", "y")).first()[0] is None


def test_a_fourth_equal_name_is_numbered(spark):
    from strideframe.config import PERSONA_FEATURES
    from strideframe.operators.personas import name_personas
    cols = [*PERSONA_FEATURES, *(f"overall_{f}" for f in PERSONA_FEATURES)]
    rows = [(k, *[1.0] * len(cols)) for k in range(4)]
    names = name_personas(spark.createDataFrame(rows, ["cluster", *cols]))
    assert sorted(r.persona for r in names.collect()) == [f"Desk-Bound Sitters{s}" for s in ("", " 4", " II", " III")]


def test_csv_export_and_damaged_file(spark, tmp_path):
    from strideframe.sources.catalog import export_csv, scan_folder
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, t string")
    export_csv(df, str(tmp_path / "out"))
    assert {tuple(r) for r in spark.read.option("header", True).schema("n int, t string").csv(str(tmp_path / "out")).collect()} == {(1, "a,b"), (2, None)}
    df.write.parquet(str(tmp_path / "in" / "good.parquet"))
    (tmp_path / "in" / "bad.parquet").write_bytes(b"no parquet")
    said = []
    assert set(scan_folder(spark, str(tmp_path / "in"), said.append)) == {"good"} and "bad.parquet" in said[0]


def test_checkpoint_folder_rule(spark):
    from types import SimpleNamespace

    import pytest as pt

    from strideframe.session import ensure_checkpoint_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pt.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(cluster)
    cluster.sparkContext.getCheckpointDir = lambda: "hdfs:///shared/x"
    assert ensure_checkpoint_dir(cluster) == "hdfs:///shared/x"
