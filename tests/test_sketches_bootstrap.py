"""Sketches, bootstrap intervals, the point feed, damaged files."""
import datetime as dt
import types

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strideframe.functions import bootstrap
from strideframe.operators import personas, sketches, stats
from strideframe.sources import catalog

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(3)
    rows = [(u, DAY + dt.timedelta(days=int(d)), int(rng.normal(8000, 3000)) if rng.random() > 0.02 else None, int(rng.normal(2200, 300)), int(rng.normal(700, 90)),
             None, bool(rng.random() < 0.8), int(d) // 7 + 1, "a" if u % 3 else "b") for u in range(3000) for d in rng.choice(28, 5, replace=False)]
    rows = [(*r[:5], round(10 - r[4] / 200 + rng.normal(0, 1), 2), *r[6:]) for r in rows]
    return spark.createDataFrame(rows, "user_id long, activity_date date, steps int, calories int, sedentary_min int, hours_asleep double,"
                                       " is_valid_day boolean, study_week int, step_band string").repartition(5).cache()


def test_merged_users_are_near_the_distinct_ones(days):
    """Four standard errors of the HLL, for spans of one day to all."""
    per_day = sketches.sketch_daily(days).cache()
    for first, last in ((0, 0), (3, 9), (0, 27)):
        a, b = DAY + dt.timedelta(days=first), DAY + dt.timedelta(days=last)
        exact = days.where(F.col("activity_date").between(a, b)).agg(F.count_distinct("user_id"), F.count_distinct(F.when(F.col("is_valid_day"), F.col("user_id")))).first()
        assert tuple(sketches.users_between(per_day, a, b).first()) == pytest.approx(tuple(exact), rel=4 * 1.04 / 2 ** (sketches.LG_K / 2))
    assert {r.study_week for r in sketches.users_by_week(per_day).collect()} == {1, 2, 3, 4}
    assert tuple(sketches.users_between(per_day, DAY, DAY - dt.timedelta(days=1)).first()) == (0, 0)


def test_merged_quantiles_have_a_bounded_rank_error(days):
    values = np.sort([r.steps for r in days.where("is_valid_day AND steps IS NOT NULL").collect()])
    for r in sketches.quantiles(sketches.sketch_daily(days), "steps").collect():
        low, high = np.searchsorted(values, r.q, "left") / len(values), np.searchsorted(values, r.q, "right") / len(values)
        assert low - 0.012 <= r.p <= high + 0.012
    assert sketches.quantiles(sketches.sketch_daily(days.limit(0)), "steps").count() == 0


def test_heart_sketch(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 9), 60), (2, dt.datetime(2024, 1, 1, 10), 70), (1, dt.datetime(2024, 1, 2, 9), 90)], "user_id long, ts timestamp_ntz, bpm int")
    assert {r.p: r.q for r in sketches.quantiles(sketches.sketch_heart(df), "bpm", (0.1, 0.5, 0.9)).collect()} == {0.1: 60, 0.5: 70, 0.9: 90}


def test_draws_are_uniform_and_weights_poisson(spark):
    rows = spark.range(300).select(F.explode(F.sequence(F.lit(0), F.lit(199))).alias("b"), "id") \
        .select("b", "id", bootstrap.draw(F.col("id"), F.lit(19800), F.col("b")).alias("h")).withColumn("w", bootstrap.poisson(F.col("h"))).toPandas()
    assert rows.h.between(0, bootstrap.PRIME - 1).all()
    assert np.abs(np.histogram(rows.h / bootstrap.PRIME, 20, (0, 1))[0] / len(rows) - 0.05).max() < 0.005
    assert rows.w.mean() == pytest.approx(1, abs=0.02) and rows.w.var() == pytest.approx(1, abs=0.04)
    wide = rows.pivot(index="id", columns="b", values="w").to_numpy()
    corr = np.corrcoef(wide.T)
    assert np.abs(corr[np.triu_indices(200, 1)]).mean() < 0.07  # replicates aren't alike: 0.046 for independent ones


def test_bootstrap_intervals_are_near_the_closed_ones(days):
    """Within a fifth of the interval's width, for 200 replicates."""
    wh = types.SimpleNamespace(fct_daily=days, fct_daily_sleep=days)
    closed = {r.step_band: r for r in stats.mean_ci(wh).collect()}
    for r in stats.mean_ci_bootstrap(wh).collect():
        c = closed[r.step_band]
        assert (r.lo, r.hi) == pytest.approx((c.lo, c.hi), abs=0.2 * (c.hi - c.lo))
    closed = {r.i: r for r in stats.regression_ci(wh).collect()}
    band = stats.regression_ci_bootstrap(wh).collect()
    assert len(band) == 50
    for r in band:
        c = closed[r.i]
        assert (r.lo, r.hi) == pytest.approx((c.lo, c.hi), abs=0.25 * (c.hi - c.lo))


def test_bootstrap_of_nothing_and_constants(days):
    none = types.SimpleNamespace(fct_daily=days.limit(0), fct_daily_sleep=days.limit(0))
    assert stats.mean_ci_bootstrap(none).count() == 0 and stats.regression_ci_bootstrap(none).count() == 0
    flat = days.withColumn("calories", F.lit(5)).withColumn("sedentary_min", F.lit(9))
    assert {(r.lo, r.hi) for r in stats.mean_ci_bootstrap(types.SimpleNamespace(fct_daily=flat)).collect()} == {(5.0, 5.0)}
    assert stats.regression_ci_bootstrap(types.SimpleNamespace(fct_daily_sleep=flat)).count() == 0


def test_point_feed(spark, days):
    """The days with the smallest draws, the same from any partitioning; a small persona gives all it has."""
    people = spark.createDataFrame([(u, 0, "few" if u < 7 else "hot" if u < 2900 else "some") for u in range(3000)], "user_id long, cluster int, persona string")
    rows = days.join(people, "user_id").select("persona", "user_id", "activity_date", bootstrap.draw(F.col("user_id"), F.unix_date("activity_date"), F.lit(0)).alias("h")).collect()
    want = {p: {(r.user_id, r.activity_date) for r in sorted((r for r in rows if r.persona == p), key=lambda r: (r.h, r.user_id, r.activity_date))[:100]}
            for p in ("few", "hot", "some")}
    for parts in (1, 7):
        got = personas.points_by_persona(days.repartition(parts), people, 100, ["steps"]).collect()
        assert {p: {(r.user_id, r.activity_date) for r in got if r.persona == p} for p in want} == want
    assert len(want["few"]) == 35


def test_damaged_files_are_skipped_and_named(spark, tmp_path):
    """A broken footer, a broken page and an empty file; tables keep their readable files."""
    table = pa.table({"a": list(range(20000)), "b": [f"text {i % 777} {i}" for i in range(20000)]})
    (tmp_path / "parted.parquet").mkdir()
    for name in ("good.parquet", "page.parquet", "footer.parquet", "parted.parquet/part-0.parquet", "parted.parquet/part-1.parquet"):
        pq.write_table(table, tmp_path / name, row_group_size=5000)
    for name in ("page.parquet", "parted.parquet/part-1.parquet"):
        data = bytearray((tmp_path / name).read_bytes())
        data[len(data) // 2:len(data) // 2 + 400] = b"\xff" * 400
        (tmp_path / name).write_bytes(data)
    (tmp_path / "footer.parquet").write_bytes((tmp_path / "footer.parquet").read_bytes()[:-20])
    (tmp_path / "empty.parquet").write_bytes(b"")
    said = []
    found = catalog.scan_folder(spark, str(tmp_path), said.append)
    assert {n: df.count() for n, df in found.items()} == {"good": 20000, "parted": 20000}
    assert sorted(x.split(":")[0] for x in said) == ["skipped empty.parquet", "skipped footer.parquet", "skipped page.parquet", "skipped part-1.parquet"]
    assert sorted(tuple(r) for r in catalog.folder_profile(spark, str(tmp_path)).collect()) == [("good", 20000, 2), ("parted", 20000, 2)]
