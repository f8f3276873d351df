"""Steps that must not grow with the minutes, the readers of a table or the size of a file."""
import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strideframe.config import StudyConfig
from strideframe.functions import bootstrap
from strideframe.operators import cleaning
from strideframe.plans import catalog
from strideframe.plans.warehouse import Warehouse
from strideframe.sources import catalog as sources
from strideframe.sources.landing import derive_landing

SF = "/root/testdata/sf0.001"


def test_packed_minutes_are_the_distinct_rows(spark):
    """Copies, other seconds, the hour's last minute, equal minutes in other states and logs, nulls in every column."""
    t = dt.datetime(2016, 4, 12, 23, 58, 30)
    rows = [(u, t + dt.timedelta(minutes=m), s, g) for u in (1, 2) for m in range(125) for s, g in ((1, 7), (m % 3, 8))]
    rows += rows[:50] + [rows[0]] * 9 + [(1, t.replace(second=31), 1, 7), (1, None, 1, 7), (1, None, 1, 7), (None, t, 1, 7), (1, t, None, 7), (1, t, 1, None)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, sleep_state int, log_id long").repartition(5)
    packed = cleaning.pack_minutes(df)
    assert packed.count() < len(set(rows)) / 10
    measured = cleaning.measure_minute_sleep(packed)
    assert sorted(map(str, map(tuple, measured.observed().collect()))) == sorted(map(str, set(rows)))
    assert tuple(measured.counted().first()) == (len(rows), len(set(rows)))
    assert tuple(cleaning.measure_minute_sleep(cleaning.pack_minutes(df.where("user_id > 9"))).counted().first()) == (0, 0)


def test_minute_texts_of_segments(spark):
    """Each segment's minutes in the export's text, over midnight and noon; a segment without a time keeps its rows."""
    at = dt.datetime
    given = [(0, at(2024, 1, 5, 23, 50, 7), 1, "purchase", 200.30), (1, at(2024, 1, 31, 11, 59, 59), 1, "view", 0.03),
             (2, at(2024, 12, 31, 23, 59), 1, "signup", 2.39), (3, None, 1, "click", 0.01)]
    ev = spark.createDataFrame([(*g, '{"k": 1}') for g in given], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    want = []
    for _, ts, user, kind, value in given:
        for i in range(1 + round(value * 100) % 240):
            m = ts and ts.replace(second=0) + dt.timedelta(minutes=i)
            text = m and f"{m.month}/{m.day}/{m.year} {m.hour % 12 or 12}:{m.minute:02d}:00 {'AM' if m.hour < 12 else 'PM'}"
            want.append((str(user), text, {"view": "1", "click": "1", "signup": "2"}.get(kind, "3")))
    got = derive_landing(ev, StudyConfig()).minute_sleep.select("Id", "date", "value").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["histogram_bedtime", "anova_bedtime", "box_sleep_window", "spearman_sit_sleep", "profile_by_tier"])
def test_tables_read_several_times_are_derived_once(spark, name):
    wh = Warehouse.from_driver(spark, SF)
    files = catalog.REGISTRY[name].build(wh).inputFiles()
    assert files and not any("events.parquet" in f for f in files)


@pytest.mark.parametrize("name", ["cluster_centres", "persona_minmax", "persona_zscore"])
def test_persona_plans_stay_small(spark, name):
    """Each reader of the personas planned the whole model again, and within it each mean all the features' moments."""
    df = catalog.REGISTRY[name].build(Warehouse.from_driver(spark, SF))
    assert len(df._jdf.queryExecution().analyzed().toString().splitlines()) < 400
    assert df.count() >= 1


def test_replicate_sums_are_the_sums_of_the_drawn_weights(spark):
    rows = [(u, d, None if u % 7 == 0 else "ab"[u % 2], u * 37 + d) for u in range(60) for d in (-3, 19800, 19801)] + [(None, 5, "a", 8), (4, None, "b", 9)]
    df = spark.createDataFrame(rows, "u long, d int, k string, v long").repartition(3)
    w = bootstrap.poisson(bootstrap.draw(F.col("u"), F.col("d"), F.col("b")))
    want = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(bootstrap.REPLICATES - 1))).alias("b")).withColumn("w", w).where("w > 0") \
        .groupBy("k", "b").agg(F.sum("w"), F.sum(F.col("w") * F.col("v"))).collect()
    got = bootstrap.replicate_sums(df, "u", "d", "k", ["v"]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) > 500
    assert bootstrap.replicate_sums(df.where("v < -9"), "u", "d", "k", ["v"]).count() == 0


def test_folder_scan_holds_no_file_whole(spark, tmp_path):
    """Files larger than a task may hold are read in splits; the damaged one of many is named."""
    table = pa.table({"a": list(range(20000)), "b": [f"text {i % 777} {i}" for i in range(20000)]})
    (tmp_path / "many.parquet").mkdir()
    for k in range(5):
        pq.write_table(table, tmp_path / "many.parquet" / f"part-{k}.parquet", row_group_size=5000)
    (tmp_path / "many.parquet" / "part-3.parquet").write_bytes(b"no parquet")
    pq.write_table(table, tmp_path / "one.parquet", row_group_size=5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        said = []
        found = sources.scan_folder(spark, str(tmp_path), said.append)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {n: df.count() for n, df in found.items()} == {"many": 80000, "one": 20000}
    assert len(said) == 1 and said[0].startswith("skipped part-3.parquet: ")
