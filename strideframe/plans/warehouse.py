"""The warehouse build: landing -> staging -> cleaning -> marts (-> personas).

``Warehouse`` exposes every layer as a lazily built DataFrame, so a single insight query is
one Catalyst plan from the scan up.  ``Warehouse.materialize(path)`` writes the marts once as
parquet (build aside, then switch, S11) and returns a warehouse that reads them back, which is
what the dashboard-style queries should run on at scale.
"""
from __future__ import annotations

import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from strideframe.config import StudyConfig
from strideframe.operators import cleaning, marts, personas, sketches, staging
from strideframe.session import written
from strideframe.sources.landing import RawSources

MART_NAMES = ["fct_daily", "fct_sleep_sessions", "fct_sleep", "fct_hourly", "fct_heartrate_hourly",
              "fct_heartrate_daily", "fct_daily_sleep", "dim_user", "cln_weight", "dq_log",
              "dq_reconciliation"]
# mergeable sketches per date
SKETCH_NAMES = ["sketch_daily", "sketch_heart"]
# the persona model's tables, fitted once per build
MODEL_NAMES = ["dim_user_persona", "model_elbow"]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(text.encode()))
    out.close()


def _point(spark: SparkSession, path: str, build_id: str) -> None:
    """Let ``path/CURRENT`` name the build: written beside, then renamed over the old one in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, current = (jvm.org.apache.hadoop.fs.Path(os.path.join(path, n)) for n in (f"CURRENT-{build_id}", "CURRENT"))
    _write_text(spark, os.path.join(path, f"CURRENT-{build_id}"), build_id)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    new = new.getFileSystem(conf).makeQualified(new)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, current, options)


class Warehouse:
    def __init__(self, spark: SparkSession, raw: RawSources | None, cfg: StudyConfig | None = None,
                 tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.raw = raw
        self.cfg = cfg or StudyConfig()
        self._tables = tables or {}

    sf_dir: str | None = None

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str, cfg: StudyConfig | None = None) -> "Warehouse":
        wh = cls(spark, RawSources.from_driver_tables(spark, sf_dir, cfg), cfg)
        wh.sf_dir = sf_dir
        return wh

    @classmethod
    def from_raw_folder(cls, spark: SparkSession, raw_dir: str, cfg: StudyConfig | None = None) -> "Warehouse":
        return cls(spark, RawSources.from_folder(spark, raw_dir), cfg)

    @classmethod
    def from_tables(cls, spark: SparkSession, path: str, cfg: StudyConfig | None = None) -> "Warehouse":
        names = MART_NAMES + [n for n in SKETCH_NAMES + MODEL_NAMES if _exists(spark, os.path.join(path, n))]
        layout = os.path.join(path, "BUCKETS")
        buckets = int(spark.read.text(layout).first()[0]) if _exists(spark, layout) else 0
        tables = {n: cls._bucketed_table(spark, path, n, buckets) if buckets and n in cls.BUCKETED else spark.read.parquet(os.path.join(path, n))
                  for n in names}
        return cls(spark, None, cfg, tables)

    @staticmethod
    def _table_name(path: str, name: str) -> str:
        return f"strideframe_{os.path.basename(path)}_{name}"

    @classmethod
    def _bucketed_table(cls, spark: SparkSession, path: str, name: str, buckets: int) -> DataFrame:
        """A bucketed table of a build, made known to the session's catalog if it isn't yet: files alone don't tell
        that they are bucketed."""
        table, loc, part = cls._table_name(path, name), os.path.join(path, name), cls.DATE_PARTITIONED.get(name)
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(loc).schema)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet " + f"PARTITIONED BY ({part}) " * bool(part)
                      + f"CLUSTERED BY (user_id) SORTED BY (user_id) INTO {buckets} BUCKETS LOCATION '{loc}'")
            if part:
                spark.catalog.recoverPartitions(table)
        return spark.table(table)

    def _t(self, name: str, build):
        if name in self._tables:
            return self._tables[name]
        return build()

    def once(self, *names: str) -> "Warehouse":
        """Write these tables to the shared checkpoint folder unless they are written already, in this order: later ones and
        all that is asked of this warehouse from here on read the files instead of deriving the tables again."""
        for name in names:
            if name not in self._tables:
                self._tables[name] = self.__dict__[name] = written(self.table(name), name)
        return self

    # ---- layers ---------------------------------------------------------------------------
    @cached_property
    def staged(self) -> staging.Staged:
        return staging.stage_all(self.raw)

    @cached_property
    def packed_minutes(self) -> DataFrame:
        """The minute sleep file without copies, an hour to a row."""
        return self._t("packed_minutes", lambda: cleaning.pack_minutes(self.staged.minute_sleep))

    @cached_property
    def measured(self) -> dict[str, cleaning.Measured]:
        return cleaning.measure_all(self.staged, self.cfg, self.packed_minutes)

    @cached_property
    def cleaned(self) -> cleaning.Cleaned:
        return cleaning.clean_all(self.measured)

    @cached_property
    def fct_daily(self) -> DataFrame:
        return self._t("fct_daily", lambda: marts.fct_daily(self.cleaned.daily, self.cfg))

    @cached_property
    def fct_sleep_sessions(self) -> DataFrame:
        return self._t("fct_sleep_sessions",
                       lambda: marts.fct_sleep_sessions(self.cleaned.minute_sleep, self.cfg))

    @cached_property
    def fct_sleep(self) -> DataFrame:
        return self._t("fct_sleep", lambda: marts.fct_sleep(self.cleaned.sleep_day, self.fct_sleep_sessions))

    @cached_property
    def fct_hourly(self) -> DataFrame:
        return self._t("fct_hourly", lambda: marts.fct_hourly(self.cleaned.hourly))

    @cached_property
    def fct_heartrate_hourly(self) -> DataFrame:
        return self._t("fct_heartrate_hourly", lambda: marts.fct_heartrate_hourly(self.cleaned.heartrate))

    @cached_property
    def fct_heartrate_daily(self) -> DataFrame:
        return self._t("fct_heartrate_daily",
                       lambda: marts.fct_heartrate_daily(self.cleaned.heartrate, self.cfg))

    @cached_property
    def fct_daily_sleep(self) -> DataFrame:
        return self._t("fct_daily_sleep", lambda: marts.fct_daily_sleep(self.fct_daily, self.fct_sleep))

    @cached_property
    def cln_weight(self) -> DataFrame:
        return self._t("cln_weight", lambda: self.cleaned.weight)

    @cached_property
    def dim_user(self) -> DataFrame:
        return self._t("dim_user", lambda: marts.dim_user(self.fct_daily, self.fct_sleep,
                                                           self.fct_heartrate_daily, self.cln_weight))

    @cached_property
    def dq_log(self) -> DataFrame:
        return self._t("dq_log", lambda: cleaning.dq_log({n: m.counted() for n, m in self.measured.items()}, self.cfg))

    @cached_property
    def dq_reconciliation(self) -> DataFrame:
        return self._t("dq_reconciliation", lambda: cleaning.reconciliation(self.staged))

    @cached_property
    def sketch_daily(self) -> DataFrame:
        return self._t("sketch_daily", lambda: sketches.sketch_daily(self.fct_daily))

    @cached_property
    def sketch_heart(self) -> DataFrame:
        return self._t("sketch_heart", lambda: sketches.sketch_heart(self.cleaned.heartrate))

    @cached_property
    def dim_user_persona(self) -> DataFrame:
        """K-Means personas (fits the model when first used)."""
        return self._t("dim_user_persona", lambda: personas.dim_user_persona(self.once("dim_user").dim_user, self.cfg, self.models))

    @cached_property
    def model_elbow(self) -> DataFrame:
        """Inertia for 1 to 8 clusters (fits the models when first used)."""
        return self._t("model_elbow", lambda: personas.elbow(self.dim_user, self.cfg, models=self.models))

    # fitted models to take both tables from; without them each table fits its own
    models: personas.Models | None = None

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    # ---- S5 / S11: build aside, then switch ------------------------------------------------
    # build order: every mart is written, then read back, before the marts that use it
    BUILD_ORDER = ["fct_daily", "fct_sleep_sessions", "fct_hourly", "fct_heartrate_hourly", "fct_heartrate_daily",
                   "cln_weight", "fct_sleep", "fct_daily_sleep", "dim_user", "dq_reconciliation", "dq_log", *SKETCH_NAMES, *MODEL_NAMES]
    BUILD_WAVES = [["fct_daily", "fct_sleep_sessions", "fct_hourly", "fct_heartrate_hourly", "fct_heartrate_daily",
                    "cln_weight", "dq_reconciliation", "dq_log", "sketch_heart"],
                   ["fct_sleep", "sketch_daily"],
                   ["fct_daily_sleep", "dim_user"],
                   MODEL_NAMES]
    BUILD_THREADS = 8
    DATE_PARTITIONED = {"fct_daily": "activity_date", "fct_hourly": "activity_date",
                        "fct_heartrate_hourly": "activity_date", "fct_heartrate_daily": "activity_date",
                        "fct_sleep": "sleep_date", "fct_daily_sleep": "activity_date"}

    # a user's rows lie in one sorted bucket, so that grouping and joining by user plans no exchange
    BUCKETED = {"fct_daily", "fct_sleep", "fct_heartrate_daily", "fct_daily_sleep", "cln_weight", "dim_user", "dim_user_persona"}

    def materialize(self, path: str, names: list[str] | None = None, force: bool = False,
                    models: bool = True) -> "Warehouse":
        """Write the cleaned layer, the marts and the persona model as parquet under ``path/<build-id>``.

        A current build is kept and returned unless ``force``.  A build of some tables only (``names``)
        is returned, but never becomes the current one while it lacks marts; one without ``models`` takes over the last fitted ones.

        The cleaned tables are written first and read back, which cuts the lineage (the
        exploded minute-level sleep table is computed once), and each mart is built from
        already-written inputs.  A failed build leaves only an orphan ``<build-id>`` folder;
        readers keep the previous build because the ``CURRENT`` pointer is written last.
        """
        if names is None and not force and _exists(self.spark, os.path.join(path, "CURRENT")):
            return Warehouse.current(self.spark, path, self.cfg)
        build_id = uuid.uuid4().hex[:12]
        base = os.path.join(path, build_id)
        spark = self.spark
        self.build_log: list[tuple[str, float]] = []

        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def write_read(name: str, df: DataFrame, part: str | None = None) -> DataFrame:
            if name in self.BUCKETED:
                t0 = time.perf_counter()
                w = df.repartition(buckets, "user_id").write.bucketBy(buckets, "user_id").sortBy("user_id").option("path", os.path.join(base, name))
                (w.partitionBy(part) if part else w).format("parquet").saveAsTable(self._table_name(base, name))
                self.build_log.append((name, round(time.perf_counter() - t0, 3)))
                return spark.table(self._table_name(base, name))
            w = df.write.mode("overwrite")
            if part:
                # one date's rows meet in one task (adaptive execution splits large dates): few files per date
                w = df.hint("rebalance", part).write.mode("overwrite").partitionBy(part)
            loc = os.path.join(base, name)
            t0 = time.perf_counter()
            w.parquet(loc)
            self.build_log.append((name, round(time.perf_counter() - t0, 3)))
            # the schema is known: reading it back needs no inference job
            schema = df.schema if not part else T.StructType(
                [f for f in df.schema.fields if f.name != part] + [df.schema[part]])
            return spark.read.schema(schema).parquet(loc)

        stage = Warehouse(spark, self.raw, self.cfg)
        # the audit's counts are taken by the writes themselves
        observations = {name: Observation(f"{name}-{build_id}") for name in self.measured}
        cleaned_parts = vars(cleaning.clean_all(self.measured, observations))
        # independent writes of one wave run as concurrent jobs (the scheduler interleaves their
        # tasks); each wave only reads tables written by earlier waves
        with ThreadPoolExecutor(max_workers=self.BUILD_THREADS) as pool:
            futs = {k: pool.submit(write_read, f"cleaned/{k}", df) for k, df in cleaned_parts.items()}
            stage.__dict__["cleaned"] = cleaning.Cleaned(**{k: f.result() for k, f in futs.items()})
            stage.__dict__["dq_log"] = cleaning.dq_log(cleaning.observed_counts(spark, self.measured, observations), self.cfg)
            wanted = set(names or MART_NAMES + SKETCH_NAMES + MODEL_NAMES * models)
            todo = [n for n in self.BUILD_ORDER if n in wanted or any(self._needs(m, n) for m in wanted)]
            for wave in self.BUILD_WAVES:
                batch = [n for n in wave if n in todo]
                if wave is MODEL_NAMES and batch:
                    stage.models = personas.fit_models(stage.dim_user, self.cfg, *(n in batch for n in MODEL_NAMES))
                frames = {n: stage.table(n) for n in batch}
                futs = {n: pool.submit(write_read, n, frames[n], self.DATE_PARTITIONED.get(n)) for n in batch}
                for n, f in futs.items():
                    stage.__dict__[n] = stage._tables[n] = f.result()
        written = {n: stage.__dict__[n] for n in MART_NAMES + SKETCH_NAMES + MODEL_NAMES if n in todo}
        if self.BUCKETED & set(written):
            _write_text(spark, os.path.join(base, "BUCKETS"), str(buckets))
        if set(MART_NAMES) <= set(written):
            if not models and _exists(spark, os.path.join(path, "CURRENT")):
                # the last fitted model stays with the current build
                old = Warehouse.current(spark, path, self.cfg)._tables
                written |= {n: write_read(n, old[n]) for n in MODEL_NAMES if n in old}
            _point(spark, path, build_id)
        return Warehouse(spark, None, self.cfg, written)

    @staticmethod
    def _needs(mart: str, dep: str) -> bool:
        deps = {"sketch_daily": {"fct_daily"}, "fct_sleep": {"fct_sleep_sessions"}, "fct_daily_sleep": {"fct_daily", "fct_sleep", "fct_sleep_sessions"},
                "dim_user": {"fct_daily", "fct_sleep", "fct_sleep_sessions", "fct_heartrate_daily", "cln_weight"}}
        deps |= {n: deps["dim_user"] | {"dim_user"} for n in MODEL_NAMES}
        return dep in deps.get(mart, set())

    @classmethod
    def current(cls, spark: SparkSession, path: str, cfg: StudyConfig | None = None) -> "Warehouse":
        build_id = spark.read.text(os.path.join(path, "CURRENT")).first()[0]
        return cls.from_tables(spark, os.path.join(path, build_id), cfg)
