"""Cleaning rules R1-R6 (C1-C13) and the data-quality audit log.

Each rule is a flag or filter behind a *measured* frame: the typed rows with all that the rule needs, and the
audit's counts as aggregates over them.  A build observes these aggregates while it writes the cleaned table, so the
audit log costs no scan; without a build the same aggregates are one pass over each measured frame.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strideframe.config import AUDIT_STEPS, StudyConfig
from strideframe.operators.staging import Staged

KEEP, COPIES, MINUTES = "_keep", "_copies", "_minutes"


@dataclass
class Measured:
    """Rows before a rule, with the column KEEP where the rule drops some, and the audit's counts over them."""
    rows: DataFrame
    counts: dict[str, Column]
    columns: list[str] | None = None

    def observed(self, observation: Observation | None = None) -> DataFrame:
        """The rows that stay; their counts go to ``observation`` when they are written.  The counts are taken in the stage
        that writes, whose retried tasks count once."""
        rows = self.rows.observe(observation, *self._named()) if observation else self.rows
        kept = rows.filter(KEEP) if KEEP in rows.columns else rows
        return kept.select(*(self.columns or [c for c in rows.columns if c not in (KEEP, COPIES)]))

    def counted(self) -> DataFrame:
        """The counts as one row."""
        return self.rows.agg(*self._named())

    def _named(self) -> list[Column]:
        return [c.cast("long").alias(n) for n, c in self.counts.items()]


def _before_cut(c: Column, cfg: StudyConfig) -> Column:
    return c < F.lit(cfg.cutoff)


def _filtered(rows: DataFrame, keep: Column) -> Measured:
    return Measured(rows.withColumn(KEEP, F.coalesce(keep, F.lit(False))), {"before": F.count(F.lit(1)), "after": F.count_if(KEEP)})


def _without_copies(rows: DataFrame, keep: Column | None = None) -> Measured:
    """Each row once, with the number of its copies, so that rows before and after are counted in one grouping."""
    once = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias(COPIES))
    once = once if keep is None else once.withColumn(KEEP, F.coalesce(keep, F.lit(False)))
    return Measured(once, {"before": F.coalesce(F.sum(COPIES), F.lit(0)), "after": F.count(F.lit(1)) if keep is None else F.count_if(KEEP)})


def measure_daily(stg: DataFrame, cfg: StudyConfig) -> Measured:
    """R5 partial day removed, derived minute totals, R2 wear flag (flag, not delete)."""
    active = F.col("very_active_min") + F.col("fairly_active_min") + F.col("lightly_active_min")
    tracked = active + F.col("sedentary_min")
    flagged = stg.withColumns({"active_min": active, "tracked_min": tracked,
                               "is_valid_day": (F.col("steps") > 0) & (tracked >= F.lit(cfg.min_wear_min))})
    found = _filtered(flagged, _before_cut(F.col("activity_date"), cfg))
    found.counts["valid"] = F.count_if(F.col(KEEP) & F.col("is_valid_day"))
    return found


def measure_sleep_day(stg: DataFrame, cfg: StudyConfig) -> Measured:
    """R5 + R1: exact duplicate nights removed."""
    return _without_copies(stg, _before_cut(F.col("sleep_date"), cfg))


def pack_minutes(stg: DataFrame) -> DataFrame:
    """R1 for minute rows: (user_id, log_id, sleep_state, base, MINUTES, COPIES), one row for all minutes of an hour that
    agree in the other columns and in their seconds (``base`` is the time without its minutes).

    A minute is one bit of MINUTES, so copies vanish in a bitwise or, which is taken before the exchange: rows and
    aggregation buffers that travel are hours, not minutes.  Exact for any times; rows without a time keep one bit.
    """
    base = F.timestamp_add("MINUTE", -F.minute("ts"), F.col("ts"))
    return (stg.groupBy("user_id", "log_id", "sleep_state", base.alias("base"))
            .agg(F.bit_or(F.expr("shiftleft(1L, coalesce(minute(ts), 0))")).alias(MINUTES), F.count(F.lit(1)).alias(COPIES)))


def unpack_minutes(packed: DataFrame) -> DataFrame:
    """The distinct minutes of ``pack_minutes`` as rows again; the first one of each packed row carries its COPIES."""
    at, first = F.col("_at"), F.expr(f"bit_count({MINUTES} ^ ({MINUTES} - 1)) - 1")
    each = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("_at")).where(F.getbit(F.col(MINUTES), at) == 1)
    return each.select("user_id", F.timestamp_add("MINUTE", at, F.col("base")).alias("ts"), "sleep_state", "log_id",
                       F.when(at == first, F.col(COPIES)).otherwise(F.lit(0).cast("long")).alias(COPIES))


def measure_minute_sleep(packed: DataFrame) -> Measured:
    """Exact duplicate minutes removed (R5 is not applied to this table), from the packed minutes."""
    return Measured(unpack_minutes(packed), {"before": F.coalesce(F.sum(COPIES), F.lit(0)), "after": F.count(F.lit(1))})


def measure_hourly(stg: DataFrame, cfg: StudyConfig) -> Measured:
    return _filtered(stg, _before_cut(F.col("activity_hour").cast("date"), cfg))


def measure_heartrate(stg: DataFrame, cfg: StudyConfig) -> Measured:
    """R3 plausible range + R5."""
    return _filtered(stg, F.col("bpm").between(cfg.bpm_low, cfg.bpm_high) & _before_cut(F.col("ts").cast("date"), cfg))


def measure_weight(stg: DataFrame) -> Measured:
    """The mostly-empty fat column is dropped by projection."""
    return Measured(stg, {"before": F.count(F.lit(1)), "missing": F.count_if(F.col("fat_pct").isNull())},
                    ["user_id", "log_date", "weight_kg", "bmi", "is_manual"])


def measure_all(stg: Staged, cfg: StudyConfig, packed: DataFrame | None = None) -> dict[str, Measured]:
    """The measured frame behind each cleaned table; ``packed`` are the packed minutes if they are already there."""
    return {"daily": measure_daily(stg.daily_activity, cfg), "sleep_day": measure_sleep_day(stg.sleep_day, cfg),
            "minute_sleep": measure_minute_sleep(pack_minutes(stg.minute_sleep) if packed is None else packed), "hourly": measure_hourly(stg.hourly, cfg),
            "heartrate": measure_heartrate(stg.heartrate, cfg), "weight": measure_weight(stg.weight)}


# the measured table and its counts (rows before, rows after) of each audit step, in order
_STEP_COUNTS = [("daily", "before", "after"), ("daily", "after", "valid"), ("sleep_day", "before", "after"), ("minute_sleep", "before", "after"),
                ("hourly", "before", "after"), ("heartrate", "before", "after"), ("weight", "before", "before")]


def dq_log(counts: dict[str, DataFrame], cfg: StudyConfig) -> DataFrame:
    """Seven audit rows, one per rule application, from the one-row ``counts`` of each table."""
    out = None
    for name, frame in counts.items():
        rows = []
        for (step, rule, table, note), (source, before, after) in zip(AUDIT_STEPS, _STEP_COUNTS):
            if source != name:
                continue
            text = F.lit(note.replace("{cutoff}", cfg.cutoff.isoformat()))
            if "{missing}" in note:
                text = F.replace(F.replace(text, F.lit("{missing}"), F.col("missing").cast("string")), F.lit("{rows}"), F.col("before").cast("string"))
            rows.append(F.struct(F.lit(step).alias("step"), F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                                 F.col(before).alias("rows_before"), F.col(after).alias("rows_after"), text.alias("note")))
        log = frame.select(F.inline(F.array(*rows)))
        out = log if out is None else out.unionByName(log)
    return out


def observed_counts(spark: SparkSession, measured: dict[str, Measured], observations: dict[str, Observation]) -> dict[str, DataFrame]:
    """What was counted while the tables were written, one row each (S8: VALUES tables)."""
    return {name: spark.createDataFrame([tuple(int(observations[name].get[c]) for c in m.counts)], ", ".join(f"{c} long" for c in m.counts))
            for name, m in measured.items()}


def reconciliation(stg: Staged) -> DataFrame:
    """R6 (C12/C13): daily sub-files compared with dailyActivity on the common keys."""
    keys = ["user_id", "activity_date"]
    a = stg.daily_activity.select(*keys, "steps", "calories")
    s = (a.join(stg.daily_steps.withColumnRenamed("steps", "s_steps"), keys, "inner")
         .agg(F.lit("dailySteps vs dailyActivity").alias("check_name"),
              F.count(F.lit(1)).alias("rows_compared"),
              F.count_if(F.col("steps") != F.col("s_steps")).alias("mismatches")))
    c = (a.join(stg.daily_calories.withColumnRenamed("calories", "c_cal"), keys, "inner")
         .agg(F.lit("dailyCalories vs dailyActivity").alias("check_name"),
              F.count(F.lit(1)).alias("rows_compared"),
              F.count_if(F.col("calories") != F.col("c_cal")).alias("mismatches")))
    return s.unionByName(c)


@dataclass
class Cleaned:
    daily: DataFrame
    sleep_day: DataFrame
    minute_sleep: DataFrame
    hourly: DataFrame
    heartrate: DataFrame
    weight: DataFrame


def clean_all(measured: dict[str, Measured], observations: dict[str, Observation] | None = None) -> Cleaned:
    return Cleaned(**{name: m.observed(observations[name] if observations else None) for name, m in measured.items()})
