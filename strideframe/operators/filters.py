"""Dashboard filters (F1-F5) as Column / DataFrame operations instead of SQL text.

A user selection is either a small explicit id tuple (``isin``; empty -> no rows) or a
DataFrame of ids (persona membership), applied as a left-semi join so that a large id set
is never inlined into the plan or collected to the driver.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.config import StudyConfig


@dataclass(frozen=True)
class Filters:
    users: tuple[int, ...] | DataFrame | None = None   # None = no user restriction
    start: date | None = None
    end: date | None = None

    def users_col(self, col: str = "user_id"):
        """F1 for explicit ids: ``col IN (...)``; an empty selection matches nothing."""
        if self.users is None:
            return F.lit(True)
        if isinstance(self.users, DataFrame):
            raise TypeError("DataFrame selections are applied with apply(), as a semi join")
        return F.col(col).isin(list(self.users)) if self.users else F.lit(False)

    def dates_col(self, col: str):
        """inclusive date range on CAST(col AS DATE)."""
        c = F.col(col).cast("date")
        cond = F.lit(True)
        if self.start is not None:
            cond = cond & (c >= F.lit(self.start))
        if self.end is not None:
            cond = cond & (c <= F.lit(self.end))
        return cond

    def apply(self, df: DataFrame, date_col: str | None = None, col: str = "user_id") -> DataFrame:
        """users AND dates."""
        if date_col:
            df = df.filter(self.dates_col(date_col))
        if isinstance(self.users, DataFrame):
            ids = self.users.select(F.col("user_id").alias(col)).distinct()
            return df.join(ids, col, "left_semi")
        return df.filter(self.users_col(col))


def persona_members(personas: DataFrame) -> DataFrame:
    """persona membership as (persona, user_id, members) rows.

    The dashboard keeps one id list per persona; a persona can hold a large share of all users,
    so the list is kept as rows (one per member, with the persona size) rather than one array.
    """
    sizes = personas.groupBy("persona").agg(F.count(F.lit(1)).alias("members"))   # k rows
    return personas.select("persona", "user_id").join(F.broadcast(sizes), "persona")


def persona_filter(personas: DataFrame, chosen: list[str] | None, cfg: StudyConfig,
                   start: date | None = None, end: date | None = None) -> Filters:
    """chosen personas (None = all) -> semi-join id set; default range = the study days."""
    sel = personas if chosen is None else personas.filter(F.col("persona").isin(chosen))
    return Filters(sel.select("user_id"), start or cfg.study_start, end or cfg.last_full_day)


def default_slice(wh) -> Filters:
    """The default selection of the dashboard: every clustered user (all personas chosen = users with
    at least one valid day) over the whole study."""
    users = wh.dim_user.filter(F.col("valid_days") > 0).select("user_id")
    return Filters(users, wh.cfg.study_start, wh.cfg.last_full_day)


def default_slice_sql(cfg: StudyConfig, date_col: str | None, col: str = "user_id") -> str:
    parts = [f"{col} IN (SELECT user_id FROM dim_user WHERE valid_days > 0)"]
    if date_col:
        parts.append(f"CAST({date_col} AS DATE) BETWEEN DATE '{cfg.study_start.isoformat()}' "
                     f"AND DATE '{cfg.last_full_day.isoformat()}'")
    return " AND ".join(parts)
