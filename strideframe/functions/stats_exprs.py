"""Aggregate expressions shared by insight, slice and statistics operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.functions.compat import rnd


def complete_pair(x, y) -> tuple[Column, Column]:
    """Both columns, NULL wherever either is: every moment is then taken over the same rows."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def pearson(x, y) -> Column:
    """Pearson r of the complete pairs; NULL (not an error) for a constant column or one row.  ``corr`` itself is an
    error there under ANSI rules, so it is divided by hand, from aggregates that leave out incomplete pairs themselves."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def pearson_rounded(x, y, digits: int) -> Column:
    """Round to 6 digits first, so last-bit differences of the moment algorithm cannot flip a digit."""
    return rnd(rnd(pearson(x, y), 6), digits)


def avg_of_rounded(c, digits: int) -> Column:
    """Mean of a column already rounded to ``digits``: summed as exact integers, divided once."""
    col = F.col(c) if isinstance(c, str) else c
    p = 10 ** digits
    return F.sum(F.round(col * F.lit(p))) / F.count(col) / F.lit(p)


def pct(cond) -> Column:
    """100 * share of rows where cond holds (NULL counts as false, as ::INT of NULL is NULL → skipped)."""
    return F.lit(100) * F.avg(cond.cast("int"))


def scalars(one_row: DataFrame) -> dict[str, Column]:
    """The columns of a one-row (global) aggregate as scalar subqueries.

    They are used in place of a join: no cross product is planned, and Catalyst merges the
    scalar subqueries over the same aggregate into one execution.
    """
    return {c: one_row.select(c).scalar() for c in one_row.columns}
