"""Column helpers that reproduce the published semantics on Spark.

Every helper returns a Column expression, so it stays inside whole-stage codegen.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FMT = "M/d/yyyy"                 # '4/12/2016' and '04/12/2016' both parse
TS_FMT = "M/d/yyyy h:mm:ss a"         # 12-hour clock with AM/PM


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, digits: int = 0) -> Column:
    """Round half away from zero on the binary value: round(x * 10^k) / 10^k.

    Spark's ``round(x, k)`` rounds the shortest decimal text of x (1.005 -> 1.01); the
    published results round the binary value (1.005 -> 1.0).  Rounding at 0 digits agrees
    in both, so scale first.
    """
    x = _c(c).cast("double")
    if digits == 0:
        return F.round(x, 0)
    p = float(10 ** digits)
    return F.round(x * F.lit(p), 0) / F.lit(p)


def weekday_name(d) -> Column:
    """Full English day name ('Thursday')."""
    return F.date_format(_c(d), "EEEE")


def iso_dow(d) -> Column:
    """ISO day of week, 1 = Monday ... 7 = Sunday."""
    return (F.weekday(_c(d)) + F.lit(1)).cast("int")


def study_week(d, start) -> Column:
    """1 + whole weeks since the study start (integer division truncating toward zero)."""
    return (F.lit(1) + (F.datediff(_c(d), F.lit(start)) / F.lit(7)).cast("int")).cast("int")


def text_to_double(c) -> Column:
    return _c(c).cast("double")


def text_to_int(c) -> Column:
    """Integer text; '1.7' -> 2 (rounded, not an error), as the landing exports allow decimals."""
    return F.round(_c(c).cast("double"), 0).cast("int")


def text_to_long(c) -> Column:
    """Integer text to BIGINT, every digit kept; only text with a point takes the (exact) decimal way."""
    x = _c(c)
    return F.when(F.contains(x, F.lit(".")), F.round(x.cast("decimal(38,10)"), 0).cast("long")).otherwise(x.cast("long"))


def parse_date(c, fmt: str = DATE_FMT) -> Column:
    return F.to_date(_c(c), fmt)


def parse_ts(c, fmt: str = TS_FMT) -> Column:
    return F.to_timestamp_ntz(_c(c), F.lit(fmt))


def clock_hhmm(minutes) -> Column:
    """'HH:mm' for a count of minutes after midnight (wraps past 24 h)."""
    m = _c(minutes).cast("long")
    return F.format_string("%02d:%02d", F.pmod(F.floor(m / 60), F.lit(24)).cast("int"),
                           F.pmod(m, F.lit(60)).cast("int"))


def safe_div(a, b) -> Column:
    """a / b as double, NULL when b is 0 or NULL (the published engine gives inf / NaN)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def band(c, cuts: Sequence[tuple[float, str]], top: str, inclusive_last: bool = False) -> Column:
    """CASE WHEN c < cut1 THEN l1 WHEN c < cut2 ... ELSE top (NULL falls to ELSE)."""
    x = _c(c)
    expr = None
    for i, (cut, label) in enumerate(cuts):
        cond = (x <= cut) if (inclusive_last and i == len(cuts) - 1) else (x < cut)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(top)
