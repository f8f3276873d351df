"""EDA profiling and chart-feeding aggregates (E1-E20), computed in Spark.

Per-table profiles are one aggregate per table unioned together; per-column profiles unpivot
(column, value) pairs with ``stack`` and aggregate once, instead of one job per column.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.functions.compat import rnd
from strideframe.functions.stats_exprs import scalars
from strideframe.operators.ranks import exact_quantiles, value_counts_cum
from strideframe.sources.landing import RawSources


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def profile_tables(raw: RawSources) -> DataFrame:
    """Rows, columns and distinct users per landing file."""
    return _union([df.agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("rows"),
                          F.lit(len(df.columns)).alias("columns"), F.count_distinct("Id").alias("users"))
                   for name, df in raw.items()])


def duplicate_count(raw: RawSources) -> DataFrame:
    """Exact duplicate rows per file = rows - distinct rows."""
    out = []
    for name, df in raw.items():
        total = df.agg(F.count(F.lit(1)).alias("rows"))
        distinct = df.distinct().agg(F.count(F.lit(1))).scalar()
        out.append(total.select(F.lit(name).alias("file"), (F.col("rows") - distinct).alias("duplicate_rows")))
    return _union(out)


def null_count(raw: RawSources) -> DataFrame:
    """NULL cells per (file, column), unpivoted; one aggregate per file."""
    out = []
    for name, df in raw.items():
        row = df.agg(F.count(F.lit(1)).alias("__rows"),
                     *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
        stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
        out.append(row.select(F.lit(name).alias("file"), "__rows",
                              F.expr(f"stack({len(df.columns)}, {stack}) AS (column, nulls)")))
    return _union(out).select("file", "column", F.col("__rows").alias("rows"), "nulls")


def null_top(raw: RawSources, top: int = 12) -> DataFrame:
    """% missing per column, the ``top`` largest (ties by file, column)."""
    n = null_count(raw)
    return (n.select("file", "column", (F.col("nulls") * F.lit(100.0) / F.col("rows")).alias("pct"))
            .orderBy(F.col("pct").desc(), "file", "column").limit(top))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E5: count, mean, sd, min, quartiles, max per numeric column (text cast to double).

    Quartiles are exact (distributed value counts), not the approximate ``summary()`` ones.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                         for c in cols])).alias("kv")).select("kv.column", "kv.x")
    base = long.groupBy("column").agg(F.count("x").alias("count"), rnd(F.avg("x"), 6).alias("mean"),
                                      rnd(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("min"),
                                      F.max("x").alias("max"))
    q = exact_quantiles(long, "x", [0.25, 0.5, 0.75], by=["column"])
    qp = (q.groupBy("column").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q"))
          .toDF("column", "q25", "q50", "q75"))
    return base.join(qp, "column", "left").select(
        "column", "count", "mean", "std", "min", rnd(F.col("q25"), 6).alias("q25"), rnd(F.col("q50"), 6).alias("q50"),
        rnd(F.col("q75"), 6).alias("q75"), "max")


def nunique(df: DataFrame, name: str) -> DataFrame:
    """Distinct non-null values per column — (column, value) pairs, one shuffle."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                                         for c in df.columns])).alias("kv")).select("kv.column", "kv.v")
    d = long.filter(F.col("v").isNotNull()).distinct()
    return d.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")).select(
        F.lit(name).alias("file"), "column", "distinct_values")


def crosstab(dim_user: DataFrame) -> DataFrame:
    """Step segment x engagement tier, both axes in fixed order, missing cells 0."""
    tiers = ["Occasional", "Regular", "Committed"]
    segs = ["Sedentary", "Low Active", "Somewhat Active", "Active"]
    spark = dim_user.sparkSession
    domain = spark.createDataFrame(list(enumerate(segs, 1)), "seg_order int, step_segment string")
    p = dim_user.groupBy("step_segment").pivot("engagement_tier", tiers).count()
    j = F.broadcast(domain).join(p, "step_segment", "left")
    return j.select("seg_order", "step_segment",
                    *[F.coalesce(F.col(t), F.lit(0).cast("long")).alias(t) for t in tiers]).orderBy("seg_order")


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """Share of rows at or below each distinct value."""
    c = value_counts_cum(df, col)
    return c.select(F.col("v").alias(col), "n", ((F.col("before") + F.col("n")) / F.col("total")).alias("ecdf"))


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme data inside the fences) and outlier count."""
    by = list(by)
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], by=by)
    qp = q.groupBy(*by).pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q")).toDF(*by, "q1", "median", "q3")
    d = df.filter(F.col(col).isNotNull())
    if by:
        # one quartile row per group, joined on the group keys (the planner sizes the join)
        j, keys = d.join(qp, by, "inner"), [*by, "q1", "median", "q3"]
        q1, med, q3 = F.col("q1"), F.col("median"), F.col("q3")
    else:
        # the single global row is read as scalar subqueries
        s = scalars(qp)
        j, keys = d, []
        q1, med, q3 = s["q1"], s["median"], s["q3"]
    iqr = q3 - q1
    lo_f, hi_f = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    x = F.col(col)
    agg = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(x >= lo_f, x)).alias("whisker_lo"), F.max(F.when(x <= hi_f, x)).alias("whisker_hi"),
        F.count_if((x < lo_f) | (x > hi_f)).alias("outliers"))
    return agg.select(*by, "n", rnd(q1, 6).alias("q1"), rnd(med, 6).alias("median"),
                      rnd(q3, 6).alias("q3"), "whisker_lo", "whisker_hi", "outliers")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between the column min and max (last bin closed)."""
    d = df.filter(F.col(col).isNotNull())
    mm = scalars(d.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")))
    lo, hi = mm["lo"], mm["hi"]
    w = (hi - lo) / F.lit(bins)
    b = F.least(F.floor(F.try_divide(F.col(col) - lo, w)), F.lit(bins - 1))
    g = d.select(F.coalesce(b, F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", rnd(lo + F.col("bin") * w, 6).alias("bin_start"),
                    rnd(lo + (F.col("bin") + 1) * w, 6).alias("bin_end"), "n").orderBy("bin")


def kde(df: DataFrame, col: str, grid: int = 200, by: str | None = None) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) at ``grid`` points between min and max, overall or
    for each value of ``by``.

    Equal values are counted first; every distinct value then adds its exact kernel to the grid points.
    The group's moments are joined to its distinct values: one row per group.
    """
    keys = [by] if by else []
    d = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("x"))
    values = d.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c"))
    moments = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                                   F.stddev_samp("x").alias("sd"))
    if by:
        v = values.join(moments, by)
    else:
        one = scalars(moments)
        v = values.select("x", "c", *[one[k].alias(k) for k in ("n", "lo", "hi", "sd")])
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    pts = v.select(*keys, "x", "c", "n", "lo", "hi", h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    at = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / F.lit(grid - 1)
    u = F.try_divide(at - F.col("x"), F.col("h"))
    dens = F.try_divide(F.col("c") * F.exp(-0.5 * u * u), F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return pts.groupBy(*keys, "i").agg(rnd(F.min(at), 6).alias("x"), rnd(F.sum(dens), 9).alias("density")).orderBy(*keys, "i")


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 28) -> DataFrame:
    """Hexagonal binning on two offset lattices (nearest centre), counts per cell."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    nx = gridsize
    ny = int(nx / math.sqrt(3))
    ext = d.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    pad_x = (F.col("x1") - F.col("x0")) * 1e-9
    pad_y = (F.col("y1") - F.col("y0")) * 1e-9
    e = scalars(ext.select((F.col("x0") - pad_x).alias("xmin"), (F.col("x1") + pad_x).alias("xmax"),
                           (F.col("y0") - pad_y).alias("ymin"), (F.col("y1") + pad_y).alias("ymax")))
    xmin, ymin = e["xmin"], e["ymin"]
    sx = (e["xmax"] - xmin) / nx
    sy = (e["ymax"] - ymin) / ny
    j = d.select(F.try_divide(F.col("x") - xmin, sx).alias("ix"), F.try_divide(F.col("y") - ymin, sy).alias("iy"))
    j = j.fillna(0.0, subset=["ix", "iy"])
    ix1, iy1 = F.rint("ix"), F.rint("iy")
    ix2, iy2 = F.floor("ix"), F.floor("iy")
    a1, b1 = F.col("ix") - ix1, F.col("iy") - iy1
    a2, b2 = F.col("ix") - ix2 - 0.5, F.col("iy") - iy2 - 0.5
    d1 = a1 * a1 + 3.0 * (b1 * b1)
    d2 = a2 * a2 + 3.0 * (b2 * b2)
    first = d1 < d2
    cell = j.select(first.alias("lattice1"),
                    F.when(first, ix1).otherwise(ix2).cast("int").alias("i"),
                    F.when(first, iy1).otherwise(iy2).cast("int").alias("j"))
    g = cell.groupBy("lattice1", "i", "j").agg(F.count(F.lit(1)).alias("n"))
    off = F.when(F.col("lattice1"), F.lit(0.0)).otherwise(F.lit(0.5))
    return g.select("lattice1", "i", "j",
                    rnd(xmin + (F.col("i") + off) * sx, 6).alias("cx"),
                    rnd(ymin + (F.col("j") + off) * sy, 6).alias("cy"), "n")


def median_mean(df: DataFrame, col: str) -> DataFrame:
    """Exact median and mean reference lines."""
    q = exact_quantiles(df, col, [0.5]).select(rnd(F.col("q"), 6).alias("median"))
    return q.select("median", df.agg(rnd(F.avg(col), 6)).scalar().alias("mean"))


def weekend_pivot(fct_hourly: DataFrame) -> DataFrame:
    """Hour x weekend unstack with the two pivot values given."""
    p = fct_hourly.groupBy("hour_of_day").pivot("is_weekend", [False, True]).agg(F.avg("steps"))
    return p.toDF("hour_of_day", "weekday", "weekend").orderBy("hour_of_day")


def feature_share(dim_user: DataFrame) -> DataFrame:
    """Users per feature and % of all users."""
    row = dim_user.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sleep_nights") > 0).alias("s"),
                       F.count_if(F.col("hr_days") > 0).alias("h"), F.count_if(F.col("weight_logs") > 0).alias("w"))
    s = row.select("n", F.expr("stack(4, 'Activity', n, 'Sleep', s, 'Heart rate', h, 'Weight', w) AS (feature, users)"))
    return s.select("feature", "users", rnd(F.col("users") * F.lit(100.0) / F.col("n"), 1).alias("pct_users"))
