"""Distributed ranks and exact quantiles (W4) without a global sort window.

Pipeline for a column ``v`` (optionally within groups ``by``):

1. value counts  ``(by, v) -> n``  (map-side partial aggregation; a hot value is one row).
2. a bucket per distinct value from ``percentile_approx`` cut points of its group (without groups a
   one-row aggregate read as a scalar subquery, else one row per group, joined).  The bucket is a deterministic
   function of the value, so it is monotone in ``v``; there are as many as shuffle partitions.
3. running counts inside each (by, bucket) window partition, bucket totals with a running
   offset over the small (by, bucket) table, joined back.

``before`` = number of rows with a smaller value; mid-rank = before + (n + 1) / 2.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts_cum(df: DataFrame, col: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(by..., v, n, before, total) for every distinct non-null value."""
    by = list(by)
    buckets = max(2, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = F.col(col)
    vc = df.filter(v.isNotNull()).groupBy(*by, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    probs = [i / buckets for i in range(1, buckets)]
    points = F.percentile_approx("v", F.array(*[F.lit(p) for p in probs]), max(10_000, 10 * buckets))
    if by:
        vc, cuts = vc.join(vc.groupBy(*by).agg(points.alias("cuts")), by), F.col("cuts")
    else:
        cuts = vc.agg(points).scalar()
    # bucket = number of cut points below v = 0-based position of v's first copy among cuts + [v]
    # (sort_array, not a lambda: subqueries cannot appear inside higher-order functions)
    with_v = F.sort_array(F.concat(cuts, F.array(F.col("v").cast(vc.schema["v"].dataType))))
    b = vc.withColumn("bucket", (F.array_position(with_v, F.col("v")) - F.lit(1)).cast("int"))
    inner = Window.partitionBy(*by, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0).cast("long")))
    tot = b.groupBy(*by, "bucket").agg(F.sum("n").alias("bn"))
    off_w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    all_w = Window.partitionBy(*by)
    tot = tot.select(*by, "bucket", F.coalesce(F.sum("bn").over(off_w), F.lit(0).cast("long")).alias("offset"),
                     F.sum("bn").over(all_w).alias("total"))
    out = b.join(tot, [*by, "bucket"])
    return out.select(*by, "v", "n", (F.col("offset") + F.col("within")).alias("before"), "total")


def mid_ranks(df: DataFrame, col: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(by..., v, n, midrank) — tied values share the mean of their positions (1-based)."""
    c = value_counts_cum(df, col, by, buckets)
    return c.select(*by, "v", "n", (F.col("before") + (F.col("n") + F.lit(1)) / F.lit(2.0)).alias("midrank"),
                    "total")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    buckets: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles (position (N-1)p), exact, one row per (by..., p).

    Each distinct value row checks a small per-group target array (the 0-based positions it
    must cover), so there is no range join and no full sort.
    """
    by = list(by)
    c = value_counts_cum(df, col, by, buckets)
    targets = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(i).alias("pi")) for i, p in enumerate(probs)])
    c = c.withColumn("t", F.explode(targets))
    h = (F.col("total") - 1) * F.col("t.p")
    c = c.select(*by, "v", "n", "before", F.col("t.p").alias("p"), F.col("t.pi").alias("pi"),
                 F.floor(h).cast("long").alias("k_lo"), F.ceil(h).cast("long").alias("k_hi"),
                 (h - F.floor(h)).alias("frac"))
    def covering(k: str):
        return F.max(F.when((F.col(k) >= F.col("before")) & (F.col(k) < F.col("before") + F.col("n")), F.col("v")))

    # the values at both positions, from one aggregate
    q = c.groupBy(*by, "p", "pi").agg(covering("k_lo").alias("lo"), covering("k_hi").alias("hi"), F.max("frac").alias("frac"))
    return q.select(*by, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).alias("q"))
