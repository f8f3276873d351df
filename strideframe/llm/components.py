"""Connected components by alternating large and small stars, each round written to shared storage."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import stage


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u > v, both long) as (u, root): each node that isn't the smallest of its component with the
    smallest.  A round sends every node's larger neighbours to its smallest one, then its smaller ones;
    there are few rounds (logarithmic in practice).  A node's neighbours are only counted down to a minimum by
    partial aggregation, never gathered."""
    now = stage(edges.select("u", "v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.*").where("u > v").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.withColumnRenamed("v", "root")
