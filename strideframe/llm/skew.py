"""Joins on keys of which a few may hold most rows."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(big: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``table`` on ``key``; the rows of a hot key are dealt by ``by`` to several tasks, each of which
    has the key's rows of ``table``.  ``counts`` (key, n) spares counting the keys of ``big``.

    A key is hot with over a quarter of an even share of rows, so there are at most four times as many hot keys
    as shuffle partitions, however large ``big`` is; only these are broadcast.  A null key joins nothing.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        counts = big.groupBy(key).agg(F.count("*").alias("n"))
    share = max((counts.agg(F.sum("n")).first()[0] or 0) // (4 * parts), 1000)
    hot = F.broadcast(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = big.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    copied = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
