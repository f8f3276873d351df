"""Reproducible draws from row keys: Poisson bootstrap weights and hash samples that any engine can recompute.

A draw is whole-number arithmetic on two row keys and a replicate number modulo the prime 2**31 - 1, with a
squaring between two multiplications; products stay below 2**63.  It depends on the row alone, not on partitions.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = (1 << 31) - 1
#: Replicates of a bootstrap interval.
REPLICATES = 200


def _steps(a, b, replicate, remainder):
    x = remainder(remainder(a) * 48271 + remainder(b) * 69621 + replicate * 16807 + 12345)
    x = remainder(x * x + replicate * 40692 + 7)
    return remainder(x * 630360016 + x)


def draw(a: Column, b: Column, replicate: Column) -> Column:
    """A number from 0 to PRIME - 1 for a row's two keys (whole numbers) and a replicate."""
    whole = [F.coalesce(c.cast("long"), F.lit(0).cast("long")) for c in (a, b, replicate)]
    return _steps(*whole, lambda x: F.pmod(x, F.lit(PRIME).cast("long")))


class _Sql(str):
    """SQL text that adds and multiplies like a column."""

    def __add__(self, other):
        return _Sql(f"({str(self)} + {other})")

    def __mul__(self, other):
        return _Sql(f"({str(self)} * {other})")


def draw_sql(a: str, b: str, replicate: str) -> str:
    """The same as SQL."""
    def remainder(x: str) -> _Sql:
        return _Sql(f"((({x}) % {PRIME} + {PRIME}) % {PRIME})")

    return str(_steps(*(_Sql(f"coalesce(CAST({c} AS BIGINT), 0)") for c in (a, b, replicate)), remainder))


def _cuts() -> list[int]:
    """Draws below the k-th cut have a Poisson(1) weight of k at most."""
    total, out = 0.0, []
    for k in range(10):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(total * PRIME))
    return out


def poisson(h: Column) -> Column:
    """The Poisson(1) weight of a draw."""
    return sum(((h >= c).cast("int") for c in _cuts()), F.lit(0))


def poisson_sql(h: str) -> str:
    return "(" + " + ".join(f"CAST({h} >= {c} AS INTEGER)" for c in _cuts()) + ")"


def replicate_sums(d: DataFrame, a: str, b: str, key: str, values: Sequence[str]) -> DataFrame:
    """(key, b, n, values...): for each value of ``key`` and replicate the sum of the Poisson weights that ``a`` and ``b`` draw, and the
    weighted sum of each of ``values`` (whole numbers).  As one column expression a weight repeats its draw for every cut;
    here a task draws a batch's weights of one replicate at a time and only sums leave it, one row a batch, key and replicate."""
    names = [a, b, *values]
    rows = d.select(key, *(F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(f"_{i}") for i, c in enumerate(names)))
    fields = [T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(v, T.LongType()) for v in values)]
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), *fields])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(_cuts(), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).dictionary_encode(null_encoding="encode")
            order = np.argsort(group.indices.to_numpy(), kind="stable")
            code = group.indices.to_numpy()[order]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            one, two, *value = (batch.column(1 + i).to_numpy()[order] for i in range(len(names)))
            out = np.empty((REPLICATES, 1 + len(value), len(starts)), np.int64)
            for r in range(REPLICATES):
                weight = np.searchsorted(cuts, _steps(one, two, np.int64(r), lambda x: x % PRIME), side="right")
                for j, v in enumerate([weight, *(weight * v for v in value)]):
                    out[r, j] = np.add.reduceat(v, starts)
            keys = group.dictionary.take(pa.array(np.tile(code[starts], REPLICATES)))
            numbers = [pa.array(out[:, j].reshape(-1)) for j in range(out.shape[1])]
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.repeat(np.arange(REPLICATES, dtype=np.int32), len(starts))), *numbers], names=schema.names)

    return rows.mapInArrow(add_up, schema).groupBy(key, "b").agg(*(F.sum(c).alias(c) for c in ("n", *values))).where("n > 0")
