"""Token counts by a map-side two-tier lookup; no pre-token is shuffled.

Tier one is a broadcast table of the corpus' most frequent units (a unit: what stands between two
single spaces) and their token counts, bounded by ``hot`` units of at most KEPT characters each, and so by
hot * KEPT characters; every document is counted for it, each task summing up its own and passing on its ``per_task``
most frequent ones.  Tier two is a cache in each worker, bounded alike, which encodes a unit by the tokenizers library
when it is first met.  Both tiers only save work: a unit in neither is encoded, so the counts don't depend on them.

A null text counts as empty: no bytes, no tokens.  Every input row gets its own result row.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import texts
from strideframe.llm.tokens import KEPT, UnitLengths, encode, space_units

VOCABULARY = "byte_bpe_50k.json"


def _frequent(batches: Iterator[pa.RecordBatch], per_task: int, memory: int = 300_000) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text"):
            seen.update(u for u in space_units(text.as_py() or "")[1:] if len(u) <= KEPT)
            if len(seen) > memory:  # forget the rare ones; they'd not get into the table
                seen = Counter(dict(seen.most_common(memory // 2)))
    top = seen.most_common(per_task)
    yield pa.record_batch({"unit": pa.array([u for u, _ in top], pa.string()),
                           "n": pa.array([n for _, n in top], pa.int64())})


def frequent_units(docs: DataFrame, hot: int, per_task: int) -> list[str]:
    """The (about) ``hot`` most frequent units of all documents."""
    found = texts(docs).select("text").mapInArrow(lambda b: _frequent(b, per_task), "unit string, n long")
    top = found.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(hot)
    return [r.unit for r in top.collect()]


@lru_cache(maxsize=1)
def _lengths(vocabulary: str, hot) -> UnitLengths:
    return UnitLengths(vocabulary, hot.value)


class _Hot:
    """A broadcast that equals others of the same key, for the worker's lru_cache."""

    def __init__(self, key, broadcast):
        self.key, self.broadcast = key, broadcast

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    @property
    def value(self):
        return self.broadcast.value


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 limit: int = 512, hot: int = 50_000, per_task: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row."""
    spark = docs.sparkSession
    docs = texts(docs, id_col, text_col)
    table = {u: len(encode(vocabulary, " " + u)) for u in frequent_units(docs, hot, per_task)}
    broadcast = _Hot(uuid4().hex, spark.sparkContext.broadcast(table))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(vocabulary, broadcast)
        for batch in batches:
            n = []
            for text in batch.column("text"):
                first, *rest = space_units(text.as_py() or "")
                n.append(lengths.first(first) + sum(map(lengths.__getitem__, rest)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                                   "n_tokens": pa.array(n, pa.int64())})

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long") \
                .withColumn("over_limit", F.col("n_tokens") > limit)
