"""Packed exchanges between document chunks and key buckets.

Several operators ask one question per distinct key of a chunk of documents ("how often does this
window occur?", "which ids has this word?").  A row per key would cost more in row headers than in
keys, so a chunk sends each bucket one row with all its keys, already distinct within the chunk, and
the bucket answers each such row with one row.  A key therefore reaches its bucket at most once per
chunk, however many rows of the corpus hold it.

messages: (chunk long, bucket int, payload binary); replies: (chunk long, bucket int, reply binary).
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of documents that one bucket's keys stem from, at most on average.
BUCKET_BYTES = 64 << 20

MESSAGE = "chunk long, bucket int, payload binary"
REPLY = "chunk long, bucket int, reply binary"


def bucket_count(spark: SparkSession, size: int) -> int:
    """Buckets for the keys of ``size`` bytes of documents: more for more, so that a bucket stays small."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))


def ask(messages: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``answer`` gets all payloads of a bucket and returns one reply for each."""
    def bucket(table: pa.Table) -> pa.Table:
        replies = answer([x.as_py() for x in table["payload"]])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "reply": pa.array(replies, pa.binary())})

    return messages.groupBy("bucket").applyInArrow(bucket, REPLY)


def with_replies(chunks: DataFrame, replies: DataFrame, name: str = "replies") -> DataFrame:
    """``chunks`` with a column ``name``: array of (bucket, reply), null where there was no question."""
    gathered = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))
    return chunks.join(gathered, "chunk", "left")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as bytes."""
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return b"".join([sizes.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(data: bytes, *types) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [np.frombuffer(data, t, s // np.dtype(t).itemsize, e - s) for t, s, e in zip(types, sizes, ends)]


def squeeze(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches one at a time, large values as they are needed."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
