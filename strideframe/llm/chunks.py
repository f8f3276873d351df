"""Documents gathered in chunks: one row holds many documents, squeezed, under a number of its own.

Operators that match windows of texts across the corpus stage the documents so and exchange a few rows
per chunk (see exchange) instead of one per window.  The staged table fixes which documents a chunk has,
whatever is retried later.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strideframe.llm.sequences import utf8
from strideframe.llm.store import stage, texts

#: Bytes of text in a chunk; numpy works on one chunk at a time.  A longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def dump(part: pa.RecordBatch) -> bytes:
    """A batch as squeezed Arrow bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=_OPTIONS) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def _gather(batches: Iterator[pa.RecordBatch], chunk_bytes: int, chunk_rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    number, waiting, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0

    def chunk() -> pa.RecordBatch:
        whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        return pa.record_batch({"chunk": pa.array([number], pa.int64()), "docs": pa.array([dump(whole)], pa.binary())})

    for batch in batches:
        batch = pa.record_batch({"doc_id": batch.column("doc_id"), "text": batch.column("text").cast(pa.large_string())})
        _, offsets = utf8(batch.column("text"))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(offsets, offsets[a] + chunk_bytes - size, "right")) - 1
            b = min(b, batch.num_rows, a + chunk_rows - rows)
            if b <= a and waiting:
                yield chunk()
                number, waiting, size, rows = number + 1, [], 0, 0
                continue
            b = max(b, a + 1)
            waiting.append(batch.slice(a, b - a))
            size, rows, a = size + int(offsets[b] - offsets[a]), rows + b - a, b
    if waiting:
        yield chunk()


def gather(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk long, docs binary), staged."""
    return stage(texts(docs, id_col, text_col).mapInArrow(lambda b: _gather(b, chunk_bytes), "chunk long, docs binary"),
                 "chunks", compression="none")


def parsed(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def load(docs: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A chunk's doc_ids, UTF-8 bytes, and offsets of its texts."""
    part = parsed(docs)
    return part.column("doc_id"), *utf8(part.column("text"))
