"""Substring dedup with difference-cover anchors.

Two documents share a window of ``window`` words at word i of one and word j of the other.  A
difference cover modulo ``period`` has, for any i and j, a shift below the period that takes both to
cover positions; with grams of window - period + 1 words the shifted grams still lie in the window.
So hashing only the grams at cover positions finds every shared window:

1. each chunk of documents sends its distinct anchor grams, by hash bucket, and learns which occur in
   two documents or more;
2. matches are extended: every window that holds such an anchor is looked up itself, under the hashes
   of its two halves (128 bits), and the smallest doc_id with it comes back;
3. words of windows that a smaller doc_id has go, and the kept ones are joined by one space.

A gram or window reaches its bucket once per chunk, however many documents share it, so copies and
passages that a third of the corpus shares make no hot key, and no group is gathered.

Null texts have no words and give "".  A null doc_id counts as larger than any other
(and as equal to 2**63 - 1).  Rows with equal
doc_id keep what they share, for neither is smaller; each row gets a result row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideframe.llm import chunks, exchange
from strideframe.llm.exchange import expand, pack, squeeze, unpack
from strideframe.llm.sequences import cover, gram_hash, mix, sums, within, words
from strideframe.llm.store import stage

WINDOW = 50
# fixed values: the difference cover modulo 31 with the fewest members
COVERS = {31: (0, 1, 3, 8, 12, 18)}

# fixed values: words are runs of all but 0x20 and 0x09-0x0D
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LAST = np.iinfo(np.int64).max


def difference_cover(window: int) -> tuple[int, tuple[int, ...]]:
    """A period for ``window`` and its cover: each difference modulo the period is one of two members."""
    period = min(31, window // 2 + 1)
    if period in COVERS:
        return period, COVERS[period]
    step = max(1, int(period ** 0.5))
    return period, tuple(sorted({*range(step), *range(step - 1, period, step), period - 1}))


class _Chunk:
    """The words of a chunk, its anchors and its windows."""

    def __init__(self, docs: bytes, window: int):
        self.window = window
        self.doc_ids, self.data, offsets = chunks.load(docs)
        self.start, self.end, self.hashes, self.first = words(self.data, offsets, _WORD)
        self.n = len(self.start)
        period, members = difference_cover(window)
        self.gram = window - period + 1
        size = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(size)), size)
        place = np.arange(self.n) - self.first[self.doc]
        member = np.zeros(period, bool)
        member[list(members)] = True
        inside = (size[self.doc] >= window) & (place + self.gram <= size[self.doc])
        self.anchors = np.flatnonzero(member[place % period] & inside)
        self.grams = mix(gram_hash(self.hashes, self.gram))[self.anchors]

    def anchor_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct grams, whether two documents of the chunk have them, and each anchor's gram."""
        keys, index = np.unique(self.grams, return_inverse=True)
        low, high = np.full(len(keys), self.n), np.full(len(keys), -1)
        np.minimum.at(low, index, self.doc[self.anchors])
        np.maximum.at(high, index, self.doc[self.anchors])
        return keys, low < high, index

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both hashes of the windows that hold one of the anchors marked ``shared``."""
        at = self.anchors[shared]
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, np.maximum(at - (self.window - self.gram), 0), 1)
        np.add.at(edge, at + 1, -1)
        ok = within(self.n, self.window, self.first)
        p = np.flatnonzero((np.cumsum(edge)[:len(ok)] > 0) & ok)
        half = self.window // 2
        return p, mix(gram_hash(self.hashes, half))[p], mix(gram_hash(self.hashes, self.window - half))[p + half]

    def ids(self) -> np.ndarray:
        return self.doc_ids.fill_null(_LAST).to_numpy()

    def kept(self, removed: np.ndarray) -> pa.RecordBatch:
        """Each document without its ``removed`` words."""
        keep = np.flatnonzero(~removed)
        size = self.end[keep] - self.start[keep] + 1  # a space behind each
        out = np.cumsum(size)
        place = np.repeat(self.start[keep] - (out - size), size) + np.arange(out[-1] if len(out) else 0)
        text = np.append(self.data, np.uint8(32))[np.minimum(place, len(self.data))]
        text[out - 1] = 32
        ends = np.concatenate([[0], out])[np.searchsorted(keep, self.first)]
        flat = text.tobytes()
        return pa.record_batch({
            "doc_id": self.doc_ids, "n_words": pa.array(np.diff(self.first), pa.int64()),
            "n_removed": pa.array(sums(removed, self.first), pa.int64()),
            "text": pa.array([flat[a:max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()).cast(pa.string())})


def _deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' order by bucket, and where each bucket begins in it."""
    bucket = (keys >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _messages(chunk: int, starts: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    sent = [b for b in range(len(starts) - 1) if starts[b + 1] > starts[b]]
    return pa.record_batch({
        "chunk": pa.array([chunk] * len(sent), pa.int64()), "bucket": pa.array(sent, pa.int32()),
        "payload": pa.array([pack(*(a[starts[b]:starts[b + 1]] for a in arrays)) for b in sent], pa.binary())})


def _answers(replies: list | None, order: np.ndarray, starts: np.ndarray, kind) -> np.ndarray:
    """The replies' values, in the order of the keys."""
    out = np.zeros(len(order), kind)
    for r in replies or []:
        own = order[starts[r["bucket"]]:starts[r["bucket"] + 1]]
        data = np.frombuffer(expand(r["reply"]), np.uint8 if kind is bool else kind)
        out[own] = np.unpackbits(data, count=len(own)).astype(bool) if kind is bool else data
    return out


def _shared(payloads: list[bytes]) -> list[bytes]:
    """Which grams occur in two documents, or more."""
    parts = [unpack(p, np.uint64, bool) for p in payloads]
    _, index = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    twice = np.bincount(index, weights=1 + np.concatenate([m for _, m in parts]))[index] > 1
    ends = np.cumsum([len(k) for k, _ in parts])
    return [squeeze(np.packbits(t).tobytes()) for t in np.split(twice, ends[:-1])]


def _smallest(payloads: list[bytes]) -> list[bytes]:
    """The smallest doc_id of each window."""
    parts = [unpack(p, np.uint64, np.uint64, np.int64) for p in payloads]
    a, b, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = np.empty(len(order), np.int64)
    least[order] = ids[order][new][np.cumsum(new) - 1]
    ends = np.cumsum([len(x) for x, _, _ in parts])
    return [squeeze(x.tobytes()) for x in np.split(least, ends[:-1])]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words joined by one space) of each row."""
    gathered = chunks.gather(docs, id_col, text_col, chunk_bytes)
    buckets = exchange.bucket_count(docs.sparkSession, gathered.count() * chunk_bytes)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            keys, several, _ = _Chunk(row["docs"], window).anchor_keys()
            order, starts = _deal(keys, buckets)
            yield _messages(row["chunk"], starts, keys[order], several[order])

    def candidates(row) -> tuple:
        c = _Chunk(row["docs"], window)
        keys, _, index = c.anchor_keys()
        p, a, b = c.windows(_answers(row["replies"], *_deal(keys, buckets), bool)[index])
        # the chunk's distinct windows
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        return c, p, a[order][new], b[order][new], index

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            c, p, a, b, index = candidates(row)
            least = np.full(len(a), _LAST)
            np.minimum.at(least, index, c.ids()[c.doc[p]])
            order, starts = _deal(a ^ b, buckets)
            yield _messages(row["chunk"], starts, a[order], b[order], least[order])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            c, p, a, b, index = candidates(row)
            least = _answers(row["least"], *_deal(a ^ b, buckets), np.int64)
            gone = p[c.ids()[c.doc[p]] > least[index]]
            yield c.kept(cover(gone, window, c.n))

    shared = stage(exchange.ask(gathered.mapInArrow(send_anchors, exchange.MESSAGE), _shared), "shared-anchors")
    first = exchange.with_replies(gathered, shared)
    least = exchange.ask(first.mapInArrow(send_windows, exchange.MESSAGE), _smallest)
    second = exchange.with_replies(first, least, "least")
    return second.mapInArrow(remove, "doc_id long, n_words long, n_removed long, text string")
