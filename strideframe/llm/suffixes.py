"""Substring dedup by a sparse suffix array over bytes.

Wanted are the bytes that some ``window``-byte string covers which starts elsewhere as well, in any
document.  An array of all suffixes with their texts is hundreds of times the corpus, so suffixes enter
it sparsely and by name: a suffix's leading tokens are the hashes of its first ``gram`` bytes and of the
``gram`` bytes that end its window, which together cover the window (128 and 96 bits; in the 96 the first
token is crossed with all of the second, as windows that share their first gram are told apart by the second alone).

1. Of every window the gram with the smallest hash is an anchor, chosen by content, so equal windows
   have equal anchors; the anchors' suffixes (and those at each document's first and last window) are
   range-partitioned by leading tokens, at splitters sampled from the chunks.  Each bucket is sorted by
   multikey quicksort: by the first token, then runs of equal ones by the next.  Neighbours tell
   which anchors are shared and which whole windows repeat.  Runs of a leading token that a splitter cuts
   are compared across the boundary: they are longer than a bucket's part, so shared.
2. The windows that hold a shared anchor are sorted alike, to find the repeated ones byte-exactly up to
   the ends of a shared passage.  Between two repeated anchor windows of the same text in several
   places those that a smaller id has too send none; there, all bytes are known to be covered.
3. The bytes of repeated windows go.  Answers also tell whether a document with a smaller id has the window, which marks
   the bytes that are copies of an earlier document.  Between repeated anchors only places that no smaller id has send.

A suffix reaches its bucket once per chunk, so neither copies nor shared passages make a bucket hot, and
a token that many different windows lead with is split by the next one.

Null texts are empty.  Each row gets a result row, whatever its id; a null id counts as the largest.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideframe.llm import chunks, exchange
from strideframe.llm.exchange import expand, pack, squeeze, unpack
from strideframe.llm.sequences import NONE, byte_values, cover, gram_hash, minima, mix, spans, sums
from strideframe.llm.store import stage

WINDOW = 400
GRAM = 256
#: Leading tokens sampled for each bucket, and of a chunk at most: the sample grows with the buckets, from 32 chunks on.
#: Splitters move bucket borders, never results.
SAMPLE_EACH, SAMPLE_TOKENS, SAMPLE_CHUNKS = 64, 2000, 32


def multikey_order(*tokens: np.ndarray) -> np.ndarray:
    """The order by the first token, then, within runs of equal ones, by the second, and so on."""
    order = np.argsort(tokens[0])
    for depth in range(1, len(tokens)):
        same = np.ones(max(len(order) - 1, 0), bool)
        for t in tokens[:depth]:
            same &= t[order][1:] == t[order][:-1]
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run = np.cumsum(np.concatenate([[True], ~same]))[at]
        order[at] = order[at][np.lexsort((tokens[depth][order[at]], run))]
    return order


def _runs(order: np.ndarray, *tokens: np.ndarray) -> np.ndarray:
    """The number of the run of equal tokens that each entry, in its own place, belongs to."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for t in tokens:
            new[1:] |= t[order][1:] != t[order][:-1]
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(new) - 1
    return run


def lowest(index: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The smallest id of each of n groups."""
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, index, ids)
    return low


class _Chunk:
    """The bytes of a chunk, its anchors and its windows."""

    def __init__(self, docs: bytes, window: int, gram: int):
        self.window, self.gram = window, gram
        self.doc_ids, self.data, self.offsets = chunks.load(docs)
        self.ids = self.doc_ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        n, size = len(self.data), np.diff(self.offsets)
        self.head = mix(gram_hash(byte_values(self.data), gram)) if n else np.zeros(0, np.uint64)
        # the place behind the last window of each document that has one, and which windows are whole
        long = size >= window
        first, last = self.offsets[:-1][long], self.offsets[1:][long] - window
        edge = np.zeros(n + 1, np.int32)
        edge[first] += 1
        np.add.at(edge, last + 1, -1)
        self.whole = np.cumsum(edge)[:n] > 0
        edge[:] = 0
        edge[first] += 1
        np.add.at(edge, last + window - gram + 1, -1)
        grams = np.where(np.cumsum(edge)[:len(self.head)] > 0, self.head, NONE)
        self.anchors = np.union1d(minima(grams, window - gram + 1), np.concatenate([first, last])).astype(np.int64)

    def tokens(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leading tokens of the suffixes at p; the second is 0 where the window isn't whole."""
        second = np.zeros(len(p), np.uint64)
        whole = self.whole[p]
        second[whole] = self.head[p[whole] + self.window - self.gram] | np.uint64(1)
        return self.head[p], second

    def names(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for each whole window at p.  Windows with one of the two grams in common differ in the first 64."""
        a, b = self.head[p], self.head[p + self.window - self.gram]
        return a ^ mix(b), b.astype(np.uint32)

    def owners(self, p: np.ndarray) -> np.ndarray:
        """The ids of the documents at places p."""
        return self.ids[np.searchsorted(self.offsets, p, "right") - 1]

    def suffixes(self):
        """The anchors' distinct (first, second, next) tokens, how often each occurs and its smallest id; each anchor's entry.
        next names the text up to the end of the next anchor's window, and is 0 where that isn't one text."""
        a, b = self.tokens(self.anchors)
        after = np.zeros(len(a), np.uint64)
        gap = np.diff(self.anchors)
        joined = (b[:-1] > 0) & (b[1:] > 0) & (gap <= self.window)
        # an end of a document between the two would leave the first one's window short of the second's start
        doc = np.searchsorted(self.offsets, self.anchors, "right")
        joined &= doc[:-1] == doc[1:]
        after[:-1][joined] = mix(gram_hash(np.stack([a[:-1], b[:-1], a[1:], b[1:], gap.astype(np.uint64)])[:, joined].T.ravel(), 5)[::5]) if joined.any() else 0
        order = multikey_order(a, b, after)
        index = _runs(order, a, b, after)
        count = np.bincount(index)
        at = np.zeros(len(count), np.int64)
        at[index] = np.arange(len(index))
        return a[at], b[at], after[at], count, lowest(index, self.owners(self.anchors), len(count)), index

    def candidates(self, shared: np.ndarray, whole: np.ndarray, known: np.ndarray, later: np.ndarray):
        """Window starts to ask for, the bytes known to be covered, and those known to be copies: ``shared`` says for
        each anchor whether it occurs elsewhere, ``whole`` whether its window does, ``known`` whether a smaller id has
        the text from it to the next anchor's window, ``later`` whether one has its window."""
        n = len(self.data)
        reach = np.zeros(n + 1, np.int64)
        at = self.anchors[shared]
        np.add.at(reach, np.maximum(at - (self.window - self.gram), 0), 1)
        np.add.at(reach, at + 1, -1)
        ask = (np.cumsum(reach)[:n] > 0) & self.whole
        quiet = np.flatnonzero(known[:-1] & whole[:-1] & whole[1:]) if len(known) else np.zeros(0, np.int64)
        reach[:] = 0
        np.add.at(reach, self.anchors[quiet], 1)
        np.add.at(reach, self.anchors[quiet + 1], -1)
        ask &= np.cumsum(reach)[:n] == 0
        return np.flatnonzero(ask), cover(self.anchors[whole], self.window, n), cover(self.anchors[whole & later], self.window, n)


class _Splitters:
    """Bucket borders in the order of (first, second) tokens."""

    def __init__(self, first: np.ndarray, second: np.ndarray, buckets: int):
        order = np.lexsort((second, first))
        at = np.unique(np.linspace(0, len(order), buckets + 1)[1:-1].astype(np.int64)) if len(order) else []
        pairs = sorted({(int(first[order[i]]), int(second[order[i]])) for i in at})
        self.first = np.array([p[0] for p in pairs], np.uint64)
        self.second = np.array([p[1] for p in pairs], np.uint64)

    def deal(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For entries sorted by (first, second) token: where each bucket begins; and which entries share their
        leading token with a border, so that their run may go on in the next bucket."""
        low, high = np.searchsorted(self.first, a, "left"), np.searchsorted(self.first, a, "right")
        bucket = high.copy()
        cut = np.flatnonzero(high > low)
        for i in cut:
            bucket[i] = low[i] + np.searchsorted(self.second[low[i]:high[i]], b[i], "right")
        return np.searchsorted(bucket, np.arange(len(self.first) + 2)), high > low


def _messages(chunk: int, starts: np.ndarray, *arrays: np.ndarray) -> pa.RecordBatch:
    sent = [k for k in range(len(starts) - 1) if starts[k + 1] > starts[k]]
    return pa.record_batch({
        "chunk": pa.array([chunk] * len(sent), pa.int64()), "bucket": pa.array(sent, pa.int32()),
        "payload": pa.array([pack(*(x[starts[k]:starts[k + 1]] for x in arrays[:-1]), _squeezed(arrays[-1][starts[k]:starts[k + 1]])) for k in sent], pa.binary())})


def _squeezed(ids: np.ndarray) -> np.ndarray:
    return np.frombuffer(squeeze(ids.tobytes()), np.uint8)


def _ids(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(expand(data.tobytes()), np.int64)


def _flags(replies: list | None, starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint8)
    for r in replies or []:
        out[starts[r["bucket"]]:starts[r["bucket"] + 1]] = np.frombuffer(expand(r["reply"]), np.uint8)
    return out


def _split(values: np.ndarray, sizes: list[int]) -> list[bytes]:
    return [squeeze(v.tobytes()) for v in np.split(values.astype(np.uint8), np.cumsum(sizes)[:-1])]


def _anchor_answers(payloads: list[bytes]) -> list[bytes]:
    """For each entry: 1 if its first token occurs elsewhere, 2 if its window does, 4 if a smaller id has its window, 8 if
    one has its text up to the next anchor."""
    parts = [unpack(p, np.uint64, np.uint64, np.uint64, np.uint8, np.uint8) for p in payloads]
    a, b, after, count = (np.concatenate(x) for x in zip(*(p[:4] for p in parts)))
    low = np.concatenate([_ids(p[4]) for p in parts])
    order = multikey_order(a, b, after)
    head, window, text = _runs(order, a), _runs(order, a, b), _runs(order, a, b, after)
    shared = np.bincount(head, weights=count)[head] > 1
    whole = (np.bincount(window, weights=count)[window] > 1) & (b > 0)
    later, known = (lowest(run, low, len(order))[run] < low for run in (window, text))
    return _split(shared + 2 * whole + 4 * (later & whole) + 8 * (known & (after > 0)), [len(p[0]) for p in parts])


def _window_answers(payloads: list[bytes]) -> list[bytes]:
    """For each window: 1 if it occurs elsewhere, 2 if a smaller id has it."""
    parts = [unpack(p, np.uint64, np.uint32, np.uint8, np.uint8) for p in payloads]
    a, b, count = (np.concatenate(x) for x in zip(*(p[:3] for p in parts)))
    low = np.concatenate([_ids(p[3]) for p in parts])
    run = _runs(multikey_order(a, b), a, b)
    return _split((np.bincount(run, weights=count)[run] > 1) + 2 * (lowest(run, low, len(run))[run] < low), [len(p[0]) for p in parts])


def _sampled(gathered: DataFrame, window: int, gram: int, buckets: int) -> tuple[_Splitters, _Splitters]:
    """Splitters for the anchors' suffixes and for those of all windows."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            c, rng = _Chunk(row["docs"], window, gram), np.random.default_rng(row["chunk"] % (1 << 31))
            for kind, p in enumerate((c.anchors, np.flatnonzero(c.whole))):
                p = np.sort(rng.choice(p, min(len(p), SAMPLE_TOKENS), replace=False)) if len(p) else p
                a, b = c.names(p) if kind else c.tokens(p)
                yield pa.record_batch({"kind": pa.array([kind] * len(p), pa.int32()), "a": pa.array(a.view(np.int64)),
                                       "b": pa.array(b.astype(np.uint64).view(np.int64))})

    share = min(1.0, max(SAMPLE_CHUNKS, buckets * SAMPLE_EACH / SAMPLE_TOKENS) / max(gathered.count(), 1))
    found = gathered.sample(share, 7).mapInArrow(sample, "kind int, a long, b long").toPandas()
    return tuple(_Splitters(*(found.loc[found["kind"] == k, x].to_numpy(np.int64).view(np.uint64) for x in "ab"), buckets) for k in (0, 1))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 gram: int = GRAM, chunk_bytes: int = chunks.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) and n_later (removed bytes of windows that a
    smaller id has as well: what would go if the first copy stayed) of each row.  Two grams must
    cover a window: window / 2 <= gram <= window."""
    if not window <= 2 * gram <= 2 * window:
        raise ValueError(f"a gram of {gram} bytes doesn't fit a window of {window}")
    gathered = chunks.gather(docs, id_col, text_col, chunk_bytes)
    buckets = exchange.bucket_count(docs.sparkSession, gathered.count() * chunk_bytes)
    heads, windows = _sampled(gathered, window, gram, buckets)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            a, b, after, count, low, _ = _Chunk(row["docs"], window, gram).suffixes()
            yield _messages(row["chunk"], heads.deal(a, b)[0], a, b, after, np.minimum(count, 2).astype(np.uint8), low)

    def asked(row):
        c = _Chunk(row["docs"], window, gram)
        a, b, after, count, low, index = c.suffixes()
        starts, cut = heads.deal(a, b)
        flags = _flags(row["replies"], starts, len(a))
        shared, whole, later, known = (flags & bit > 0 for bit in (1, 2, 4, 8))
        # within an entry, its smallest id has what the others have
        after_low = c.owners(c.anchors) > low[index]
        p, covered, copied = c.candidates((shared | cut)[index], whole[index], (known[index] | after_low) & (after[index] > 0), later[index] | after_low)
        a, b = c.names(p)
        order = multikey_order(a, b)
        index = _runs(order, a, b)
        count = np.bincount(index)
        one = np.zeros(len(count), np.int64)
        one[index] = np.arange(len(index))
        a, b, low = a[one], b[one], lowest(index, c.owners(p), len(count))
        return c, p, covered, copied, a, b, count, low, index, windows.deal(a, b.astype(np.uint64))[0]

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            *_, a, b, count, low, _, starts = asked(row)
            yield _messages(row["chunk"], starts, a, b, np.minimum(count, 2).astype(np.uint8), low)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in exchange.rows(batches):
            c, p, gone, copied, a, _, _, low, index, starts = asked(row)
            flags = _flags(row["repeats"], starts, len(a))[index]
            gone |= cover(p[flags & 1 > 0], window, len(c.data))
            copied |= cover(p[(flags & 2 > 0) | (c.owners(p) > low[index])], window, len(c.data))
            kept = c.data[~gone].tobytes()
            removed = sums(gone, c.offsets)
            ends = np.concatenate([[0], np.cumsum(np.diff(c.offsets) - removed)]).tolist()
            yield pa.record_batch({
                "doc_id": c.doc_ids, "n_bytes": pa.array(np.diff(c.offsets)), "n_removed": pa.array(removed),
                "n_spans": pa.array(spans(gone, c.offsets)),
                "kept": pa.array([kept[s:e] for s, e in zip(ends[:-1], ends[1:])], pa.binary()), "n_later": pa.array(sums(copied, c.offsets))})

    told = stage(exchange.ask(gathered.mapInArrow(send_anchors, exchange.MESSAGE), _anchor_answers), "shared-suffixes")
    first = exchange.with_replies(gathered, told)
    repeats = exchange.ask(first.mapInArrow(send_windows, exchange.MESSAGE), _window_answers)
    second = exchange.with_replies(first, repeats, "repeats")
    return second.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_later long")
