"""Benchmark decontamination by winnowing.

An item's windows are its 13 consecutive words, or all its words where it has fewer.  Of a window's
k-gram hashes the minimum is its fingerprint; a text's fingerprints are the minima of all its windows.
A document that holds an item's window holds that window's fingerprint as well, so matching the
fingerprints finds every shared window; each match is then extended: the windows around it are looked
up word for word in the table of item windows.

The benchmark is a stated query set.  Tasks make its windows and stage them in blocks of at most ``block_windows``
windows and BLOCK_BYTES bytes, whatever items they are of; a block with its fingerprints is what a task holds at a
time, and it matches all documents against it without any shuffle.  One block holds a usual benchmark.  With more blocks
the documents are staged once with row numbers, each block's pass gives the hit rows alone, and hits are merged by row.
No bucket, key or document is ever gathered.

Null texts have no words.  Items without words have no windows; items with equal texts all count, and so do repeated
items, as one.  Null item ids don't count as items.  Every document row gets its own result row, with its own columns;
one that has the result's name is replaced.
"""
from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.llm.sequences import NONE, gram_hash, minima, mix, portions, sliding, sums, utf8, within, words
from strideframe.llm.store import ship, stage

WINDOW = 13
#: Item windows in a block: some 20 MB in a task.
BLOCK_WINDOWS = 200_000
BLOCK_BYTES = 32 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# fixed values: words are runs of 0-9, letters a-z in either case, and all beyond ASCII
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _gram(size: int) -> int:
    """The k of a window of ``size`` words; its k-grams are size - k + 1."""
    return (size + 1) // 2


def _split(column: pa.Array):
    data, offsets = utf8(column)
    start, end, hashes, first = words(data, offsets, _WORD, _LOWER)
    return _LOWER[data], start, end, hashes, first


def _text(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: int, b: int) -> bytes:
    return b" ".join(data[s:e].tobytes() for s, e in zip(start[a:b], end[a:b]))


def _fingerprints(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the minima of every window of ``size`` words."""
    k = _gram(size)
    grams = mix(gram_hash(hashes, k))
    grams[~within(len(hashes), k, first)] = NONE
    at = minima(grams, size - k + 1)
    return at, grams[at]


class _Block:
    """Some windows by their words with their items, and their fingerprints by window length."""

    def __init__(self, windows: Iterator[tuple[int, bytes, str, int]] = ()):
        self.items: dict[bytes, set] = defaultdict(set)
        prints: dict[int, list[int]] = defaultdict(list)
        for size, text, item, mark in windows:
            self.items[text].add(item)
            prints[size].append(mark)
        self.prints = {size: np.unique(np.array(p, np.int64).view(np.uint64)) for size, p in prints.items()}


def _item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_windows: int, block_bytes: int) -> DataFrame:
    """block, size, words, item, mark (the fingerprint) of each item's windows, staged."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text")):
                data, start, end, hashes, first = _split(pa.array([text.as_py()]))
                n, size = len(start), min(len(start), window)
                if not n:
                    continue
                k = _gram(size)
                # a window's own fingerprint, whichever of its grams has it
                marks = sliding(mix(gram_hash(hashes, k)), size - k + 1, np.minimum).view(np.int64)
                for a in range(0, n - size + 1, 10_000):
                    b = min(a + 10_000, n - size + 1)
                    yield pa.record_batch({"size": pa.array([size] * (b - a), pa.int32()), "item": pa.array([item.as_py()] * (b - a), pa.string()),
                                           "words": pa.array([_text(data, start, end, x, x + size) for x in range(a, b)], pa.binary()), "mark": pa.array(marks[a:b])})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks = []
            for text in batch.column("words"):
                if held and (held >= block_windows or size + len(text.as_py()) > block_bytes):
                    block, held, size = block + 1, 0, 0
                held, size = held + 1, size + len(text.as_py())
                blocks.append(block)
            yield batch.append_column("block", pa.array(blocks, pa.int64()))

    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = items.where("item is not null and text is not null").mapInArrow(make, "size int, item string, words binary, mark long")
    windows = stage(made.distinct(), "item-windows")
    parts = max(1, math.ceil(windows.count() / block_windows))
    numbered = windows.coalesce(1) if parts == 1 else windows.repartition(parts, "words", "item")
    return stage(numbered.mapInArrow(number, "size int, item string, words binary, mark long, block long"), "window-blocks")


def _hits(block: _Block, data, start, end, hashes, first) -> Iterator[tuple[int, int, bytes]]:
    """(first word, number of words, words) of every occurrence of a window of the block."""
    for size, known in block.prints.items():
        at, prints = _fingerprints(hashes, first, size)
        at = at[known[np.minimum(np.searchsorted(known, prints), len(known) - 1)] == prints]
        # the windows that hold one of these grams, within their documents
        k = _gram(size)
        try_ = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(try_, np.maximum(at - (size - k), 0), 1)
        np.add.at(try_, at + 1, -1)
        ok = within(len(hashes), size, first)
        for a in np.flatnonzero((np.cumsum(try_)[:len(ok)] > 0) & ok).tolist():
            text = _text(data, start, end, a, a + size)
            if text in block.items:
                yield a, size, text


OVERLAP = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def _overlap(first: np.ndarray, hit: np.ndarray, items: dict[int, set]) -> pa.Array:
    """One OVERLAP for each text from its hit words and items."""
    edges = []
    for a, b in zip(first[:-1], first[1:]):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]]))).tolist()
        edges.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
    return pa.StructArray.from_arrays([
        pa.array(np.diff(first), pa.int64()), pa.array(sums(hit, first), pa.int64()),
        pa.array([sorted(items.get(d, ())) for d in range(len(edges))], pa.list_(pa.string())),
        pa.array(edges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["n_words", "n_hit", "items", "spans"])


def _judge(block: _Block, column: pa.Array) -> pa.Array:
    """The OVERLAP of each text with a block's windows."""
    data, start, end, hashes, first = _split(column)
    hit, items = np.zeros(len(start), bool), defaultdict(set)
    for a, size, text in _hits(block, data, start, end, hashes, first):
        hit[a:a + size] = True
        items[int(np.searchsorted(first, a, "right")) - 1] |= block.items[text]
    return _overlap(first, hit, items)


def _merge(column: pa.Array, found: list) -> pa.Array:
    """The OVERLAP of each text from those that the blocks' passes found."""
    first = _split(column)[4]
    hit, items = np.zeros(int(first[-1]), bool), defaultdict(set)
    for d, parts in enumerate(found):
        for part in parts or []:
            items[d] |= set(part["items"])
            for s in part["spans"]:
                hit[first[d] + s["start"]:first[d] + s["end"]] = True
    return _overlap(first, hit, items)


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
             out: str = "overlap", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``out`` (OVERLAP): n_words, n_hit (words inside item windows), items (their ids as
    strings, sorted) and spans (of hit words: first word, end)."""
    spark = docs.sparkSession
    ship(spark)
    names = [c for c in docs.columns if c != out]
    docs = docs.select(*(f"`{c}`" for c in names))
    schema = T.StructType([*docs.schema, T.StructField(out, OVERLAP)])
    windows = _item_windows(benchmark, item_col, item_text_col, window, block_windows, block_bytes)
    numbers = sorted(r.block for r in windows.select("block").distinct().collect())

    def table(number: int | None):
        rows = windows.where(F.col("block") == number).select("size", "words", "item", "mark").collect() if number is not None else []
        return spark.sparkContext.broadcast(_Block((r["size"], bytes(r["words"]), r["item"], r["mark"]) for r in rows))

    def texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        column = batch.column(name).cast(pa.large_string())
        for a, b in portions(column):
            yield batch.slice(a, b - a), column.slice(a, b - a)

    if len(numbers) < 2:
        only = table(numbers[0] if numbers else None)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, column in texts(batch, text_col):
                    yield pa.RecordBatch.from_arrays([*part.columns, _judge(only.value, column)], [*names, out])

        return docs.mapInArrow(judge, schema)

    own = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"),
                            F.struct(*(f"`{c}`" for c in names)).alias("own")), "numbered")

    def hits(number: int) -> DataFrame:
        block = table(number)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, column in texts(batch, "text"):
                    found = pa.record_batch({"row": part.column("row"), "found": _judge(block.value, column)})
                    yield found.filter(pc.greater(pc.struct_field(found.column("found"), "n_hit"), 0))

        passed = own.select("row", "text").mapInArrow(judge, T.StructType([T.StructField("row", T.LongType()), T.StructField("found", OVERLAP)]))
        rows = stage(passed, "block-hits")
        block.unpersist()
        return rows

    merged = reduce(DataFrame.union, [hits(n) for n in numbers]).groupBy("row").agg(F.collect_list("found").alias("found"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in texts(batch, "text"):
                yield pa.record_batch({"own": part.column("own"), "overlap": _merge(column, part.column("found").to_pylist())})

    shape = T.StructType([own.schema["own"], T.StructField("overlap", OVERLAP)])
    return own.join(merged, "row", "left").select("text", "own", "found").mapInArrow(finish, shape) \
        .select(*(F.col(f"own.`{c}`").alias(c) for c in names), F.col("overlap").alias(out))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int = 20) -> DataFrame:
    """The rows of ``docs`` in which fewer than one word in ``share`` is hit, with their columns."""
    name = "overlap"
    while name in docs.columns:
        name += "_"
    marked = overlaps(docs, benchmark, text_col, out=name)
    clean = (F.col(f"{name}.n_hit") == 0) | (share * F.col(f"{name}.n_hit") < F.col(f"{name}.n_words"))
    return marked.where(clean).select(*(f"`{c}`" for c in docs.columns))
