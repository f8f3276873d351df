"""SimHash near-dedup with multi-index hashing.

A text's words, lower-cased in A-Z, make shingles; a bit of the fingerprint is the majority of that bit
of the shingles' XXH64.  Two fingerprints with at most ``bits`` differing bits, parted into segments of
the same bits, differ in at most bits // segments bits of one segment.  Each distinct fingerprint is
entered once per segment into a table; it then enumerates the small Hamming ball around each of its
segments, fetches the entries found there and keeps those whose complete distance is small enough.
Links between distinct fingerprints are joined to components; copies and other texts of one fingerprint
are one entry, however many there are.

Texts without words, null ones too, have the fingerprint zero and are linked like others.  A null
doc_id is no component's smallest id unless there's none other.  Every row gets a result row.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.components import components
from strideframe.llm.store import stage, texts

SHINGLE = 3
BITS = 3
SEGMENTS = 2
SEED = 42

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_VALUE_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    # bytes.split() parts at 0x20 and 0x09-0x0D, just what separates words here
    w = text.encode().translate(_LOWER).split()
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[k:] for k in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8").view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _VALUE_BITS for k in range(8)])
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h (the text's hash), fp (the fingerprint's bits as a long) of each row of (doc_id, text)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "fp": pa.array(fps.view(np.int64))})

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(of, "doc_id long, h long, fp long")


def _segment(fp: Column, k: int, segments: int) -> Column:
    low, high = 64 * k // segments, 64 * (k + 1) // segments
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def links(distinct: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """u > v: distinct fingerprints (column fp) with at most ``bits`` differing bits."""
    fp = F.col("fp")
    entries, probes = [], []
    for k in range(segments):
        width = 64 * (k + 1) // segments - 64 * k // segments
        ball = [sum(1 << b for b in flips) for r in range(bits // segments + 1) for flips in combinations(range(width), r)]
        key = _segment(fp, k, segments)
        entries.append(F.struct(F.lit(k).alias("segment"), key.alias("key")))
        probes.append(F.array(*(F.struct(F.lit(k).alias("segment"), key.bitwiseXOR(F.lit(m)).alias("key")) for m in ball)))
    table = distinct.select(fp.alias("v"), F.explode(F.array(*entries)).alias("e")).select("v", "e.*")
    asked = distinct.select(fp.alias("u"), F.explode(F.concat(*probes)).alias("e")).select("u", "e.*")
    return asked.join(table, ["segment", "key"]) \
        .where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, h, fp, root (the smallest fingerprint of the component) and component_id of each row."""
    found = stage(fingerprints(texts(docs, id_col, text_col), shingle), "fingerprints")
    distinct = stage(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-table")
    rooted = components(links(distinct.select("fp"), bits, segments)).withColumnRenamed("u", "fp")
    root = distinct.join(rooted, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = root.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(root.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "h", "fp", "root", "component_id")


def keep_smallest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """The rows of ``docs``, with their columns, that have their component's smallest id.  Where several texts
    have that id the one with the smallest hash stays; rows that repeat id and text stay or go together.  A row
    without an id stays only where its component has no id at all."""
    def key(id_: Column) -> list[Column]:
        return [id_.isNull(), F.coalesce(id_, F.lit(0))]

    groups = near_duplicates(docs, id_col, text_col, shingle, bits, segments)
    kept = groups.groupBy("root").agg(F.min(F.struct(*key(F.col("doc_id")), "h")).alias("k")) \
                 .select(F.col("k.col1").alias("_none"), F.col("k.col2").alias("_id"), F.col("k.h").alias("_h"))
    none, id_ = key(F.col(f"`{id_col}`").cast("bigint"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), none.alias("_none"), id_.alias("_id"),
                      F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_h"))
    return own.join(kept, ["_none", "_id", "_h"], "left_semi").select("own.*")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
