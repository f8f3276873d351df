"""Token ids as one wavelet matrix per shard.

Documents are encoded, end id appended, and dealt to shards by ranges of doc_id (quantiles over all
documents), so that ascending shards hold ascending ids.  A shard becomes one row of the written
table: a wavelet matrix of its tokens, which is one bit-plane per bit of an id (highest bit first),
each with a rank directory, squeezed plane by plane, and its documents' ids and lengths.  Tokens
can be read by position, counted and located from that one row, a few planes' bits at a time, and
whole documents are read back by undoing the planes from the lowest to the highest.

Order and ties: rows with equal doc_id follow one another, by their ids' bytes within a shard; an id
that fills several shards is spread over them by its tokens' checksum.  A null doc_id comes first, a
null text is empty and gets the end id alone.  An empty table gives no shards.
"""
from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.llm import exchange
from strideframe.llm.exchange import expand, pack, squeeze, unpack
from strideframe.llm.store import texts
from strideframe.llm.tokens import KEPT, byte_letters, encode as library_encode, tokenizer, vocabulary_size

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Bytes of text in a shard, on average.
SHARD_BYTES = 16 << 20
#: Bits of a plane between two entries of its rank directory.
BLOCK = 512

SHARD = "shard int, n_docs long, n_tokens long, doc_ids binary, matrix binary"
#: Where null ids stand among others when shards are cut; what is written tells them apart.
_FIRST = np.iinfo(np.int64).min


class WaveletMatrix:
    """A sequence of unsigned integers as bit-planes with rank directories."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        now = values.astype(np.uint16 if bits <= 16 else np.uint32)
        for b in range(bits - 1, -1, -1):
            bit = (now >> b & 1).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            padded = np.zeros(-(-len(bit) // BLOCK) * BLOCK, bool)
            padded[:len(bit)] = bit
            ranks.append(np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1))]).astype(np.uint32))
            low = now[~bit]
            zeros.append(len(low))
            now = np.concatenate([low, now[bit]])
        return cls(len(values), planes, zeros, ranks)

    def _ones(self, k: int, i: int) -> int:
        """Set bits of plane k before position i."""
        block = i // BLOCK
        part = self.planes[k][block * BLOCK // 8:-(-i // 8)]
        return int(self.ranks[k][block]) + int(np.unpackbits(part, bitorder="little")[:i - block * BLOCK].sum())

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3] >> (i & 7) & 1)

    def access(self, i: int) -> int:
        """The value at position i."""
        value = 0
        for k in range(len(self.planes)):
            bit = self._bit(k, i)
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _interval(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``end`` stand below the last plane."""
        a, b, bits = 0, end, len(self.planes)
        for k in range(bits):
            ones_a, ones_b = self._ones(k, a), self._ones(k, b)
            if value >> (bits - 1 - k) & 1:
                a, b = self.zeros[k] + ones_a, self.zeros[k] + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def rank(self, value: int, end: int) -> int:
        """Occurrences of ``value`` before position ``end``."""
        a, b = self._interval(value, end)
        return b - a

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """The position of the j-th (from 0) set or clear bit of plane k."""
        counts = self.ranks[k].astype(np.int64)
        if not bit:
            counts = np.arange(len(counts)) * BLOCK - counts
        block = int(np.searchsorted(counts, j, "right")) - 1
        part = np.unpackbits(self.planes[k][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(part == bit)[j - counts[block]])

    def select(self, value: int, j: int) -> int:
        """The position of the j-th (from 0) occurrence of ``value``; -1 if there are fewer."""
        a, b = self._interval(value, self.n)
        if j >= b - a:
            return -1
        i, bits = a + j, len(self.planes)
        for k in range(bits - 1, -1, -1):
            bit = value >> (bits - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i

    def positions(self, value: int) -> np.ndarray:
        """The positions of all occurrences of ``value``, ascending: each plane is undone once for all of them."""
        a, b = self._interval(value, self.n)
        i, bits = np.arange(a, b), len(self.planes)
        for k in range(bits - 1, -1, -1):
            if not len(i):
                break
            bit = value >> (bits - 1 - k) & 1
            places = np.flatnonzero(np.unpackbits(self.planes[k], count=self.n, bitorder="little") == bit)
            i = places[i - self.zeros[k] if bit else i]
        return i

    def values(self) -> np.ndarray:
        """The whole sequence."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(now)
            above[~bit] = now[:self.zeros[k]]
            above[bit] = now[self.zeros[k]:] | now.dtype.type(1 << (len(self.planes) - 1 - k))
            now = above
        return now

    def to_bytes(self) -> bytes:
        parts = [np.frombuffer(squeeze(p.tobytes()), np.uint8) for p in (*self.planes, *self.ranks)]
        return pack(np.array([self.n], np.int64), np.array(self.zeros, np.int64), *parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        bits = (int(np.frombuffer(data, np.int64, 1)[0]) - 2) // 2
        n, zeros, *parts = unpack(data, np.int64, np.int64, *[np.uint8] * (2 * bits))
        parts = [expand(p.tobytes()) for p in parts]
        return cls(int(n[0]), [np.frombuffer(p, np.uint8) for p in parts[:bits]], zeros.tolist(),
                   [np.frombuffer(p, np.uint32) for p in parts[bits:]])


#: Letters that its normalizer leaves alone but for their case, and byte-level writes letter by letter.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class _Ids(dict):
    """unit between spaces or line breaks -> its ids' bytes.

    This tokenizer drops white space, so such units are encoded independently.  On a miss a full stop or
    comma after plain letters is taken off, as the tokenizer does, plain letters are lower-cased and go
    straight to the library's BPE model, and any other unit through the whole tokenizer.
    """

    def __init__(self, vocabulary: str, limit: int = 800_000):
        super().__init__({"": b""})
        self.vocabulary, self.limit = vocabulary, limit
        self.model = tokenizer(vocabulary).model
        self.bytes = {b: c for c, b in byte_letters().items()}

    def __missing__(self, unit: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
            self[""] = b""
        if _PLAIN.fullmatch(unit):
            low = unit.lower()
            if low != unit:
                value = self[low]
            else:
                text = low if low.isascii() else low.encode().decode("latin-1").translate(self.bytes)
                value = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        elif unit[-1] in ".," and _PLAIN.fullmatch(unit, 0, len(unit) - 1):
            value = self[unit[:-1]] + self[unit[-1]]
        else:
            value = array("I", library_encode(self.vocabulary, unit)).tobytes()
        if len(unit) <= KEPT:
            self[unit] = value
        return value


@lru_cache(maxsize=1)
def _ids(vocabulary: str) -> _Ids:
    return _Ids(vocabulary)


def _quantiles(docs: DataFrame, shard_bytes: int) -> list[int]:
    """The doc_ids that part the documents into shards of about ``shard_bytes``."""
    n, size = docs.select(F.count("*"), F.sum(F.octet_length("text"))).first()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(max(partitions, math.ceil((size or 0) / shard_bytes)), max(n, 1))
    if shards == 1:
        return []
    at = [k / shards for k in range(1, shards)]
    found = docs.select(F.percentile_approx("doc_id", at, max(10_000, 10 * shards))).first()[0]
    return found or []


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> str:
    """Encode ``docs`` and write their shards (SHARD) below ``path``."""
    docs = texts(docs, id_col, text_col)
    cuts = docs.sparkSession.sparkContext.broadcast(np.array(_quantiles(docs, shard_bytes), np.int64))
    bits = max(vocabulary_size(vocabulary) - 1, end_id).bit_length()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end, cut = _ids(vocabulary), np.array([end_id], "<u4").tobytes(), cuts.value
        for batch in batches:
            ids = [b"".join(map(cache.__getitem__, (t.as_py() or "").replace("\n", " ").split(" "))) + end
                   for t in batch.column("text")]
            doc = batch.column("doc_id").fill_null(_FIRST).to_numpy()
            low, high = np.searchsorted(cut, doc, "left"), np.searchsorted(cut, doc, "right")
            spread = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
            yield pa.record_batch({
                "shard": pa.array(low + spread % (high - low + 1), pa.int32()), "doc_id": batch.column("doc_id"),
                "ids": pa.array([np.frombuffer(i, "<u4").astype("<u2").tobytes() if bits <= 16 else i for i in ids], pa.binary())})

    width = 2 if bits <= 16 else 4

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), f"<u{width}")
            head = squeeze(pack(np.array([d or 0 for d in docs_], np.int64), np.array([d is None for d in docs_], bool),
                                np.array([len(i) // width for i in ids], np.int64)))
            return pa.record_batch({"shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(ids)]),
                                    "n_tokens": pa.array([len(values)]), "doc_ids": pa.array([head], pa.binary()),
                                    "matrix": pa.array([WaveletMatrix.build(values, bits).to_bytes()], pa.binary())})

        shard, docs_, ids = None, [], []
        for r in exchange.rows(batches):
            if r["shard"] != shard and ids:
                yield row()
                docs_, ids = [], []
            shard = r["shard"]
            docs_.append(r["doc_id"])
            ids.append(r["ids"])
        if ids:
            yield row()

    (docs.mapInArrow(encode, "shard int, doc_id long, ids binary")
         .repartition(len(cuts.value) + 1, "shard").sortWithinPartitions("shard", "doc_id", "ids")
         .mapInArrow(build, SHARD).write.option("compression", "none").parquet(path))
    return path


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The written shards."""
    return spark.read.schema(SHARD).parquet(path)


def shard_starts(files: DataFrame, block: int = 4096) -> DataFrame:
    """shard, start: running sums within blocks of shards, and over the blocks' sums."""
    sizes = files.select("shard", "n_tokens", F.floor(F.col("shard") / block).alias("block"))
    blocks = sizes.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("shard")) - F.col("n_tokens")
    return sizes.withColumn("inside", inside).join(before, "block").select(
        "shard", (F.col("inside") + F.col("before")).cast("long").alias("start"))


def read_documents(files: DataFrame) -> DataFrame:
    """shard, doc_id, offset (tokens before it in its shard), n_tokens, ids (binary: little-endian unsigned
    32-bit) of every document, from the wavelet matrices alone."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in exchange.rows(batches):
            doc_ids, missing, sizes = unpack(expand(r["doc_ids"]), np.int64, bool, np.int64)
            values = WaveletMatrix.from_bytes(r["matrix"]).values()
            ends = np.cumsum(sizes)
            for a in range(0, len(sizes), 500):
                own = slice(a, a + 500)
                yield pa.record_batch({
                    "shard": pa.array([r["shard"]] * len(sizes[own]), pa.int32()),
                    "doc_id": pa.array(doc_ids[own], pa.int64(), mask=missing[own]),
                    "offset": pa.array((ends - sizes)[own]), "n_tokens": pa.array(sizes[own]),
                    "ids": pa.array([values[e - n:e].astype("<u4").tobytes() for e, n in zip(ends[own], sizes[own])], pa.binary())})

    return files.select("shard", "doc_ids", "matrix").mapInArrow(read, "shard int, doc_id long, offset long, n_tokens long, ids binary")


def occurrences(files: DataFrame, token: int, most: int | None = None) -> DataFrame:
    """shard, n (how often ``token`` is in it), positions (of the first ``most`` ones, or of all)."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in exchange.rows(batches):
            m = WaveletMatrix.from_bytes(r["matrix"])
            at = m.positions(token)
            yield pa.record_batch({"shard": pa.array([r["shard"]], pa.int32()), "n": pa.array([len(at)]),
                                   "positions": pa.array([at[:most]], pa.list_(pa.int64()))})

    return files.select("shard", "matrix").mapInArrow(look, "shard int, n long, positions array<long>")
