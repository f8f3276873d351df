"""BPE encoding through a table of distinct words, and decoding through an id-to-piece table.

Encoding: documents are cut into words (units between single spaces, less line breaks and a closing comma
or full stop, which byte-level BPE encodes independently) and gathered in chunks; a chunk keeps each word position as a code into its list of
distinct words and is written once.  The chunks send their distinct words, packed by hash bucket, to
the word table, where each distinct word of a bucket is encoded once, by the tokenizers library; the
ids go back to the chunks and are joined to the positions by code.  A frequent word costs one entry
a chunk, not one an occurrence, so no key is hot; nothing is broadcast.

Decoding: each id is looked up in the id-to-piece table, which is bounded by the vocabulary, and a
document's pieces are joined; malformed UTF-8 becomes U+FFFD, as in the library.

A null text counts as empty: no ids, decoded as "".  Every input row gets its own result row.
"""
from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.llm import exchange
from strideframe.llm.exchange import expand, pack, squeeze, unpack
from strideframe.llm.store import stage, texts
from strideframe.llm.tokens import (
    KEPT, byte_letters, encode as library_encode, space_units, tokenizer, unit_parts, vocabulary_size)

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text in a chunk; one document may be longer and then is a chunk of its own.
CHUNK_BYTES = 32 << 20
#: How hard bodies, words and ids are squeezed: disk is what this operator is short of.
LEVEL = 9
CHUNK = "chunk long, body binary, words array<struct<bucket: int, payload: binary>>"
ENCODED = "doc_id long, n_tokens long, ids binary"
#: Words are listed without the space before them; this, which no text holds, marks a text's first one.
_FIRST = "\udcff"


class _Codes(dict):
    """word -> its number in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class _Units(dict):
    """unit between spaces -> the codes of its words, as bytes; emptied when there are ``limit``."""

    def __init__(self, codes: _Codes, limit: int = 50_000):
        super().__init__()
        self.codes, self.limit = codes, limit

    def first(self, unit: str) -> bytes:
        return array("I", [self.codes[_FIRST + p] for p, _ in unit_parts(unit) if p]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        value = array("I", [self.codes[p if behind else _FIRST + p] for p, behind in unit_parts(unit)]).tobytes()
        if len(unit) <= KEPT:
            self[unit] = value
        return value


def _planes(values: np.ndarray, count: int) -> list[np.ndarray]:
    """The lowest ``count`` bytes of each value, byte by byte: they squeeze better so."""
    return [(values >> (8 * k)).astype(np.uint8) for k in range(count)]


def _whole(planes: list[np.ndarray]) -> np.ndarray:
    return sum(p.astype(np.int64) << (8 * k) for k, p in enumerate(planes))


def _listed(words: list[bytes]) -> bytes:
    return squeeze(pack(*_planes(np.array([len(w) for w in words], np.int64), 4), np.frombuffer(b"".join(words), np.uint8)), LEVEL)


def _words(data: bytes) -> list[bytes]:
    *sizes, text = unpack(expand(data), *[np.uint8] * 5)
    text, ends = text.tobytes(), np.cumsum(_whole(sizes)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _by_frequency(counts: np.ndarray) -> np.ndarray:
    """The words' places, frequent words first: a body writes these ranks, small numbers mostly."""
    return np.argsort(-counts, kind="stable")


def _chunk(number: int, ids: list, codes: list[np.ndarray], words: list[str], buckets: int) -> pa.RecordBatch:
    """The chunk's body (ids, words per document, the words' ranks, and their counts by place) and its distinct
    words by place: the order of (bucket, word)."""
    data = [w.encode("utf-8", "surrogateescape") for w in words]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in data), np.int64, len(data))
    order = np.array(sorted(range(len(data)), key=data.__getitem__), np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    places = np.empty(len(words), np.uint32)
    places[order] = np.arange(len(words))
    places = places[np.concatenate(codes)]
    counts = np.bincount(places, minlength=len(words))
    rank = np.empty(len(words), np.uint32)
    rank[_by_frequency(counts)] = np.arange(len(words))
    body = pack(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], bool), np.array([len(c) for c in codes], np.int64),
                *_planes(counts, 4), *_planes(rank[places], 4))
    sent = [b for b in range(buckets) if starts[b + 1] > starts[b]]
    return pa.record_batch({
        "chunk": pa.array([number], pa.int64()), "body": pa.array([squeeze(body, LEVEL)], pa.binary()),
        "words": pa.array([[{"bucket": b, "payload": _listed([data[i] for i in order[starts[b]:starts[b + 1]]])} for b in sent]],
                          pa.list_(pa.struct([("bucket", pa.int32()), ("payload", pa.binary())])))})


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int, buckets: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    code, ids, codes, size = _Codes(), [], [], 0
    units = _Units(code)

    def finished() -> pa.RecordBatch:
        words = list(code)
        code.clear()
        units.clear()
        return _chunk((part << 32) + seq, ids, codes, words, buckets)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            text = text.as_py() or ""
            if ids and size + len(text) > chunk_bytes:
                yield finished()
                seq, ids, codes, size = seq + 1, [], [], 0
            first, *rest = space_units(text)
            ids.append(doc_id.as_py())
            codes.append(np.frombuffer(units.first(first) + b"".join(map(units.__getitem__, rest)), np.uint32))
            size += len(text)
    if ids:
        yield finished()


def _word_table(vocabulary: str):
    """Encode each distinct word of a bucket once."""
    def answer(payloads: list[bytes]) -> list[bytes]:
        known, replies = {}, []
        for payload in payloads:
            found = []
            for word in _words(payload):
                if (value := known.get(word)) is None:
                    text = word.decode("utf-8", "surrogateescape")
                    text = text[1:] if text[:1] == _FIRST else " " + text
                    known[word] = value = array("I", library_encode(vocabulary, text)).tobytes()
                found.append(value)
            sizes = np.array([len(v) // 4 for v in found], np.int64)
            replies.append(squeeze(pack(*_planes(sizes, 4), *_planes(np.frombuffer(b"".join(found), np.uint32), 4)), LEVEL))
        return replies
    return answer


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the words' ids to their positions."""
    for row in exchange.rows(batches):
        replies = [unpack(expand(r["reply"]), *[np.uint8] * 8) for r in sorted(row["replies"] or [], key=lambda r: r["bucket"])]
        size = np.concatenate([np.zeros(0, np.int64), *(_whole(r[:4]) for r in replies)])
        value = np.concatenate([np.zeros(0, np.uint32), *(_whole(r[4:]).astype(np.uint32) for r in replies)])
        table = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(value))
        doc_ids, missing, n_words, *planes = unpack(expand(row["body"]), np.int64, bool, np.int64, *[np.uint8] * 8)
        place, ends, a = _by_frequency(_whole(planes[:4])), np.cumsum(n_words), 0
        while a < len(doc_ids):  # a few documents at a time
            low = ends[a] - n_words[a]
            b = max(a + 1, int(np.searchsorted(ends, low + 200_000, "right")))
            where = place[_whole([p[low:ends[b - 1]] for p in planes[4:]])]
            flat = table.take(pa.array(where)).flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            n = np.concatenate([[0], np.cumsum(size[where])])[np.concatenate([[low], ends[a:b]]) - low]
            yield pa.record_batch({
                "doc_id": pa.array(doc_ids[a:b], pa.int64(), mask=missing[a:b]),
                "n_tokens": pa.array(np.diff(n), pa.int64()),
                "ids": pa.array([flat[4 * s:4 * e] for s, e in zip(n[:-1], n[1:])], pa.binary())})
            a = b
        pa.default_memory_pool().release_unused()


def _encoded(docs: DataFrame, vocabulary: str, chunk_bytes: int) -> DataFrame:
    """The chunks' bodies with the replies of the word table."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = exchange.bucket_count(docs.sparkSession, size)
    chunks = stage(docs.mapInArrow(lambda b: _chunks(b, chunk_bytes, buckets), CHUNK), "bpe-chunks", compression="none")
    messages = chunks.select("chunk", F.inline("words"))
    replies = exchange.ask(messages, _word_table(vocabulary))
    return exchange.with_replies(chunks.select("chunk", "body"), replies)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) of each row."""
    return _encoded(texts(docs, id_col, text_col), vocabulary, chunk_bytes).mapInArrow(_joined, ENCODED)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """decode(encode(docs)), both joins in one Python worker a task."""
    pieces_join = _pieces_join(docs.sparkSession, vocabulary)
    return _encoded(texts(docs, id_col, text_col), vocabulary, chunk_bytes) \
        .mapInArrow(lambda b: pieces_join(_joined(b)), f"{ENCODED}, text string")


def pieces(vocabulary: str = VOCABULARY) -> list[bytes]:
    """id -> the bytes of its piece."""
    t = tokenizer(vocabulary)
    byte, out = byte_letters(), []
    for i in range(vocabulary_size(vocabulary)):
        token = t.id_to_token(i) or ""
        out.append(bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode())
    return out


def _pieces_join(spark: SparkSession, vocabulary: str):
    """Batches with ids -> the same with their text."""
    table = spark.sparkContext.broadcast(pieces(vocabulary))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.array(table.value, pa.large_binary())
        size = np.array([len(p) for p in table.value], np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch, decoded = whole.slice(a, 500), []
                for ids in batch.column("ids"):
                    ids = np.frombuffer(ids.as_py() or b"", "<u4")
                    # .buffers()[2]: the pieces' bytes, one behind the other
                    data = piece.take(pa.array(ids)).buffers()[2]
                    decoded.append(bytes(data)[:int(size[ids].sum())].decode("utf-8", "replace") if len(ids) and data else "")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], [*batch.schema.names, "text"])

    return join


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the column text."""
    schema = T.StructType([*encoded.schema, T.StructField("text", T.StringType())])
    return encoded.mapInArrow(_pieces_join(encoded.sparkSession, vocabulary), schema)
