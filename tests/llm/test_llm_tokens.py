"""Token counts, BPE, wavelet shards, against the tokenizers library itself."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideframe.llm import bpe, token_counts, wavelet
from strideframe.llm.store import new_path

ODD = ["", None, " ", "  ", "a  b", "a \n b", " a", "a ", "\n", "a\n\nb", "x.\nY z,\n", "<|endoftext|>", "a <|EndOfText|> b", "a<|endoftext|>.\nq",
       "a<|startoftext|>.\nq", "..., a., b.,", "éa, ß. x y  z  w", "x \x1c y \x1d", "İı ΑΣ ΑΣ. Σ", "it's we'll I'M x's, y't.\nz're",
       "日本 語。テスト", "😀 😀😀, a😀.", "a\r\nb \r\n c", "word " * 3000, "á b́, ́x", "\0x \0y", "x​ ​y", "1,2 3.4 5.", "A,.B ,.", "K Å ﬁ"]
ODD += ["\n".join(f"w{i}," for i in range(5000)), "x" * 3000 + " " + "y," * 2000, "a.\nb\n\nc\n d \ne.,\n"]
ODD += [f"x {chr(c)}y z{chr(c)} {chr(c)}, a{chr(c)}.\n{chr(c)}q" for c in (*range(0x180), *range(0x2000, 0x2010), 0x85, 0x1680, 0x180E, 0x2028, 0x3000, 0xFEFF)]


@pytest.fixture(scope="module")
def library():
    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in (bpe.VOCABULARY, wavelet.VOCABULARY)}


def test_counts(frame, library, small):
    docs = [*enumerate(ODD), *((1000 + i, x) for i, x in small), (None, "a b"), (0, "twice")]
    for hot in (5, 50_000):
        got = token_counts.token_counts(frame(docs), hot=hot).collect()
        want = [(i, len((x or "").encode()), len(library[bpe.VOCABULARY].encode(x or "", add_special_tokens=False).ids)) for i, x in docs]
        assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(str, want))
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.token_counts(frame(docs).where("false")).count() == 0


@pytest.mark.parametrize("chunk", [100, 32 << 20])
def test_bpe_round_trip(frame, library, small, chunk):
    t = library[bpe.VOCABULARY]
    docs = [*enumerate(ODD), *((1000 + i, x) for i, x in small[:60]), (None, "a b")]
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(docs), chunk_bytes=chunk)).collect()}
    assert {r.doc_id: r for r in bpe.round_trip(frame(docs), chunk_bytes=chunk).collect()} == got
    for i, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert bytes(got[i].ids) == np.array(ids, "<u4").tobytes() and got[i].n_tokens == len(ids)
        assert got[i].text == t.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(frame(docs).where("false"))).count() == 0


def test_decoding_any_ids(spark, library):
    rng = np.random.default_rng(0)
    rows = [(i, 20, bytearray(rng.integers(0, 50257, 20).astype("<u4").tobytes())) for i in range(200)] + [(200, 0, bytearray())]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary"))
    for r in got.collect():
        assert r.text == library[bpe.VOCABULARY].decode(np.frombuffer(bytes(r.ids), "<u4").tolist(), skip_special_tokens=False)


def test_wavelet_shards(spark, frame, library, small):
    docs = [*enumerate(ODD), *((1000 + i, x) for i, x in small[:80])]
    files = wavelet.shards(spark, wavelet.write_shards(frame(docs), new_path(spark, "test-shards"), shard_bytes=2000))
    read = wavelet.read_documents(files).join(wavelet.shard_starts(files, block=3), "shard")
    got = {r.doc_id: r for r in read.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", F.crc32("ids").alias("crc")).collect()}
    at, total = 0, 0
    for i, x in sorted(docs):
        ids = [*library[wavelet.VOCABULARY].encode(x or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at, total = at + len(ids), total + ids.count(267)
    found = wavelet.occurrences(files, 267).collect()
    assert sum(r.n for r in found) == total and all(len(r.positions) == r.n for r in found)


def test_wavelet_ties_nulls_and_empty(spark, frame):
    docs = [(5, f"t{k}") for k in range(40)] + [(None, "no id"), (4, None), (6, "last")]
    files = wavelet.shards(spark, wavelet.write_shards(frame(docs), new_path(spark, "test-shards"), shard_bytes=20))
    read = wavelet.read_documents(files).join(wavelet.shard_starts(files), "shard").withColumn("at", F.col("start") + F.col("offset"))
    assert [r.doc_id for r in read.orderBy("at").collect()] == [None, 4, *[5] * 40, 6]
    none = wavelet.shards(spark, wavelet.write_shards(frame(docs).where("false"), new_path(spark, "test-shards")))
    assert wavelet.read_documents(none).count() == 0


def test_wavelet_matrix():
    values = np.random.default_rng(0).integers(0, 1000, 5000)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(values, 10).to_bytes())
    assert (m.values() == values).all() and all(m.access(i) == values[i] for i in range(0, 5000, 37))
    for v in (0, 5, 999):
        at = np.flatnonzero(values == v)
        assert m.rank(v, 5000) == len(at) and m.rank(v, 2500) == (at < 2500).sum()
        assert [m.select(v, j) for j in range(len(at))] == at.tolist() and m.select(v, len(at)) == -1
        assert m.positions(v).tolist() == at.tolist()


def test_ids_at_the_edge(spark, frame):
    """The smallest and the largest id and no id are three."""
    docs = [(-(1 << 63), "a b"), ((1 << 63) - 1, "c d"), (None, "e f"), (0, "g")]
    assert sorted((str(r.doc_id), r.text) for r in bpe.round_trip(frame(docs)).collect()) == sorted((str(i), x) for i, x in docs)
    files = wavelet.shards(spark, wavelet.write_shards(frame(docs), new_path(spark, "test-shards")))
    assert sorted(str(r.doc_id) for r in wavelet.read_documents(files).collect()) == sorted(str(i) for i, _ in docs)


def test_long_units_stay_out_of_the_table(frame):
    docs = frame([(i, "x " + "y" * 5000 + " z") for i in range(50)])
    assert token_counts.frequent_units(docs, 10, 10) == ["z"]
