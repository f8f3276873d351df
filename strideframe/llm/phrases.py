"""Phrase collocation mining by Toivonen's scheme: a sample proposes, full passes count exactly until closed.

A phrase is a run of ``2..max_words`` words inside a piece (texts part at punctuation and line breaks) of one
language; it is frequent with ``min_count`` occurrences or more, and so are then all its parts.

1. Texts are tokenised once and staged as chunks of word numbers; words are counted exactly.
2. A sample of the chunks proposes phrases at a lowered threshold.
3. A full pass counts the proposed phrases and their negative border: every run whose two parts (all but the last,
   all but the first word) are both proposed, whether it is proposed itself or not.  Other runs aren't counted.
4. A phrase of the border that turns out frequent is a failure: its own extensions weren't counted.  A further pass
   proposes all phrases known to be frequent and counts what no earlier pass has counted; it ends when every
   frequent phrase was proposed in the last pass, so the sample bears on the work and never on the result.

Proposals reach the tasks as bit arrays of at most FILTER_BITS bits (16 MB), sized by the proposals below that.  A false
positive only has a run counted that needn't be; beyond the bound there are more of these and results stay exact.
Words are carried as 64-bit hashes seeded by their language; all words are checked for two with one hash, and the next
seed is taken if there are any, so phrases, as sequences of such words, are exact.

Counts leave a task summed per chunk, and Spark sums them with partial aggregation: a frequent word or phrase is a
row per task.  Joins that look parts up by word are salted.

Null or empty texts have no words, a null language is ``und``.  Repeated rows count each; row ids play no part.  Equal
scores and counts are ranked by the phrase's UTF-8 bytes.  An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.chunks import dump, parsed
from strideframe.llm.exchange import expand, rows, squeeze
from strideframe.llm.sequences import mix, portions, utf8
from strideframe.llm.store import ship, stage

MAX_WORDS, MIN_COUNT, TOP = 3, 10, 2000
#: Share of the chunks that propose phrases, and the least count there.
SHARE, SAMPLE_COUNT = 1 / 16, 2
#: Bits for each proposal, and of all at most: what tasks get has a bound however many phrases there are.
BITS_EACH, FILTER_BITS = 16, 1 << 27
#: Bytes of text in a chunk.  A longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Copies of the looked-up side of a join, so that a word in a third of all phrases is dealt to several tasks.
SALTS = 8
UNKNOWN = "und"

# fixed values: what ends a piece, and what parts words within one
_PIECE = np.zeros(256, bool)
_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_PIECE
_WORD[[0x20, 0x09]] = False
_LOWER = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _chunk(langs: pa.Array, texts: pa.Array):
    """The distinct (lang, word) of some texts, their counts, and the texts as word numbers from 1, 0 where a piece ends."""
    lang = langs.dictionary_encode()
    data, offsets = utf8(pc.binary_join_element_wise(texts.cast(pa.large_string()).fill_null(""), *(pa.scalar(x, pa.large_string()) for x in ("", "\n"))))
    data = _LOWER[data]
    inside = np.concatenate([[False], _WORD[data], [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(start):
        return None
    ends = np.concatenate([[0], np.cumsum(end - start)])
    word = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside[1:-1]].tobytes())]) \
        .dictionary_encode()
    code = lang.indices.to_numpy()[np.searchsorted(offsets, start, "right") - 1].astype(np.int64)
    pair, number, count = np.unique(word.indices.to_numpy().astype(np.int64) * len(lang.dictionary) + code, return_inverse=True, return_counts=True)
    piece = np.cumsum(_PIECE[data])[start]
    place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    numbers = np.zeros(place[-1] + 1, np.uint32)
    numbers[place] = number + 1
    # a lower-cased text is as valid as the text was
    words = pa.record_batch({"lang": lang.dictionary.take(pa.array(pair % len(lang.dictionary))).cast(pa.string()),
                             "word": word.dictionary.take(pa.array(pair // len(lang.dictionary))).cast(pa.large_string()),
                             "n": pa.array(count.astype(np.int64))})
    return words, numbers


def _tokenised(docs: DataFrame, lang_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """chunk, words (Arrow: lang, word, n), numbers (squeezed)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in portions(batch.column("text"), chunk_bytes):
                found = _chunk(batch.column("lang").slice(a, b - a), batch.column("text").slice(a, b - a))
                if found:
                    yield pa.record_batch({"chunk": pa.array([number], pa.int64()), "words": pa.array([dump(found[0])], pa.binary()),
                                           "numbers": pa.array([squeeze(found[1].tobytes())], pa.binary())})
                    number += 1

    ship(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                      F.col(f"`{text_col}`").cast("string").alias("text"))
    return stage(own.mapInArrow(of, "chunk long, words binary, numbers binary"), "phrase-chunks", compression="none")


def _word_hashes(words: pa.RecordBatch, seed: int) -> np.ndarray:
    langs = words.column("lang").dictionary_encode()
    seeds = [xxhash.xxh64_intdigest(x.as_py(), seed) for x in langs.dictionary]
    own = [seeds[k] for k in langs.indices.to_pylist()]
    return np.fromiter((xxhash.xxh64_intdigest(w, s) for w, s in zip(words.column("word").to_pylist(), own)), np.uint64, len(own))


def _counted_words(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(h, lang, word, n) of every word, and the seed of the hashes, of which no two words share one."""
    for seed in range(8):
        def of(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for row in rows(batches):
                words = parsed(row["words"])
                h = _word_hashes(words, seed).view(np.int64)
                yield pa.record_batch({"h": pa.array(h), "lang": words.column("lang"),
                                       "word": words.column("word").cast(pa.string()), "n": words.column("n")})

        found = chunks.select("words").mapInArrow(of, "h long, lang string, word string, n long")
        words = stage(found.groupBy("h", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("h").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("words share hashes under every seed")


class Filter:
    """A set of phrases of one length as a bit array; members are always admitted, others seldom."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return (keys & np.uint64(size - 1)).astype(np.int64), (keys >> np.uint64(37) & np.uint64(size - 1)).astype(np.int64)

    def admits(self, keys: np.ndarray) -> np.ndarray:
        size = 8 * len(self.bits)
        return np.logical_and(*((self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1) > 0 for p in self._places(keys, size)))

    @classmethod
    def of(cls, members: DataFrame, length: int) -> "Filter":
        """Of ``members`` with columns h1..h<length>; each task sets bits, Spark joins them."""
        # two places of 27 bits each come from one 64-bit key
        size = 1 << min(max(int(members.count() * BITS_EACH).bit_length(), 13), FILTER_BITS.bit_length() - 1)
        names = [f"h{k + 1}" for k in range(length)]

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size // 8, np.uint8)
            for batch in batches:
                keys = gram_keys(*(batch.column(n).to_numpy().view(np.uint64) for n in names))
                for p in cls._places(keys, size):
                    np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
            whole = bits.view(np.int64)
            at = np.flatnonzero(whole)
            yield pa.record_batch({"at": pa.array(at, pa.int64()), "bits": pa.array(whole[at])})

        found = members.select(*names).mapInArrow(of, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
        whole = np.zeros(size // 64, np.int64)
        whole[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        return cls(whole.view(np.uint8))


def gram_keys(*hashes: np.ndarray) -> np.ndarray:
    """One number for each sequence of word hashes."""
    return mix(reduce(lambda a, b: (a ^ (a >> np.uint64(31))) * _STEP + b, hashes))


def count_grams(numbers: np.ndarray, hashes: np.ndarray, filters: list[list[Filter]], max_words: int):
    """The runs of 2..max_words words that the last of ``filters`` has counted and no earlier one: for each
    length an array (distinct runs x length) of word hashes and their counts.

    ``filters[p][k]`` holds what pass p proposes of length k + 1.  A run is counted in a pass that proposes both
    its parts and has counted them.
    """
    last = 1 << (len(filters) - 1)
    run = numbers.astype(np.int64) - 1  # the number of the run that begins at each place, or -1
    words, grams = hashes[:, None], np.arange(len(hashes))[:, None]
    passes = np.full(len(hashes), 2 * last - 1, np.uint8)  # the passes that counted each distinct run
    for length in range(2, max_words + 1):
        keys = gram_keys(*(words[grams[:, k], 0] for k in range(length - 1)))
        proposed = sum((f[length - 2].admits(keys).astype(np.uint8) << np.uint8(p) for p, f in enumerate(filters)), np.uint8(0))
        open_to = np.append(passes & proposed, np.uint8(0))  # the last entry is that of run -1
        both = open_to[run[:-1]] & open_to[run[1:]]
        at = np.flatnonzero(both)
        key, first, index, count = np.unique(run[at] * np.int64(max(len(grams), 1)) + run[at + 1], return_index=True, return_inverse=True, return_counts=True)
        run = np.full(len(run) - 1 if len(run) else 0, -1)
        grams_of = key // max(len(grams), 1), key % max(len(grams), 1)
        passes = both[at[first]] if len(at) else np.zeros(0, np.uint8)
        grams = np.column_stack([grams[grams_of[0]], grams[grams_of[1], -1]])
        run[at] = index
        new = np.flatnonzero((passes & np.uint8(last)).astype(bool) & ((passes & np.uint8(last - 1)) == 0))
        yield length, words[grams[new], 0], count[new]


def _counts(chunks: DataFrame, seed: int, filters: list[list[Filter]], max_words: int) -> DataFrame:
    """h1..h<max_words> (null behind the phrase's end), n: the runs that the last pass of ``filters`` counts, summed."""
    names = [f"h{k + 1}" for k in range(max_words)]
    shared = chunks.sparkSession.sparkContext.broadcast([[f.bits for f in p] for p in filters])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [[Filter(b) for b in p] for p in shared.value]
        for row in rows(batches):
            hashes = _word_hashes(parsed(row["words"]), seed)
            numbers = np.frombuffer(expand(row["numbers"]), np.uint32)
            for length, found, count in count_grams(numbers, hashes, own, max_words):
                for a in range(0, len(found), 1 << 18):
                    part = np.ascontiguousarray(found[a:a + (1 << 18)].T).view(np.int64)
                    columns = [pa.array(part[k]) if k < length else pa.nulls(part.shape[1], pa.int64()) for k in range(max_words)]
                    yield pa.record_batch(dict(zip(names, columns)) | {"n": pa.array(count[a:a + (1 << 18)].astype(np.int64))})

    schema = ", ".join(f"{n} long" for n in names) + ", n long"
    return chunks.select("words", "numbers").mapInArrow(of, schema).groupBy(*names).agg(F.sum("n").alias("n"))


def _of_length(grams: DataFrame, length: int, max_words: int) -> DataFrame:
    found = grams.where(F.col(f"h{length}").isNotNull())
    return found.where(F.col(f"h{length + 1}").isNull()) if length < max_words else found


def frequent_phrases(chunks: DataFrame, words: DataFrame, seed: int, max_words: int, min_count: int, share: float) -> DataFrame:
    """h1..h<max_words>, n of all phrases with ``min_count`` occurrences or more."""
    known = words.where(F.col("n") >= min_count).select(F.col("h").alias("h1"))
    single = Filter.of(known, 1)
    proposals = [single]
    sample = chunks.sample(share, 11)
    low = max(SAMPLE_COUNT, int(min_count * share / 2))
    for length in range(2, max_words):
        # the sample is mined level by level, each level from the one below
        mined = _counts(sample, seed, [proposals], length).where(F.col("n") >= low)
        proposals = [*proposals, Filter.of(stage(_of_length(mined, length, length), "proposed"), length)]
    passes, found = [proposals], None
    while True:
        new = stage(_counts(chunks, seed, passes, max_words).where(F.col("n") >= min_count), "phrase-counts")
        found = new if found is None else found.union(new)
        lengths = [(k, _of_length(found, k, max_words)) for k in range(2, max_words)]
        if not any(_failed(grams, passes[-1][k - 1], k) for k, grams in lengths):
            return found
        passes.append([single, *(Filter.of(grams, k) for k, grams in lengths)])


def _failed(grams: DataFrame, proposed: Filter, length: int) -> bool:
    """Whether any of ``grams`` wasn't proposed."""
    names = [f"h{k + 1}" for k in range(length)]
    shared = grams.sparkSession.sparkContext.broadcast(proposed.bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(shared.value)
        for batch in batches:
            missing = ~own.admits(gram_keys(*(batch.column(n).to_numpy().view(np.uint64) for n in names)))
            if missing.any():
                yield pa.record_batch({"n": pa.array([int(missing.sum())], pa.int64())})

    return not grams.select(*names).mapInArrow(of, "n long").isEmpty()


def _looked_up(asked: DataFrame, table: DataFrame, key: str, salt_by: str) -> DataFrame:
    """``asked`` joined with ``table`` (left) on ``key``, which may hold one value in a third of all rows."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return asked.withColumn("salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], "left").drop("salt")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits; it is 1000000 at most."""
    a, left, right = (x.cast("decimal(38,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1000000).cast("decimal(38,0)") * a * a, left * right)


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS,
            min_count: int = MIN_COUNT, cover: int = 50, share: float = SHARE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """lang, phrase, a (occurrences), l, r (of the two parts of its weakest cut), n (words of the language), score:
    all frequent phrases but those that a longer one with ``cover`` per cent of their occurrences contains."""
    if not 2 <= max_words <= 8:
        raise ValueError("phrases have 2 to 8 words")
    chunks = _tokenised(docs, lang_col, text_col, chunk_bytes)
    words, seed = _counted_words(chunks)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    grams = frequent_phrases(chunks, words, seed, max_words, min_count, share)
    names = [f"h{k + 1}" for k in range(max_words)]
    found = stage(grams.select(F.array_compact(F.array(*names)).alias("ws"), F.col("n").alias("a")), "phrases")

    frequent = words.where(F.col("n") >= min_count)
    parts = frequent.select(F.array("h").alias("part"), F.col("n").alias("f")).union(found.select(F.col("ws").alias("part"), F.col("a").alias("f")))
    size = F.size("ws")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    left = _looked_up(cuts.withColumn("part", F.slice("ws", F.lit(1), F.col("k"))), parts.withColumnRenamed("f", "l"), "part", "ws").drop("part")
    both = _looked_up(left.withColumn("part", F.slice("ws", F.col("k") + 1, size - F.col("k"))), parts.withColumnRenamed("f", "r"), "part", "ws").drop("part")
    cut = both.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    weakest = cut.groupBy("ws", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # a longer phrase that contains another contains one with just one word more, which is as frequent or more
    inner = found.where(size > 2).select(F.explode(F.array(F.slice("ws", F.lit(1), size - 1), F.slice("ws", F.lit(2), size - 1))).alias("ws"), "a") \
                 .groupBy("ws").agg(F.max("a").alias("longer"))
    kept = weakest.join(inner, "ws", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")

    # ``ws`` names a phrase within all languages, for words of two languages have different hashes
    spelt = _looked_up(kept.select("ws", F.posexplode("ws").alias("at", "h")), frequent.select("h", "lang", "word"), "h", "ws") \
        .groupBy("ws").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = kept.join(spelt, "ws").join(total, "lang")
    return named.select("lang", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase"), "a",
                        F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and spelling, with their rank from 1.  A language's
    rows are first thinned in as many parts as there are shuffle partitions, so no task orders them all."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    thin = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    return thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top) \
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
