"""Line dedup (native): globally repeated multi-line chunks with content-defined boundaries.

A text's lines are hashed; a rolling hash over two neighbouring lines begins a chunk of these two lines wherever it
is divisible by ``mean``.  Where chunks begin depends on their own two lines alone, so a passage that was moved or has
lines inserted before it falls into the same chunks, and a repeated run of lines into repeated chunks that overlap.  With
mean 1 every run of two lines or more is covered whole; sparser chunks miss the short runs, of which most repeated
passages are (a run of two lines has one chunk).

Chunks with a word in them are counted over the corpus by hash; where a hash repeats, the texts of its chunks are compared
with the first one's byte by byte.  The lines of all equal ones but the first (smallest doc_id, then position) go.

Everything is DataFrame operations.  A hash that a third of all chunks share is counted by partial aggregation, and joins
on hashes are salted (see skew).  Texts are shuffled by document, and repeated chunks by hash.  Hot hashes are known from
the staged counts of chunks, so no job but the last one reads marks or shuffles texts, and its branches share one exchange
of them (two if ``docs`` has columns besides id and text, which only one branch needs).

Results: a null text stays null, an empty one empty.  Rows with equal id and equal text count as one
document and are treated alike; rows with equal id and other text are told apart by the text's hash.
A null id counts as the smallest.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.skew import salted_join
from strideframe.llm.store import stage

MEAN = 1
_WORD = r"[^\x20\x09-\x0D]"
_KEY = ["known", "k1", "k2"]


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``, which mentions it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(text: Column, mean: int = MEAN) -> Column:
    """array<struct<at, h>>: the first line and the hash of each chunk with a word in it."""
    def of(lines: Column) -> Column:
        pairs = F.transform(F.slice(lines, F.lit(1), F.size(lines) - 1),
                            lambda line, i: F.struct(i.alias("at"), F.xxhash64(line, F.get(lines, i + 1)).alias("h")))
        return F.filter(pairs, lambda c: ((F.get(lines, c["at"]).rlike(_WORD)) | F.get(lines, c["at"] + 1).rlike(_WORD))
                        & (F.pmod(c["h"], F.lit(mean)) == 0))

    return _let(F.split(text, "\n"), of)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """known, k1, k2 (the document's id, if any, and its text's hash), its text, and the other columns as ``own``."""
    text, id_ = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(id_.isNotNull().alias("known"), F.coalesce(id_, F.lit(0)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"),
                       *([F.struct(*others).alias("own")] if others else []))


def _marked(keyed: DataFrame, mean: int) -> tuple[DataFrame, DataFrame]:
    """``keyed`` with marks: array of (at, h, first) of its repeated chunks, null where it has none; and how often each
    repeated chunk occurs (h, n)."""
    found = keyed.select(*_KEY, F.explode(chunks(F.col("text"), mean)).alias("c")).select(*_KEY, "c.at", "c.h")
    firsts = stage(found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "at")).alias("first")).where("n > 1"), "repeated-chunks")
    repeats = firsts.select("h", "n")
    marked = salted_join(found, firsts.select("h", "first"), "h", "k1", counts=repeats)
    marks = marked.groupBy(*_KEY).agg(F.collect_set(F.struct("at", "h", "first")).alias("marks"))
    return keyed.join(marks, _KEY, "left"), repeats


def _is_first(mark: Column) -> Column:
    return (mark["first"]["known"] == F.col("known")) & (mark["first"]["k1"] == F.col("k1")) & (mark["first"]["k2"] == F.col("k2")) \
        & (mark["first"]["at"] == mark["at"])


def _unequal(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """known, k1, k2, wrong: the places of marked chunks whose hash is the first one's and whose bytes aren't."""
    pieces = rows.where("marks IS NOT NULL").select(*_KEY, F.explode(_let(F.split("text", "\n"), lambda ls: F.transform("marks", lambda m: F.struct(
        m["at"].alias("at"), m["h"].alias("h"), _is_first(m).alias("is_first"),
        F.concat_ws("\n", F.get(ls, m["at"]), F.get(ls, m["at"] + 1)).alias("text"))))).alias("p")).select(*_KEY, "p.*")
    firsts = pieces.where("is_first").groupBy("h").agg(F.min("text").alias("kept"))
    others = pieces.where("NOT is_first")
    same = salted_join(others, firsts, "h", "k1", counts=repeats)
    return same.where(F.col("text").cast("binary") != F.col("kept").cast("binary")).groupBy(*_KEY).agg(F.collect_set("at").alias("wrong"))


COUNTS = ("n_lines", "n_removed_lines", "n_removed_chunks")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN,
               counts: bool = True, least_left: float | None = None) -> DataFrame:
    """``docs`` with the lines of repeated chunks removed from the text; with ``counts``, the columns COUNTS (long) behind
    their own, in place of any so named.  With ``least_left`` documents go that had lines removed and have no word left, or
    less than this share of their characters: what is left of a copy of others."""
    rows, repeats = _marked(_keyed(docs, id_col, text_col), mean)
    rows = rows.join(_unequal(rows, repeats), _KEY, "left")
    later = F.transform(F.filter(F.coalesce("marks", F.array()), lambda m: ~_is_first(m)), lambda m: m["at"])
    gone = F.array_except(later, F.coalesce("wrong", F.array().cast("array<int>")))

    def rest(lines: Column, gone: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.array_union(gone, F.transform(gone, lambda p: p + 1)))
        return F.named_struct(F.lit("text"), F.array_join(F.transform(left, lambda p: F.get(lines, p)), "\n"),
                              F.lit("n_lines"), F.size(lines).cast("long"), F.lit("n_removed_lines"), (F.size(lines) - F.size(left)).cast("long"),
                              F.lit("n_removed_chunks"), F.size(gone).cast("long"))

    # out of a generator of one row: a later filter on the text isn't pushed beneath it, which would compute it again
    found = F.when(F.col("text").isNotNull(), _let(gone, lambda g: _let(F.split("text", "\n"), lambda ls: rest(ls, g))))
    done = rows.withColumn("rest", F.explode(F.array(found)))
    if least_left is not None:
        left = (F.length("rest.text") >= least_left * F.length("text")) & F.col("rest.text").rlike(_WORD)
        done = done.where(F.col("text").isNull() | (F.col("rest.n_removed_lines") == 0) | left)
    kinds = {id_col: F.when(F.col("known"), F.col("k1")).cast(docs.schema[id_col].dataType), text_col: F.col("rest.text")}
    out = [(kinds[c] if c in kinds else F.col(f"own.`{c}`")).alias(c) for c in docs.columns if not (counts and c in COUNTS)]
    return done.select(*out, *(F.coalesce(f"rest.{n}", F.lit(0)).alias(n) for n in COUNTS if counts))


#: DuckDB's twin of the query: pairs of lines compared as texts, numbered by a window function.
ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
pairs AS (
  SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM lines),
chunk AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY pair ORDER BY doc_id, i) > 1 AS again FROM pairs
  WHERE regexp_matches(pair, '[^\\x20\\x09-\\x0D]')),
gone AS (SELECT doc_id, i FROM chunk WHERE again UNION SELECT doc_id, i + 1 FROM chunk WHERE again),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS kept FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM chunk WHERE again GROUP BY doc_id)
SELECT doc_id, coalesce(total.n, 0) AS n_lines, coalesce(total.n, 0) - coalesce(left_over.n, 0) AS n_removed_lines,
       coalesce(removed.n, 0) AS n_removed_chunks, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN total USING (doc_id) LEFT JOIN left_over USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
