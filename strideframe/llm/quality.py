"""Quality rules (native): one threshold table compiled into one projection.

Every statistic is a built-in column expression over the whole text; there is no user function, no
shuffle and no row explosion, so the plan is scan -> project.  Word windows are compared inside the
row: a document's 5-word windows are hashed, and only documents in which a hash occurs twice sort
their windows, compare neighbours word by word and add up the covered words.

A null text counts as a text without words; it fails the base rule (fewer than ten words).
Repeated rows and repeated ids each get their own result row.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import texts

#: What separates words.
SPACE = r"\x20\x09-\x0D"
TRIM = " \t\n\x0b\x0c\r"
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Frequent short words of the four languages, one flat list: a text in any of them has some.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by at are this from or an not "
    "de la que el en y los del se las por un para con no una su al lo "
    "le les et des est dans qui ce il ne sur pas plus par je au "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine es war"
).split()


@dataclass(frozen=True)
class Threshold:
    """A text of ``min_words`` or more fails where ``metric`` (a key of METRICS) lies outside [low, high]."""
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0

    def fails(self, columns: dict[str, Column]) -> Column:
        x = columns[self.metric]
        bounds = [x < F.lit(self.low)] * (self.low is not None) + [x > F.lit(self.high)] * (self.high is not None)
        failed = reduce(lambda a, b: a | b, bounds)
        return failed & (columns["n_words"] >= self.min_words) if self.min_words else failed


#: The base rule of the contract (exact integer arithmetic) ...
BASE = (Threshold("n_words", low=10), Threshold("repeat_excess", high=0))
#: ... and the threshold table.  Ratios are null, and so never fail, where their divisor is zero.
TABLE = (
    Threshold("mean_word_length", low=2.0, high=15.0),
    Threshold("symbol_ratio", high=0.3),
    Threshold("stop_word_ratio", low=0.005, min_words=200),  # one listed word in 200 can't be asked of shorter texts
    Threshold("dup_line_ratio", high=0.5),
    Threshold("alpha_word_ratio", low=0.5),
)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once: a lambda that mentions a column expression again would evaluate it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    t = F.btrim(text, F.lit(TRIM))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"[{SPACE}]+"))


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more, each word once."""
    n = F.size(words)
    hashes = F.transform(
        F.slice(words, 1, F.greatest(n - 4, F.lit(0))),
        lambda _, i: F.xxhash64(*(F.get(words, i + k) for k in range(5))))

    def covered(hs: Column) -> Column:
        order = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, 5) == F.slice(words, b["i"] + 1, 5))

        def starts(o: Column) -> Column:
            twice = F.filter(o, lambda x, k: F.coalesce(same(x, F.get(o, k - 1)), F.lit(False))
                             | F.coalesce(same(x, F.get(o, k + 1)), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        # a start covers five words, or up to the next start
        return _let(_let(order, starts), lambda s: F.aggregate(
            F.transform(s, lambda p, k: F.coalesce(F.least(F.get(s, k + 1) - p, F.lit(5)), F.lit(5))),
            F.lit(0), lambda a, b: a + b))

    return _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))


def _measured(rows: DataFrame, once: bool) -> DataFrame:
    """``rows`` (with a column text) and the counts behind every rule.

    ``once``: the counts come out of a generator of one row, beneath which the optimizer can't push a
    filter on them.  It would put the whole expression of the counts in place of each of their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def on_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"))

    def on_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    found = F.struct(
        _let(_words(text), on_words).alias("w"),
        _let(lines, on_lines).alias("l"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"))
    return rows.select("*", (F.explode(F.array(found)) if once else found).alias("m")).select("*", "m.*").select("*", "w.*", "l.*").drop("m", "w", "l")


def _judged(rows: DataFrame, base: tuple[Threshold, ...], table: tuple[Threshold, ...], once: bool = False) -> DataFrame:
    def ratio(a: str, b: str) -> Column:
        return F.col(a) / F.when(F.col(b) > 0, F.col(b))

    metrics = {
        "n_words": F.col("n_words"),
        "repeat_excess": 100 * F.col("n_repeat_words") - 20 * F.col("n_words"),
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "alpha_word_ratio": ratio("n_alpha_words", "n_words"),
    }
    base_failed = reduce(lambda a, b: a | b, (F.coalesce(r.fails(metrics), F.lit(False)) for r in base))
    failed = F.array_compact(F.array(*(F.when(r.fails(metrics), F.lit(r.metric)) for r in table)))
    return _measured(rows, once).select("*", base_failed.alias("base_failed"), failed.alias("failed")) \
                          .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  base: tuple[Threshold, ...] = BASE, table: tuple[Threshold, ...] = TABLE) -> DataFrame:
    """One row per input row: doc_id, the counts, ``base_failed``, ``failed`` (names of the broken
    table rules) and ``kept``."""
    return _judged(texts(docs, id_col, text_col), base, table).drop("text")


def keep_good(docs: DataFrame, text_col: str = "text",
              base: tuple[Threshold, ...] = BASE, table: tuple[Threshold, ...] = TABLE) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  Each row carries its own verdict (no
    join), so repeated ids are judged row by row."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    return _judged(rows, base, table, once=True).where("kept").select("row.*")
