"""Cleaning a document corpus for language-model training, stage by stage.

``run`` applies STAGES to the table documents; each stage gets everything its predecessor kept,
calls one operator of ``strideframe.llm`` and returns a DataFrame that is written as Parquet and
read back as the next stage's docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import bpe, decontamination, line_chunks, quality, simhash
from strideframe.llm.store import documents, stage


#: Of a text that shares lines with others this share of its characters must be left, or it goes as a copy of them.
LEAST_LEFT = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts go (they have no words).  Rows are judged one by one: repeated rows and ids stay or go
    alike, columns of any name are kept as they are.  An empty table stays empty.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated chunks go from the texts; a document that is nothing but a copy, or scraps of one, goes.

    Null texts and texts without words go.  Of equal chunks the one with the smallest doc_id stays, a null id first;
    rows that repeat id and text are treated alike.  A column n_chars, where there is one, gets the text's new length;
    other columns, of any name, are kept as they are.  An empty table stays empty.
    """
    kept = line_chunks.line_dedup(docs, counts=False, least_left=LEAST_LEFT).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays.

    Texts without words, null ones too, are one group.  Of rows with the smallest id the text with the smallest hash
    stays; rows that repeat id and text stay or go together; a null id stays only in a group without ids.  Columns of any
    name are kept.  An empty table stays empty.
    """
    return simhash.keep_smallest(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stand in benchmark windows go.

    Null and empty texts have no words and stay.  Rows are judged one by one, ids play no part; columns of any name
    are kept.  Without documents or without a benchmark nothing goes.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every remaining document.

    Null and empty texts have no tokens.  Each row gets its own, whatever its id; other columns are left out.
    An empty table gives no rows.
    """
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Fingerprints and token ids have no SQL form; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
