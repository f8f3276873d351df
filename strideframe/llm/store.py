"""Reading the document tables and staging intermediate tables in the session's shared folder."""
from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package's code to the executors, once per Spark context, as --py-files would: they need
    not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_strideframe_shipped", False):
        root = Path(__file__).parents[1]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='strideframe-')}/{root.name}", "zip", root.parent, root.name))
        sc._strideframe_shipped = True


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string) of ``docs``; other columns, whatever their names, stay out."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below the session's shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: later stages and retries
    after a lost executor read files instead of recomputing (or seeing another row order)."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
