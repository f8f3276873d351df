"""Folder scans, table/column catalogues, previews and exports."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_parquet(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(conf)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))


def _fails(spark: SparkSession, paths: list[str]) -> str | None:
    """None if Spark reads every value of every column below ``paths``, else the first line of what it says.  A task reads
    one split, so neither a large file nor a large table is ever held whole."""
    try:
        spark.read.option("mergeSchema", True).parquet(*paths).write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001  (whatever is wrong with a file is its message)
        return (str(e).splitlines() or [type(e).__name__])[0][:200]
    return None


def damaged_files(spark: SparkSession, paths: list[str], message: str) -> dict[str, str]:
    """path -> message of the damaged ones among ``paths``, which fail together: halves that fail are halved again.
    Files that only fail together (their types don't agree) aren't damaged."""
    if len(paths) == 1:
        return {paths[0]: message}
    found = {}
    for part in (paths[:len(paths) // 2], paths[len(paths) // 2:]):
        if (said := _fails(spark, part)) is not None:
            found |= damaged_files(spark, part, said)
    return found


def scan_folder(spark: SparkSession, folder: str, log=print) -> dict[str, DataFrame]:
    """S3: the tables of a folder (a parquet file, or a folder of them, each); a damaged file is skipped with a message and
    its table read from the others.  Each table is read whole in one job of many tasks; only the file names of a table that
    can't be read reach the driver."""
    out = {}
    for name in list_parquet(spark, folder):
        table, at = name[: -len(".parquet")], os.path.join(folder, name)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(at).select("path")
        if files.isEmpty():  # Spark lists no files without bytes
            log(f"skipped {name}: empty")
            continue
        message, paths = _fails(spark, [at]), [at]
        if message is not None:
            listed = sorted(r["path"] for r in files.collect())
            damaged = damaged_files(spark, listed, message)
            for path, said in damaged.items():
                log(f"skipped {path.rsplit('/', 1)[-1]}: {said}")
            paths = [p for p in listed if p not in damaged]
        if paths:
            out[table] = spark.read.parquet(*paths)
    return out


def folder_profile(spark: SparkSession, folder: str) -> DataFrame:
    """S3 + E1 shape: table, rows, columns of all that is readable (one aggregate each, unioned)."""
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"),
                    F.lit(len(df.columns)).alias("columns")) for n, df in scan_folder(spark, folder).items()]
    out = spark.createDataFrame([], "table_name string, rows long, columns int")
    for p in parts:
        out = out.unionByName(p)
    return out


def table_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, row count, column count of warehouse tables."""
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows"),
                    F.lit(len(df.columns)).alias("columns")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Table, column, type and filled values of every column, one aggregate per table."""
    out = None
    for name, df in tables.items():
        counts = df.agg(*[F.count(f"`{c}`").alias(c) for c in df.columns])
        items = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', `{f.name}`" for f in df.schema.fields)
        part = counts.select(F.lit(name).alias("table_name"),
                             F.expr(f"stack({len(df.columns)}, {items}) AS (column_name, data_type, filled)"))
        out = part if out is None else out.unionByName(part)
    return out


def preview(df: DataFrame, order_by: list[str], n: int = 50) -> DataFrame:
    """First n rows in a stated order (TakeOrderedAndProject, deterministic)."""
    return df.orderBy(*order_by).limit(n)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)
