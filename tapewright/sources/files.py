"""Reading and writing of bar tables and pattern lists in files."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "date date, open double, high double, low double, close double, volume double"


def read_ticker_csv(spark: SparkSession, folder: str, schema: str = BAR_SCHEMA) -> DataFrame:
    """One table of many CSV files by ticker: the ticker is the file's name. Columns go by the header's names."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(f"{folder}/*.csv")
    return df.withColumn("ticker", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.csv$", 1))


def read_parquet(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """One or more Parquet files, folders or globs; a condition on a partition's column prunes partitions."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def read_patterns(spark: SparkSession, path: str, kind: str = "parquet", filters: dict[str, Any] | None = None, schema: str | None = None) -> DataFrame:
    """A list of patterns from Parquet, JSON or CSV, filtered by equal values or lists of them."""
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    df = (reader.schema(schema) if schema else reader).format(kind).load(path)
    for column, value in (filters or {}).items():
        df = df.where(F.col(column).isin(value) if isinstance(value, list | tuple | set) else F.col(column) == value)
    return df


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, compression: str | None = None, mode: str = "error") -> None:
    """Writes Parquet, CSV (with header) or JSON, in partitions by columns; rows of a partition are brought together."""
    if by:
        df = df.repartition(*by)
    writer = df.write.mode(mode).format(kind)
    writer = writer.partitionBy(*by) if by else writer
    writer = writer.option("header", True) if kind == "csv" else writer
    (writer.option("compression", compression) if compression else writer).save(path)


def convert(spark: SparkSession, source: str, source_kind: str, target: str, target_kind: str, schema: str | None = None) -> None:
    write(read_patterns(spark, source, source_kind, schema=schema), target, target_kind)


def merge(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns may differ; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def compact(spark: SparkSession, source: str, target: str, files: int, block_bytes: int = 128 << 20) -> None:
    """Rewrites Parquet in so many files with row groups of a size."""
    spark.read.parquet(source).repartition(files).write.option("parquet.block.size", block_bytes).parquet(target)


def query(spark: SparkSession, source: str, condition: str, target: str | None = None) -> DataFrame:
    """Rows of a Parquet file that meet an SQL condition; also written, if there is a target."""
    found = spark.read.parquet(source).where(condition)
    if target:
        found.write.parquet(target)
    return found
