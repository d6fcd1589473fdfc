"""Parquet tables as ``cells(row_id, col_id, x)``, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators.partition import relabel


def cells_of_arrays(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """A row for each element of an array column, d = 1."""
    rows = df.select(F.col(id_col).cast("int").alias("row_id"), F.posexplode(array_col).alias("col_id", "v"))
    return rows.select("row_id", "col_id", F.array(F.col("v").cast("double")).alias("x"))


def cells_of_groups(df: DataFrame, row: str, col: str, *values: Column) -> DataFrame:
    """A cell for each (row, col) group holding ``values``, aggregates; the columns are numbered by rank."""
    table = df.groupBy(row, col).agg(F.array(*[v.cast("double") for v in values]).alias("x"))
    return relabel(table, col, name="col_id").select(F.col(row).cast("int").alias("row_id"), "col_id", "x")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View A: a row for each vector, a column for each element."""
    return cells_of_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def embedding_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """View A's partitions: rows by label, columns by sixteens."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("row_id"), F.col("label").alias("k"))
    cols = spark.range(64).select(F.col("id").cast("int").alias("col_id"), (F.col("id") / 16).cast("int").alias("l"))
    return rows, cols


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View B: mean balance by nation and market segment."""
    return cells_of_groups(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_nationkey", "c_mktsegment", F.avg("c_acctbal"))


def events(spark: SparkSession, sf_dir: str, mean: Callable[[str], Column] = F.avg) -> DataFrame:
    """View C: mean value and count by user and event type, d = 2."""
    return cells_of_groups(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "event_type", mean("value"), F.count("*"))


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
