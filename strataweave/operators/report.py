"""Reports of block sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lbm_report(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """``(k, l, n)``: the size of each block, margins where a label is null, from ``rows(k, n)`` and ``cols(l, n)``."""
    blocks = rows.select("k", F.col("n").alias("nk")).crossJoin(cols.select("l", F.col("n").alias("nl")))
    return blocks.cube("k", "l").agg(F.sum(F.col("nk") * F.col("nl")).cast("bigint").alias("n"))


def mcc_report(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """``(view_id, k, l, n)`` of each view, from ``rows(view_id, k, n)`` and ``cols(view_id, l, n)``."""
    return rows.withColumnRenamed("n", "nk").join(cols.withColumnRenamed("n", "nl"), "view_id").select("view_id", "k", "l", (F.col("nk") * F.col("nl")).cast("bigint").alias("n"))


def clbm_report(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """One row for each column cluster l, one text column for each k: sizes, "-" where the view lacks the cluster."""
    sizes = rows.withColumnRenamed("view_id", "l").withColumnRenamed("n", "nk").join(cols.withColumnRenamed("n", "nl"), "l")
    grid = sizes.groupBy("l").pivot("k").agg(F.first((F.col("nk") * F.col("nl")).cast("string")))
    return grid.select("l", *[F.coalesce(F.col(f"`{c}`"), F.lit("-")).alias(c) for c in grid.columns if c != "l"]).orderBy("l")


def grid(sizes: DataFrame) -> DataFrame:
    """``sizes(l, k, n)`` as a grid, k down and l across."""
    return sizes.groupBy("k").pivot("l").agg(F.first("n")).orderBy("k")


def text(df: DataFrame, most: int = 1000) -> str:
    """A printable table of a report."""
    return df._show_string(most, False)
