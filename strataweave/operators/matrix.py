"""Matrices of vectors as long tables ``cells(row_id, col_id, x)``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def select_columns(cells: DataFrame, columns: list[int]) -> DataFrame:
    """The columns in the given order, repeats included, renumbered from 0."""
    wanted = cells.sparkSession.createDataFrame(list(enumerate(columns)), "new int, col_id int")
    return cells.join(wanted, "col_id").select("row_id", F.col("new").alias("col_id"), "x")


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "x")


def rows_of(cells: DataFrame) -> DataFrame:
    """``(row_id, xs)``: each row's vectors in column order."""
    return cells.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "x"))), lambda c: c["x"]).alias("xs"))


def columns_of(cells: DataFrame) -> DataFrame:
    """``(col_id, xs)``: each column's vectors in row order."""
    return rows_of(transpose(cells)).withColumnRenamed("row_id", "col_id")


def cells_of_rows(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.posexplode("xs").alias("col_id", "x"))


def missing_cells(cells: DataFrame) -> DataFrame:
    """One row: the matrix's dimensions and how many cells it lacks; ids beyond the greatest don't exist."""
    return cells.agg((F.max("row_id") + 1).alias("n_rows"), (F.max("col_id") + 1).alias("n_cols"), F.count("*").alias("n")).select("n_rows", "n_cols", (F.col("n_rows") * F.col("n_cols") - F.col("n")).cast("bigint").alias("n_missing"))


def duplicate_column(cells: DataFrame, col: int, copies: int) -> DataFrame:
    """``copies`` - 1 more copies of a column beside it; later columns move on."""
    extra = max(copies - 1, 0)
    ids = F.when(F.col("col_id") == col, F.sequence(F.lit(col), F.lit(col + extra))).when(F.col("col_id") > col, F.array(F.col("col_id") + extra)).otherwise(F.array("col_id"))
    return cells.select("row_id", F.explode(ids).alias("col_id"), "x")


def map_cells(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Two matrices cell by cell through ``f``."""
    return a.alias("a").join(b.alias("b"), ["row_id", "col_id"]).select("row_id", "col_id", f(F.col("a.x"), F.col("b.x")).alias("x"))


def sum_cells(*tables: DataFrame, d: int) -> DataFrame:
    """Element-wise vector sums of matrices of one shape."""
    whole = reduce(DataFrame.unionByName, tables)
    return whole.groupBy("row_id", "col_id").agg(F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(d)]).alias("x"))


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """The Cartesian product, as the operator of that name asks for."""
    return a.crossJoin(b)


def combinations_with_replacement(spark: SparkSession, most: int, length: int) -> DataFrame:
    """``combination array<int>``: the multisets of ``length`` numbers from 1 to ``most``."""
    numbers = spark.range(1, most + 1).select(F.col("id").cast("int").alias("v"))
    out = numbers.select(F.array("v").alias("combination"))
    for _ in range(length - 1):
        out = out.join(numbers, F.element_at("combination", -1) <= F.col("v")).select(F.concat("combination", F.array("v")).alias("combination"))
    return out


def as_dense(cells: DataFrame, d: int, most: int = 10_000_000):
    """A matrix as a numpy array (rows, columns, d), NaN where a cell is missing; one of over ``most`` numbers is refused before it is fetched."""
    import numpy as np

    size = cells.agg((F.max("row_id") + 1).cast("bigint").alias("n"), (F.max("col_id") + 1).cast("bigint").alias("p")).first()
    n, p = size["n"] or 0, size["p"] or 0
    if n * p * d > most:
        raise ValueError(f"{n} x {p} x {d} numbers don't fit the driver's bound of {most}")
    out = np.full((n, p, d), np.nan)
    for r in cells.collect():
        out[r["row_id"], r["col_id"]] = r["x"]
    return out


def cells_of_dense(spark: SparkSession, x) -> DataFrame:
    """``(row_id, col_id, x)`` of a numpy array (rows, columns) or (rows, columns, d); NaN cells are missing."""
    import numpy as np

    x = np.asarray(x, float)
    x = x[..., None] if x.ndim == 2 else x
    rows = [(i, j, x[i, j].tolist()) for i in range(x.shape[0]) for j in range(x.shape[1]) if not np.isnan(x[i, j]).any()]
    return spark.createDataFrame(rows, "row_id int, col_id int, x array<double>")
