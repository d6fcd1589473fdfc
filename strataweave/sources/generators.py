"""Synthetic matrices: Gaussian mixtures and latent blocks. Draws depend on seeds alone, so a retried task repeats them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def gaussian_vector(d: int, mean: Column, root: Column, seed: int) -> Column:
    """mean + root z; ``root`` is a Cholesky factor as d * d elements."""
    return _affine(d, mean, root, [F.randn(seed + i) for i in range(d)])


def _affine(d: int, mean: Column, root: Column, z: list[Column]) -> Column:
    rows = []
    for i in range(d):
        v = F.get(mean, F.lit(i))
        for j in range(i + 1):
            v = v + F.get(root, F.lit(i * d + j)) * z[j]
        rows.append(v)
    return F.array(*rows)


def _blocks(spark: SparkSession, modes: list, covs: list) -> DataFrame:
    """``(l, k, mean, root)`` of ``modes[l][k]`` and ``covs[l][k]``."""
    rows = [(l, k, [float(v) for v in m], np.linalg.cholesky(np.asarray(c, float)).ravel().tolist()) for l, (ms, cs) in enumerate(zip(modes, covs, strict=True)) for k, (m, c) in enumerate(zip(ms, cs, strict=True))]
    return spark.createDataFrame(rows, "l int, k int, mean array<double>, root array<double>")


def _owners(spark: SparkSession, sizes: list[int], name: str, label: str) -> DataFrame:
    """``(name, label)``: sizes[0] items of label 0, and so on."""
    edges = np.cumsum([0, *sizes])
    out = spark.range(int(edges[-1])).select(F.col("id").cast("int").alias(name))
    found = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        found = F.when(F.col(name) >= int(e), F.lit(i)).otherwise(found)
    return out.withColumn(label, found.cast("int"))


def mixture(spark: SparkSession, modes: list, covs: list, sizes: list[int], seed: int = 0, shuffle: bool = False) -> DataFrame:
    """``(row_id, col_id 0, x, k)``: a Gaussian mixture, cluster by cluster."""
    table = lbm(spark, [modes], [covs], sizes, [1], seed)
    return shuffled(table, seed, columns=False) if shuffle else table.drop("l")


def lbm(spark: SparkSession, modes: list, covs: list, row_sizes: list[int], col_sizes: list[int], seed: int = 0, shuffle: bool = False, mixing: float = 0.0) -> DataFrame:
    """``(row_id, col_id, x, k, l)``: blocks of Gaussian vectors, ``modes[l][k]``; a share ``mixing`` of cells is drawn from a random block."""
    if any(len(m) != len(row_sizes) for m in modes) or len(modes) != len(col_sizes):
        raise ValueError("modes[l][k] must have one entry for each column and row cluster")
    d = len(modes[0][0])
    rows, cols = _owners(spark, row_sizes, "row_id", "k"), _owners(spark, col_sizes, "col_id", "l")
    cells = rows.crossJoin(cols)
    # draws are hashes of the cell's place, so they don't hang on how the table is cut
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "row_id", "col_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    other = unit(1) < mixing
    source_k = F.when(other, F.floor(unit(2) * len(row_sizes))).otherwise(F.col("k")).cast("int")
    source_l = F.when(other, F.floor(unit(3) * len(col_sizes))).otherwise(F.col("l")).cast("int")
    placed = cells.withColumn("bk", source_k).withColumn("bl", source_l)
    blocks = _blocks(spark, modes, covs).withColumnRenamed("k", "bk").withColumnRenamed("l", "bl")
    normal = [F.sqrt(-2 * F.ln(unit(10 + 2 * i))) * F.cos(unit(11 + 2 * i) * 2 * np.pi) for i in range(d)]
    out = placed.join(blocks, ["bk", "bl"]).select("row_id", "col_id", _affine(d, F.col("mean"), F.col("root"), normal).alias("x"), "k", "l")
    return shuffled(out, seed) if shuffle else out


def lbm_of_gaussians(spark: SparkSession, gaussians: list, row_sizes: list[int], col_sizes: list[int], seed: int = 0, shuffle: bool = False, mixing: float = 0.0) -> DataFrame:
    """As :func:`lbm`, from ``gaussians[l][k]`` with mean and cov."""
    return lbm(spark, [[g.mean for g in row] for row in gaussians], [[g.cov for g in row] for row in gaussians], row_sizes, col_sizes, seed, shuffle, mixing)


def per_block(cells: DataFrame) -> DataFrame:
    """Blocks as rows: ``(l, k, xs)``, cells down the columns."""
    return cells.groupBy("l", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_id", "row_id", "x"))), lambda c: c["x"]).alias("xs"))


def beside(*parts: DataFrame) -> DataFrame:
    """Matrices side by side: columns of each are numbered on after the one before."""
    out, at = None, 0
    for p in parts:
        width = p.agg(F.max("col_id")).first()[0]
        moved = p.withColumn("col_id", (F.col("col_id") + at).cast("int"))
        out, at = moved if out is None else out.unionByName(moved, allowMissingColumns=True), at + (0 if width is None else width + 1)
    return out


def below(*parts: DataFrame) -> DataFrame:
    """Matrices one below the other."""
    flip = lambda p: p.withColumnsRenamed({"row_id": "__r", "col_id": "row_id"}).withColumnRenamed("__r", "col_id")
    return flip(beside(*[flip(p) for p in parts]))


def shuffled(cells: DataFrame, seed: int, rows: bool = True, columns: bool = True) -> DataFrame:
    """Rows and columns renumbered by independent random permutations."""
    for on, name, salt in ((rows, "row_id", 101), (columns, "col_id", 202)):
        if on:
            order = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(seed), F.lit(salt), name), name)
            ids = cells.select(name).distinct().withColumn("__new", (F.row_number().over(order) - 1).cast("int"))
            cells = cells.join(ids, name).drop(name).withColumnRenamed("__new", name)
    return cells
