"""Scalar and matrix statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.special import round_half_up
from strataweave.operators.blocks import moments


def weighted_mean(x: str, w: str) -> Column:
    return F.sum(F.col(x) * F.col(w)) / F.sum(w)


def exact_mean(x: str) -> Column:
    """The mean, added up without rounding, so that it doesn't depend on the order of rows: values are taken as the decimals they print as.

    Decimals beyond the 18th are rounded. Where a value is NaN, or a value or the sum is 1e20 or more, it is Spark's mean.
    """
    number = F.col(x).try_cast("decimal(38,18)")
    exact = F.try_sum(number).cast("double") / F.count(x)
    return F.coalesce(F.when(F.count(number) == F.count(x), exact), F.avg(x))


def weighted_covariance(df: DataFrame, x: str, y: str, w: str, name: str = "weighted_cov") -> DataFrame:
    """sum w (x - mean x)(y - mean y) / sum w, the means unweighted: they are taken first, so nothing cancels."""
    means = df.agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    both = df.select(F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(w).alias("__w")).crossJoin(F.broadcast(means))  # one row
    return both.agg((F.sum(F.col("__w") * (F.col("__x") - F.col("__mx")) * (F.col("__y") - F.col("__my"))) / F.sum("__w")).alias(name))


def covariance_matrix(df: DataFrame, d: int, x: str = "x", mode: list[float] | None = None, constraint: str = "none", digits: int | None = 8) -> DataFrame:
    """One row ``cov``, d * d elements over n - 1. ``mode`` centres it; "independent" keeps the diagonal, about its own mean."""
    if constraint not in ("none", "independent", "independant"):
        raise ValueError("constraint is 'none' or 'independent'")
    diagonal = constraint != "none"
    stats = df.agg(*moments(d, x))
    gap = [F.get("mean", F.lit(i)) - (F.get("mean", F.lit(i)) if mode is None or diagonal else float(mode[i])) for i in range(d)]
    cells = []
    for i in range(d):
        for j in range(d):
            value = (F.get("scatter", F.lit(i * d + j)) + F.col("n") * gap[i] * gap[j]) / F.nullif(F.col("n") - 1, F.lit(0))
            value = value if not diagonal or i == j else F.lit(0.0)
            cells.append(value if digits is None else round_half_up(value, digits))
    return stats.select(F.array(*cells).alias("cov"))


def weighted_covariance_matrix(df: DataFrame, d: int, w: str, x: str = "x", mode: list[float] | None = None, constraint: str = "none") -> DataFrame:
    """As :func:`covariance_matrix` with weights, over their sum."""
    if constraint not in ("none", "independent", "independant"):
        raise ValueError("constraint is 'none' or 'independent'")
    diagonal = constraint != "none"
    rows = df.select(F.col(x).alias("__x"), F.col(w).alias("__w"))
    centre = F.array(*[F.avg(F.get("__x", F.lit(i))) if mode is None or diagonal else F.lit(float(mode[i])) for i in range(d)])
    both = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__n"), centre.alias("__c"))))  # one row
    gap = [F.get("__x", F.lit(i)) - F.get("__c", F.lit(i)) for i in range(d)]
    cell = lambda i, j: F.sum(F.col("__w") * gap[i] * gap[j]) / F.sum("__w") if i == j or not diagonal else F.lit(0.0)
    return both.agg(F.array(*[cell(i, j) for i in range(d) for j in range(d)]).alias("cov"))


def vector_mean(df: DataFrame, d: int, x: str = "x", *keys: str) -> DataFrame:
    """Mean vector by ``keys``; an empty table is an error in the caller's terms, so it gives no row here."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.avg(F.get(F.col(x), F.lit(i))) for i in range(d)]).alias("mean")).where("n > 0").drop("n")


def scale(cells: DataFrame, d: int) -> DataFrame:
    """Each column's elements over their sample standard deviation in the column; no centring."""
    spread = cells.groupBy("col_id").agg(F.array(*[F.stddev_samp(F.get("x", F.lit(i))) for i in range(d)]).alias("spread"))
    return cells.join(spread, "col_id").select("row_id", "col_id", F.zip_with("x", "spread", lambda a, s: a / F.nullif(s, F.lit(0.0))).alias("x"))


def weight(cells: DataFrame, weights: list[float]) -> DataFrame:
    """Each cell times ``weights``, element by element."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return cells.select("row_id", "col_id", F.zip_with("x", w, lambda a, b: a * b).alias("x"))


def stick_breaking_weights(betas: DataFrame, order: str = "j", beta: str = "beta", *keys: str) -> DataFrame:
    """``weight``: beta_j times the product of 1 - beta_i before it. Truncated, so the sum is below 1."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.exp(F.sum(F.ln(1 - F.col(beta))).over(w)), F.lit(1.0))
    return betas.withColumn("weight", F.col(beta) * before)
