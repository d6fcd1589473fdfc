"""Block statistics and the model quantities on top of them: one partial and one final aggregation, no gathering.

``cells(row_id, col_id, x array<double>)``, ``row_partition(row_id, k)``, ``col_partition(col_id, l)``; missing cells are
absent rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.functions import niw
from strataweave.functions.niw import NIW
from strataweave.functions.special import lgamma, log_factorial


def moments(d: int, x: str = "x") -> list[Column]:
    """Aggregates n, mean and scatter of a vector column; stable and mergeable."""
    e = [F.get(F.col(x), F.lit(i)).cast("double") for i in range(d)]
    n = F.count(x)
    cross = {}
    for i in range(d):
        for j in range(i, d):
            cross[i, j] = (F.covar_pop(e[i], e[j]) if i != j else F.var_pop(e[i])) * n
    return [
        n.alias("n"),
        F.array(*[F.avg(v) for v in e]).alias("mean"),
        F.array(*[cross[min(i, j), max(i, j)] for i in range(d) for j in range(d)]).alias("scatter"),
    ]


def label_cells(cells: DataFrame, row_partition: DataFrame | None = None, col_partition: DataFrame | None = None) -> DataFrame:
    """Cells with their row cluster ``k`` and column cluster ``l``; partitions given are joined, the small one broadcast by size."""
    if col_partition is not None:
        cells = cells.join(col_partition, "col_id")
    return cells.join(row_partition, "row_id") if row_partition is not None else cells


def block_stats(labelled: DataFrame, d: int, *keys: str) -> DataFrame:
    """n, mean and scatter by ``keys``, (k, l) if none are given."""
    return labelled.groupBy(*(keys or ("k", "l"))).agg(*moments(d))


def block_size_and_sum(labelled: DataFrame, d: int, *keys: str) -> DataFrame:
    sums = F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(d)])
    return labelled.groupBy(*(keys or ("l", "k"))).agg(F.count("*").alias("size"), sums.alias("total"))


def means_and_covariances(labelled: DataFrame, d: int, full: bool = True, *keys: str) -> DataFrame:
    """Mean, sample covariance (its diagonal alone unless ``full``) and size of each block; one row has no covariance."""
    stats = block_stats(labelled, d, *(keys or ("l", "k")))
    cov = F.transform("scatter", lambda s, i: (s if full else F.when(i % (d + 1) == 0, s).otherwise(0.0)) / F.nullif(F.col("n") - 1, F.lit(0)))
    return stats.select(*(keys or ("l", "k")), "mean", cov.alias("cov"), F.col("n").alias("size"))


def covariance_around(labelled: DataFrame, modes: DataFrame, d: int, *keys: str) -> DataFrame:
    """Covariance of each block around its given ``mode``, over n - 1."""
    stats = block_stats(labelled, d, *(keys or ("l", "k"))).join(modes, list(keys or ("l", "k")))
    gap = F.zip_with("mean", "mode", lambda a, b: a - b)
    cov = F.transform("scatter", lambda s, i: (s + F.col("n") * F.get(gap, (i / d).cast("int")) * F.get(gap, i % d)) / F.nullif(F.col("n") - 1, F.lit(0)))
    return stats.select(*(keys or ("l", "k")), cov.alias("cov"))


def posteriors(stats: DataFrame, prior: NIW) -> DataFrame:
    return stats.withColumn("niw", niw.posterior(prior))


def log_marginals(stats: DataFrame, prior: NIW, name: str = "log_marginal") -> DataFrame:
    return stats.withColumn(name, niw.log_marginal(prior))


def components(stats: DataFrame, prior: NIW) -> DataFrame:
    """Posterior expectation of each block; whatever keys ``stats`` has: (k), (k, l), (view_id, k, l), (col_id, k)..."""
    e = niw.expectation(prior)
    keys = [c for c in stats.columns if c not in ("n", "mean", "scatter")]
    return stats.select(*keys, e["mean"].alias("mean"), e["cov"].alias("cov"))


def priors_table(spark: SparkSession, priors: dict[int, NIW], item: str = "col_id") -> DataFrame:
    """``(item, prior struct<mu, kappa, psi, nu>)``, one row for each prior."""
    rows = [(int(i), (p.mu.tolist(), float(p.kappa), p.psi.ravel().tolist(), int(p.nu))) for i, p in priors.items()]
    return spark.createDataFrame(rows, f"{item} int, prior struct<mu: array<double>, kappa: double, psi: array<double>, nu: int>")


def components_per_column_prior(stats: DataFrame, priors: dict[int, NIW]) -> DataFrame:
    """As :func:`components`, each column with its own prior; columns without one have no components. One join, one scan."""
    if not priors:
        raise ValueError("no priors")
    d = next(iter(priors.values())).d
    both = stats.join(priors_table(stats.sparkSession, priors), "col_id")
    n, kappa, nu = F.col("n"), F.col("prior.kappa"), F.col("prior.nu")
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    mean = F.array(*[(n * at("mean", i) + kappa * at("prior.mu", i)) / (kappa + n) for i in range(d)])
    gap = [at("mean", i) - at("prior.mu", i) for i in range(d)]
    free = F.when(nu + n - d - 1 > 0, nu + n - d - 1)
    cov = F.array(*[(at("prior.psi", i * d + j) + at("scatter", i * d + j) + n * kappa / (kappa + n) * gap[i] * gap[j]) / free for i in range(d) for j in range(d)])
    keys = [c for c in stats.columns if c not in ("n", "mean", "scatter")]
    return both.select(*keys, mean.alias("mean"), cov.alias("cov"))


def posterior_samples(stats: DataFrame, prior: NIW, seed: int = 0) -> DataFrame:
    """``(keys, mean, cov)``: a draw from each block's posterior; by row cluster or by block, as the keys of ``stats`` say.

    A draw depends on the seed and the block's keys alone. Only the rows of block statistics go to Python.
    """
    keys, d = [c for c in stats.columns if c not in ("n", "mean", "scatter")], prior.d

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            draws = [
                prior.with_moments(int(n), np.array(m), np.array(s).reshape(d, d)).sample(np.random.default_rng([seed, h % (1 << 64)]))
                for n, m, s, h in zip(pdf["n"], pdf["mean"], pdf["scatter"], pdf["h"].tolist(), strict=True)
            ]
            yield pdf[keys].assign(mean=[g.mean.tolist() for g in draws], cov=[g.cov.ravel().tolist() for g in draws])

    kinds = ", ".join(f"`{c}` {t}" for c, t in stats.dtypes if c in keys)
    rows = stats.withColumn("h", F.xxhash64(*keys) if keys else F.lit(0).cast("bigint"))
    return rows.mapInPandas(run, f"{kinds}, mean array<double>, cov array<double>".lstrip(", "))


def crp_log_density(partition: DataFrame, alpha: float, label: str = "k") -> DataFrame:
    """One row ``crp``: K ln alpha + sum ln (n_k - 1)! - sum over e below n of ln(alpha + e)."""
    counts = partition.groupBy(label).agg(F.count("*").alias("n"))
    k, terms, n = F.count("*"), F.sum(log_factorial(F.col("n") - 1)), F.sum("n")
    rising = lgamma(F.lit(float(alpha)) + n) - math.lgamma(alpha)
    return counts.agg((k * math.log(alpha) + terms - rising).alias("crp"))


def completed_log_likelihood(labelled: DataFrame, prior: NIW, row_partition: DataFrame, alpha_row: float, col_partition: DataFrame | None = None, alpha_col: float | None = None) -> DataFrame:
    """One row ``log_likelihood``: block marginals, the row partition's density and, if given, the column partition's."""
    blocks = log_marginals(block_stats(labelled, prior.d), prior).agg(F.sum("log_marginal").alias("blocks"))
    out = blocks.crossJoin(crp_log_density(row_partition, alpha_row))
    total = F.col("blocks") + F.col("crp")
    if col_partition is not None:
        out = out.crossJoin(crp_log_density(col_partition, alpha_col, "l").withColumnRenamed("crp", "crp_col"))
        total = total + F.col("crp_col")
    return out.select(total.alias("log_likelihood"))


def row_prior_predictive(cells: DataFrame, col_partition: DataFrame, prior: NIW) -> DataFrame:
    """``(row_id, log_prior)``: sum over column clusters of the row's marginal under the prior."""
    stats = block_stats(label_cells(cells, None, col_partition), prior.d, "row_id", "l")
    return log_marginals(stats, prior).groupBy("row_id").agg(F.sum("log_marginal").alias("log_prior"))


def merged(n1: str, m1: str, s1: str, n2: str, m2: str, s2: str, d: int) -> tuple[Column, Column, Column]:
    """Moments of two groups together."""
    a, b = F.col(n1), F.col(n2)
    n = a + b
    gap = [F.get(F.col(m2), F.lit(i)) - F.get(F.col(m1), F.lit(i)) for i in range(d)]
    mean = F.array(*[F.get(F.col(m1), F.lit(i)) + gap[i] * b / n for i in range(d)])
    scatter = F.array(*[F.get(F.col(s1), F.lit(i * d + j)) + F.get(F.col(s2), F.lit(i * d + j)) + gap[i] * gap[j] * a * b / n for i in range(d) for j in range(d)])
    return n, mean, scatter


def membership_log_weights(cells: DataFrame, col_partition: DataFrame, stats: DataFrame, counts: DataFrame, prior: NIW) -> DataFrame:
    """``(row_id, k, log_weight)``: ln n_k plus the gain in log marginal when the row joins cluster k's blocks.

    ``stats`` and ``counts(k, n_k)`` are taken as they are: take a row out of them first for a Gibbs weight. They are
    K by L and K rows; rows join them by l.
    """
    d = prior.d
    rows = block_stats(label_cells(cells, None, col_partition), d, "row_id", "l").select("row_id", "l", F.col("n").alias("rn"), F.col("mean").alias("rm"), F.col("scatter").alias("rs"))
    own = log_marginals(stats, prior, "before").select("k", "l", "n", "mean", "scatter", "before")
    both = rows.join(own, "l")
    after = niw.log_marginal(prior, *merged("n", "mean", "scatter", "rn", "rm", "rs", d))
    gain = both.select("row_id", "k", (after - F.col("before")).alias("gain")).groupBy("row_id", "k").agg(F.sum("gain").alias("gain"))
    return gain.join(counts, "k").select("row_id", "k", (F.ln("n_k") + F.col("gain")).alias("log_weight"))


def normalized(weights: DataFrame, *keys: str, log_weight: str = "log_weight") -> DataFrame:
    """``probability`` from log weights within ``keys``, shifted by their greatest."""
    w = Window.partitionBy(*keys)
    shifted = F.exp(F.col(log_weight) - F.max(log_weight).over(w))
    return weights.withColumn("probability", shifted / F.sum(shifted).over(w))


def map_assignment(weights: DataFrame, *keys: str, label: str = "k", weight: str = "log_weight") -> DataFrame:
    """The label of greatest weight for each key; of ties the smallest label."""
    return weights.groupBy(*keys).agg(F.max_by(label, F.struct(F.col(weight), -F.col(label))).alias(label))


def view_log_weights(cells: DataFrame, row_partitions: DataFrame, view_sizes: DataFrame, prior: NIW) -> DataFrame:
    """``(col_id, view_id, log_weight)``: the column's marginal split by the view's row clusters, plus ln of the view's size.

    ``row_partitions(view_id, row_id, k)`` of all views are joined at once: one aggregate for all columns and views.
    """
    stats = block_stats(cells.join(row_partitions, "row_id"), prior.d, "col_id", "view_id", "k")
    evidence = log_marginals(stats, prior).groupBy("col_id", "view_id").agg(F.sum("log_marginal").alias("evidence"))
    return evidence.join(view_sizes, "view_id").select("col_id", "view_id", (F.col("evidence") + F.ln("size")).alias("log_weight"))


def gaussian_log_likelihood(labelled: DataFrame, comps: DataFrame, prior: NIW, partitions: list[tuple[DataFrame, str, float]], *keys: str) -> DataFrame:
    """One row ``log_likelihood`` of data with given components: data, components under the prior, partitions' densities.

    ``keys`` join cells and components: (k), (k, l) or (col_id, k).
    """
    keys, d = list(keys or ("k", "l")), prior.d
    data = labelled.join(comps, keys).agg(F.sum(niw.gaussian_log_pdf("x", "mean", "cov", d)).alias("data"))
    out = data.crossJoin(comps.agg(F.sum(niw.niw_log_pdf(prior, "mean", "cov")).alias("prior")))
    total = F.col("data") + F.col("prior")
    for i, (partition, label, alpha) in enumerate(partitions):
        out = out.crossJoin(crp_log_density(partition, alpha, label).withColumnRenamed("crp", f"crp{i}"))
        total = total + F.col(f"crp{i}")
    return out.select(total.alias("log_likelihood"))


def gamma_log_density(x: float, shape: float, scale: float) -> float:
    return (shape - 1) * math.log(x) - x / scale - shape * math.log(scale) - math.lgamma(shape)


def log_likelihood_by_variable(labelled: DataFrame, comps: DataFrame, priors: dict[int, NIW], row_partitions: DataFrame, alpha_rows: dict[int, float], col_partition: DataFrame, alpha_col: float, row_prior: tuple[float, float], col_prior: tuple[float, float]) -> DataFrame:
    """One row ``log_likelihood`` where each column (variable) has its own prior and components, and each column cluster its own row partition.

    ``labelled(row_id, col_id, k, x)`` and ``comps(col_id, k, mean, cov)``; ``row_partitions(l, row_id, k)`` and
    ``alpha_rows[l]``; ``col_partition(col_id, l)``. The concentrations' densities under their Gamma (shape, scale)
    priors are added. ``comps`` are columns times row clusters; their densities are taken in Python, the data's in Spark.
    """
    if not priors:
        raise ValueError("no priors")
    d = next(iter(priors.values())).d
    data = labelled.join(comps, ["col_id", "k"]).agg(F.coalesce(F.sum(niw.gaussian_log_pdf("x", "mean", "cov", d)), F.lit(0.0)).alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"prior": [priors[int(c)].log_pdf(niw.Gaussian(np.array(m), np.array(v).reshape(d, d))) for c, m, v in zip(pdf["col_id"], pdf["mean"], pdf["cov"], strict=True)]})

    prior = comps.select("col_id", "mean", "cov").mapInPandas(run, "prior double").agg(F.coalesce(F.sum("prior"), F.lit(0.0)).alias("prior"))
    alphas = row_partitions.sparkSession.createDataFrame([(int(l), float(a)) for l, a in alpha_rows.items()], "l int, alpha double")
    counts = row_partitions.groupBy("l", "k").agg(F.count("*").alias("n")).groupBy("l").agg(F.count("*").alias("labels"), F.sum(log_factorial(F.col("n") - 1)).alias("terms"), F.sum("n").alias("n"))
    alpha = F.col("alpha")
    rows = counts.join(alphas, "l").agg(F.sum(F.col("labels") * F.ln(alpha) + F.col("terms") - (lgamma(alpha + F.col("n")) - lgamma(alpha))).alias("rows"))
    fixed = sum(gamma_log_density(a, *row_prior) for a in alpha_rows.values()) + gamma_log_density(alpha_col, *col_prior)
    out = data.crossJoin(prior).crossJoin(rows).crossJoin(crp_log_density(col_partition, alpha_col, "l"))  # one row each
    return out.select((F.col("data") + F.col("prior") + F.col("rows") + F.col("crp") + fixed).alias("log_likelihood"))
