"""The Normal-Inverse-Wishart family: numbers for kernels and drivers, Column expressions for DataFrames.

Everything depends on data through (n, mean, scatter), which add up; so Spark aggregates, and the closed forms
below work on one row for each block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.special import logdet, multiloggamma, quadratic


def multiloggamma_number(x: float, d: int) -> float:
    return d * (d - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x + (1 - j) / 2) for j in range(1, d + 1))


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(np.asarray(x) * 10.0**digits + 0.5) / 10.0**digits


def summarize(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, scatter) of rows."""
    x = np.atleast_2d(np.asarray(x, float))
    mean = x.mean(axis=0)
    return len(x), mean, (x - mean).T @ (x - mean)


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    cov: np.ndarray

    def log_pdf(self, x: np.ndarray) -> float:
        r = np.asarray(x, float) - self.mean
        return float(-0.5 * (len(r) * math.log(2 * math.pi) + np.linalg.slogdet(self.cov)[1] + r @ np.linalg.solve(self.cov, r)))


@dataclass(frozen=True)
class NIW:
    """NIW(mu, kappa, psi, nu); default (0, 1, 1, 1) in one dimension."""

    mu: np.ndarray
    kappa: float
    psi: np.ndarray
    nu: int

    @staticmethod
    def of(mu: Sequence[float] = (0.0,), kappa: float = 1.0, psi: Sequence[Sequence[float]] = ((1.0,),), nu: int = 1) -> NIW:
        return NIW(np.asarray(mu, float), float(kappa), np.asarray(psi, float), int(nu))

    @staticmethod
    def of_dimension(d: int) -> NIW:
        """mu 0, kappa 1, psi the identity, nu d + 1."""
        return NIW(np.zeros(d), 1.0, np.eye(d), d + 1)

    @staticmethod
    def of_moments(n: int, mean: np.ndarray, scatter: np.ndarray) -> NIW:
        """The empirical prior: psi is the inverse of the sample covariance rounded to 8 digits."""
        mean, d = np.asarray(mean, float), len(mean)
        cov = half_up(np.asarray(scatter, float).reshape(d, d) / max(n - 1, 1), 8)
        try:
            psi = np.linalg.inv(cov)
        except np.linalg.LinAlgError:
            raise ValueError("the sample covariance, rounded to 8 digits, is singular; give a prior") from None
        return NIW(mean, 1.0, psi, d + 1)

    @staticmethod
    def of_data(x: np.ndarray) -> NIW:
        """The empirical prior of rows, or of a matrix of cells."""
        x = np.asarray(x, float)
        return NIW.of_moments(*summarize(x.reshape(-1, x.shape[-1])))

    @property
    def d(self) -> int:
        return len(self.mu)

    def with_moments(self, n: float, mean: np.ndarray, scatter: np.ndarray) -> NIW:
        """The posterior after n vectors with this mean and scatter; negative n takes them away again."""
        kappa, nu = self.kappa + n, self.nu + n
        if kappa <= 0 or nu <= self.d - 1:
            raise ValueError("more is taken away than was added")
        gap = mean - self.mu
        sign = 1.0 if n >= 0 else -1.0
        psi = self.psi + sign * scatter + n * self.kappa / kappa * np.outer(gap, gap)
        return NIW((self.kappa * self.mu + n * mean) / kappa, kappa, psi, int(nu))

    def update(self, x: np.ndarray) -> NIW:
        return self.with_moments(*summarize(x))

    def remove(self, x: np.ndarray) -> NIW:
        n, mean, scatter = summarize(x)
        return self.with_moments(-n, mean, scatter)

    def weighted_update(self, x: np.ndarray, weight: int) -> NIW:
        return self.with_moments(weight, np.asarray(x, float), np.zeros((self.d, self.d)))

    def weighted_remove(self, x: np.ndarray, weight: int) -> NIW:
        return self.with_moments(-weight, np.asarray(x, float), np.zeros((self.d, self.d)))

    def log_marginal(self, x: np.ndarray) -> float:
        """ln of the marginal density of rows together."""
        n, mean, scatter = summarize(x)
        return self.log_marginal_of(n, mean, scatter)

    def log_marginal_of(self, n: int, mean: np.ndarray, scatter: np.ndarray) -> float:
        after, d = self.with_moments(n, mean, scatter), self.d
        return (
            -0.5 * n * d * math.log(math.pi)
            + 0.5 * d * math.log(self.kappa / after.kappa)
            + multiloggamma_number(after.nu / 2, d)
            - multiloggamma_number(self.nu / 2, d)
            + 0.5 * self.nu * float(np.linalg.slogdet(self.psi)[1])
            - 0.5 * after.nu * float(np.linalg.slogdet(after.psi)[1])
        )

    def joint_posterior_predictive(self, new: np.ndarray, seen: np.ndarray) -> float:
        return self.update(seen).log_marginal(new)

    @staticmethod
    def student_log_pdf(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray, nu: float) -> float:
        r, d = np.asarray(x, float) - mu, len(mu)
        q = float(r @ np.linalg.solve(sigma, r))
        return math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - 0.5 * d * math.log(nu * math.pi) - 0.5 * float(np.linalg.slogdet(sigma)[1]) - 0.5 * (nu + d) * math.log1p(q / nu)

    def predictive(self, x: np.ndarray) -> float:
        """ln of the predictive density of one vector: Student-t with nu - d + 1 degrees of freedom."""
        free = self.nu - self.d + 1
        return self.student_log_pdf(x, self.mu, self.psi * (self.kappa + 1) / (self.kappa * free), free)

    def inverse_wishart_log_pdf(self, sigma: np.ndarray) -> float:
        d = self.d
        return (
            0.5 * self.nu * float(np.linalg.slogdet(self.psi)[1])
            - 0.5 * self.nu * d * math.log(2)
            - multiloggamma_number(self.nu / 2, d)
            - 0.5 * (self.nu + d + 1) * float(np.linalg.slogdet(sigma)[1])
            - 0.5 * float(np.trace(np.linalg.solve(sigma, self.psi)))
        )

    def log_pdf(self, g: Gaussian) -> float:
        """ln density of a component: N(mean; mu, cov / kappa) times the inverse Wishart of cov."""
        return Gaussian(self.mu, g.cov / self.kappa).log_pdf(g.mean) + self.inverse_wishart_log_pdf(g.cov)

    def expectation(self) -> Gaussian:
        if self.nu - self.d - 1 <= 0:
            raise ValueError("the expected covariance needs nu > d + 1")
        return Gaussian(self.mu, self.psi / (self.nu - self.d - 1))

    def wishart(self, rng: np.random.Generator, scale: np.ndarray) -> np.ndarray:
        """A Wishart draw by Bartlett's decomposition."""
        d, a = self.d, np.zeros((self.d, self.d))
        for i in range(d):
            a[i, i] = math.sqrt(rng.chisquare(self.nu - i))
            a[i, :i] = rng.standard_normal(i)
        b = np.linalg.cholesky(scale) @ a
        return b @ b.T

    def sample_compat(self, rng: np.random.Generator) -> Gaussian:
        """One Wishart draw serves as the mean's precision and, over kappa squared, as the covariance."""
        s = self.wishart(rng, self.psi)
        spread = half_up(np.linalg.inv(self.kappa * s), 8)
        return Gaussian(rng.multivariate_normal(self.mu, spread, method="eigh"), s / self.kappa**2)

    def sample(self, rng: np.random.Generator) -> Gaussian:
        """The textbook draw: an inverse Wishart covariance, the mean with it over kappa."""
        cov = np.linalg.inv(self.wishart(rng, np.linalg.inv(self.psi)))
        return Gaussian(rng.multivariate_normal(self.mu, cov / self.kappa), cov)

    def equals(self, other: NIW, tolerance: float = 1e-6) -> bool:
        return self.d == other.d and self.nu == other.nu and all(np.allclose(a, b, rtol=0, atol=tolerance) for a, b in ((self.mu, other.mu), (self.kappa, other.kappa), (self.psi, other.psi)))

    def __str__(self) -> str:
        return f"NIW(mu={self.mu.tolist()}, kappa={self.kappa}, psi={self.psi.tolist()}, nu={self.nu})"


# Columns. n is a count, mean an array of d, scatter an array of d * d.


def _posterior(prior: NIW, n: Column, mean: Column, scatter: Column) -> tuple[Column, list[Column], list[list[Column]], Column]:
    d = prior.d
    kappa, nu = n + prior.kappa, n + prior.nu
    m = [F.get(mean, F.lit(i)) for i in range(d)]
    gap = [m[i] - float(prior.mu[i]) for i in range(d)]
    mu = [(m[i] * n + prior.kappa * float(prior.mu[i])) / kappa for i in range(d)]
    psi = [[F.get(scatter, F.lit(i * d + j)) + float(prior.psi[i, j]) + n * prior.kappa / kappa * gap[i] * gap[j] for j in range(d)] for i in range(d)]
    return kappa, mu, psi, nu


def posterior(prior: NIW, n: Column | str = "n", mean: Column | str = "mean", scatter: Column | str = "scatter") -> Column:
    """The posterior as a struct mu, kappa, psi, nu."""
    kappa, mu, psi, nu = _posterior(prior, *_cols(n, mean, scatter))
    return F.struct(F.array(*mu).alias("mu"), kappa.cast("double").alias("kappa"), F.array(*[x for row in psi for x in row]).alias("psi"), nu.cast("int").alias("nu"))


def _cols(*names: Column | str) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in names]


def log_marginal(prior: NIW, n: Column | str = "n", mean: Column | str = "mean", scatter: Column | str = "scatter") -> Column:
    """ln marginal of the block's data."""
    n, mean, scatter = _cols(n, mean, scatter)
    d = prior.d
    kappa, _, psi, nu = _posterior(prior, n, mean, scatter)
    fixed = 0.5 * d * math.log(prior.kappa) - multiloggamma_number(prior.nu / 2, d) + 0.5 * prior.nu * float(np.linalg.slogdet(prior.psi)[1])
    return n * (-0.5 * d * math.log(math.pi)) - 0.5 * d * F.ln(kappa) + multiloggamma(nu / 2, d) - 0.5 * nu * logdet(psi) + fixed


def without(d: int, whole: tuple[Column | str, ...] = ("n", "mean", "scatter"), part: tuple[Column | str, ...] = ("n2", "m2", "s2")) -> Column:
    """Moments of ``whole`` with ``part`` of it taken away, as a struct n, mean, scatter; null where more is taken than was there."""
    n1, m1, s1 = _cols(*whole)
    n2, m2, s2 = (F.coalesce(c, empty) for c, empty in zip(_cols(*part), (F.lit(0), F.array(*[F.lit(0.0)] * d), F.array(*[F.lit(0.0)] * d * d)), strict=True))
    n = n1 - n2
    safe = F.when(n > 0, n).otherwise(F.lit(1))
    mean = [(n1 * F.get(m1, F.lit(i)) - n2 * F.get(m2, F.lit(i))) / safe for i in range(d)]
    gap = [F.get(m2, F.lit(i)) - mean[i] for i in range(d)]
    scatter = [F.get(s1, F.lit(i * d + j)) - F.get(s2, F.lit(i * d + j)) - gap[i] * gap[j] * n * n2 / n1 for i in range(d) for j in range(d)]
    zero = lambda x: F.when(n > 0, x).otherwise(F.lit(0.0))
    return F.when(n >= 0, F.struct(n.alias("n"), F.array(*map(zero, mean)).alias("mean"), F.array(*map(zero, scatter)).alias("scatter")))


def expectation(prior: NIW, n: Column | str = "n", mean: Column | str = "mean", scatter: Column | str = "scatter") -> Column:
    """The expected component as a struct mean, cov; null where nu - d - 1 isn't positive."""
    _, mu, psi, nu = _posterior(prior, *_cols(n, mean, scatter))
    free = F.when(nu - prior.d - 1 > 0, nu - prior.d - 1)
    return F.struct(F.array(*mu).alias("mean"), F.array(*[x / free for row in psi for x in row]).alias("cov"))


def predictive(prior: NIW, x: Column | str, n: Column | str = "n", mean: Column | str = "mean", scatter: Column | str = "scatter") -> Column:
    """ln predictive density of the vector ``x`` after the block's data."""
    from strataweave.functions.special import lgamma

    kappa, mu, psi, nu = _posterior(prior, *_cols(n, mean, scatter))
    (x,), d = _cols(x), prior.d
    free = nu - d + 1
    scale = (kappa + 1) / (kappa * free)
    sigma = [[p * scale for p in row] for row in psi]
    q = quadratic(sigma, [F.get(x, F.lit(i)) - mu[i] for i in range(d)])
    return lgamma((free + d) / 2) - lgamma(free / 2) - 0.5 * d * F.ln(free * math.pi) - 0.5 * logdet(sigma) - 0.5 * (free + d) * F.log1p(q / free)


def gaussian_log_pdf(x: Column | str, mean: Column | str, cov: Column | str, d: int) -> Column:
    x, mean, cov = _cols(x, mean, cov)
    m = [[F.get(cov, F.lit(i * d + j)) for j in range(d)] for i in range(d)]
    r = [F.get(x, F.lit(i)) - F.get(mean, F.lit(i)) for i in range(d)]
    return -0.5 * (d * math.log(2 * math.pi) + logdet(m) + quadratic(m, r))


def niw_log_pdf(prior: NIW, mean: Column | str, cov: Column | str) -> Column:
    """ln NIW density of a component column."""
    mean, cov = _cols(mean, cov)
    d, out = prior.d, None
    m = [[F.get(cov, F.lit(i * d + j)) for j in range(d)] for i in range(d)]
    scaled = F.transform(cov, lambda c: c / prior.kappa)
    # trace(inverse(cov) psi) from psi's eigenvectors
    values, vectors = np.linalg.eigh(prior.psi)
    for value, v in zip(values, vectors.T, strict=True):
        part = quadratic(m, [F.lit(float(x)) for x in v]) * float(value)
        out = part if out is None else out + part
    wishart = F.lit(0.5 * prior.nu * float(np.linalg.slogdet(prior.psi)[1]) - 0.5 * prior.nu * d * math.log(2) - multiloggamma_number(prior.nu / 2, d)) - 0.5 * (prior.nu + d + 1) * logdet(m) - 0.5 * out
    return gaussian_log_pdf(mean, F.array(*[F.lit(float(x)) for x in prior.mu]), scaled, d) + wishart


def empirical_prior(cells: DataFrame, d: int) -> NIW:
    """The empirical prior of ``cells(x)``: one row of moments comes to the driver."""
    from strataweave.operators.blocks import moments

    row = cells.agg(*moments(d)).first()
    return NIW.of_moments(row["n"], np.array(row["mean"]), np.array(row["scatter"]).reshape(d, d))
