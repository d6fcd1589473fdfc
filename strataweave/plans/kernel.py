"""The sequential part: Gibbs sweeps over sufficient statistics, vectorised over clusters.

A sweep sees a row only as (n, mean, scatter) for each column cluster. Sweeps run inside one task for each chain, column
or view; what comes to that task is one such row of statistics for each item, whatever the number of columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from strataweave.functions.niw import NIW


def pooled(n1, m1, s1, n2, m2, s2):
    """Moments of two groups together, arrays of any leading shape; a negative n2 takes the group out."""
    n = n1 + n2
    safe = np.where(n == 0, 1, n)[..., None]
    gap = m2 - m1
    mean = np.where((n == 0)[..., None], 0.0, m1 + gap * n2[..., None] / safe)
    sign = np.sign(n2)[..., None, None]
    scatter = s1 + sign * s2 + gap[..., :, None] * gap[..., None, :] * (n1 * n2)[..., None, None] / safe[..., None]
    return n, mean, np.where((n == 0)[..., None, None], 0.0, scatter)


class Marginal:
    """ln marginals under one prior for arrays of moments; gamma terms come from a table over n."""

    def __init__(self, prior: NIW, most: int):
        self.prior = prior
        d, nu = prior.d, prior.nu
        base = d * (d - 1) / 4 * math.log(math.pi)
        size = int(most) + 1
        half = np.array([math.lgamma(v / 2) for v in range(1, nu + size + 1)])
        table = np.full(size, base)
        for j in range(1, d + 1):
            table += half[np.arange(nu, nu + size) + (1 - j) - 1]
        n = np.arange(size)
        self.fixed = table - table[0] - 0.5 * d * math.log(math.pi) * n + 0.5 * d * np.log(prior.kappa / (prior.kappa + n)) + 0.5 * nu * np.linalg.slogdet(prior.psi)[1]

    def __call__(self, n, mean, scatter):
        p = self.prior
        gap = mean - p.mu
        psi = p.psi + scatter + (n * p.kappa / (p.kappa + n))[..., None, None] * gap[..., :, None] * gap[..., None, :]
        if p.d == 1:
            log = np.log(psi[..., 0, 0])
        elif p.d == 2:
            log = np.log(psi[..., 0, 0] * psi[..., 1, 1] - psi[..., 0, 1] * psi[..., 1, 0])
        else:
            log = np.linalg.slogdet(psi)[1]
        return self.fixed[n.astype(int)] - 0.5 * (p.nu + n) * log


@dataclass
class Items:
    """Statistics of items by column cluster: n (items, L), mean (items, L, d), scatter (items, L, d, d)."""

    n: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of_matrix(x: np.ndarray, labels: np.ndarray) -> Items:
        """Of a matrix (items, others, d) and the others' labels; NaN cells are missing."""
        there = ~np.isnan(x[..., 0])
        x = np.where(there[..., None], x, 0.0)
        hot = np.eye(labels.max() + 1)[labels]
        n = there @ hot
        safe = np.maximum(n, 1)
        mean = np.einsum("ijd,jl->ild", x, hot) / safe[..., None]
        gap = np.where(there[..., None], x - mean[:, labels], 0.0)
        return Items(n, mean, np.einsum("ijd,ije,jl->ilde", gap, gap, hot))

    def blocks(self, labels: np.ndarray) -> Items:
        """Statistics of each cluster of items."""
        k, d = labels.max() + 1, self.mean.shape[-1]
        n = np.zeros((k, self.n.shape[1]))
        np.add.at(n, labels, self.n)
        total = np.zeros((k, self.n.shape[1], d))
        np.add.at(total, labels, self.n[..., None] * self.mean)
        mean = total / np.maximum(n, 1)[..., None]
        gap = self.mean - mean[labels]
        scatter = np.zeros((k, self.n.shape[1], d, d))
        np.add.at(scatter, labels, self.scatter + self.n[..., None, None] * gap[..., :, None] * gap[..., None, :])
        return Items(n, mean, scatter)


def relabelled(labels) -> np.ndarray:
    return np.unique(np.asarray(labels), return_inverse=True)[1]


def crp_log_density(labels: np.ndarray, alpha: float) -> float:
    counts = np.bincount(labels)
    return len(counts) * math.log(alpha) + sum(math.lgamma(c) for c in counts) - (math.lgamma(alpha + len(labels)) - math.lgamma(alpha))


def log_likelihood(items: Items, labels: np.ndarray, alpha: float, marginal: Marginal) -> float:
    b = items.blocks(labels)
    return crp_log_density(labels, alpha) + float(marginal(b.n, b.mean, b.scatter).sum())


def draw(log_weights: np.ndarray, rng: np.random.Generator) -> int:
    """The first place whose cumulative probability reaches a uniform draw; the last if rounding leaves none."""
    p = np.exp(log_weights - log_weights.max())
    return min(int(np.searchsorted(np.cumsum(p / p.sum()), rng.random())), len(p) - 1)


def sweep(items: Items, labels: np.ndarray, alpha: float, marginal: Marginal, rng: np.random.Generator) -> np.ndarray:
    """One collapsed Gibbs sweep over the items in order. Block statistics are made anew first, so no drift gathers."""
    labels = labels.copy()
    b = items.blocks(labels)
    n, mean, scatter, counts = b.n, b.mean, b.scatter, np.bincount(labels).astype(float)
    known = marginal(n, mean, scatter)
    alone = marginal(items.n, items.mean, items.scatter).sum(axis=1)
    for i in range(len(labels)):
        k, own = labels[i], (items.n[i], items.mean[i], items.scatter[i])
        if counts[k] == 1:
            n, mean, scatter, counts, known = (np.delete(v, k, axis=0) for v in (n, mean, scatter, counts, known))
            labels[labels > k] -= 1
        else:
            counts[k] -= 1
            n[k], mean[k], scatter[k] = pooled(n[k], mean[k], scatter[k], -own[0], own[1], own[2])
            known[k] = marginal(n[k], mean[k], scatter[k])
        with_it = pooled(n, mean, scatter, *(np.broadcast_to(v, (len(counts), *v.shape)) for v in own))
        gained = marginal(*with_it)
        weights = np.append(np.log(counts) + (gained - known).sum(axis=1), math.log(alpha) + alone[i])
        new = draw(weights, rng)
        if new == len(counts):
            n, mean, scatter = (np.concatenate((v, o[None])) for v, o in zip((n, mean, scatter), own, strict=True))
            counts, known = np.append(counts, 1.0), np.concatenate((known, marginal(*(o[None] for o in own))))
        else:
            counts[new] += 1
            n[new], mean[new], scatter[new], known[new] = with_it[0][new], with_it[1][new], with_it[2][new], gained[new]
        labels[i] = new
    return labels


def update_alpha(alpha: float, shape: float, scale: float, k: int, n: int, rng: np.random.Generator, west: str = "compat") -> float:
    """A draw of the concentration given K clusters of n items under Gamma(shape, scale). ``west="paper"`` weighs by shape + K - 1."""
    x = rng.beta(alpha + 1, n)
    rate = 1 / scale - math.log(x)
    one = shape + k + (1 if west == "compat" else -1)
    first = rng.random() < one / (one + n * rate)
    return max(float(rng.gamma(shape + k - (0 if first else 1), 1 / rate)), 1e-8)


def stick_breaking(shape: float, scale: float, size: int, rng: np.random.Generator) -> np.ndarray:
    """``size`` weights: a concentration from the Gamma prior, then Beta(1, c) parts of what is left."""
    beta = rng.beta(1, rng.gamma(shape, scale), size)
    return beta * np.concatenate(([1.0], np.cumprod(1 - beta)[:-1]))


@dataclass
class Concentration:
    """A fixed alpha, or a Gamma(shape, scale) prior: one of the two."""

    alpha: float | None = None
    prior: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if self.alpha is None and self.prior is None:
            raise ValueError("Either alphaRow or alphaRowPrior must be provided: please provide one of the two parameters.")
        if self.alpha is not None and self.prior is not None:
            raise ValueError("Providing both alphaRow or alphaRowPrior is not supported: remove one of the two parameters.")
        if self.alpha is not None and not self.alpha > 0:
            raise ValueError(f"alpha must be greater than 0, not {self.alpha}")
        if self.prior is not None and not min(self.prior) > 0:
            raise ValueError(f"shape and scale must be greater than 0, not {self.prior}")

    @property
    def resampled(self) -> bool:
        return self.prior is not None

    @property
    def start(self) -> float:
        return self.alpha if self.prior is None else self.prior[0] * self.prior[1]


def cluster(items: Items, labels: np.ndarray, concentration: Concentration, prior: NIW, sweeps: int, rng: np.random.Generator, west: str = "compat"):
    """Yields (iteration, labels, alpha, log likelihood), the start first."""
    marginal = Marginal(prior, int(items.n.sum()))
    alpha = concentration.start
    yield 0, labels, alpha, log_likelihood(items, labels, alpha, marginal)
    for t in range(1, sweeps + 1):
        labels = sweep(items, labels, alpha, marginal, rng)
        if concentration.resampled:
            alpha = update_alpha(alpha, *concentration.prior, int(labels.max()) + 1, len(labels), rng, west)
        yield t, labels, alpha, log_likelihood(items, labels, alpha, marginal)


def cocluster(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, c_row: Concentration, c_col: Concentration, prior: NIW, iterations: int, rng: np.random.Generator, update: bool = False):
    """Yields (iteration, rows, cols, alpha_row, alpha_col, log likelihood); alphas move only if ``update``."""
    marginal = Marginal(prior, x.shape[0] * x.shape[1])
    flipped = x.transpose(1, 0, 2)
    a, b = c_row.start, c_col.start
    total = lambda: log_likelihood(Items.of_matrix(x, cols), rows, a, marginal) + crp_log_density(cols, b)
    yield 0, rows, cols, a, b, total()
    for t in range(1, iterations + 1):
        rows = sweep(Items.of_matrix(x, cols), rows, a, marginal, rng)
        cols = sweep(Items.of_matrix(flipped, rows), cols, b, marginal, rng)
        if update:
            a = update_alpha(a, *c_row.prior, int(rows.max()) + 1, len(rows), rng) if c_row.resampled else a
            b = update_alpha(b, *c_col.prior, int(cols.max()) + 1, len(cols), rng) if c_col.resampled else b
        yield t, rows, cols, a, b, total()


def column_evidence(column: np.ndarray, rows: np.ndarray, marginal: Marginal) -> float:
    """ln marginal of one column (items, d) split by row clusters."""
    b = Items.of_matrix(column[:, None, :], np.zeros(1, int)).blocks(rows)
    return float(marginal(b.n, b.mean, b.scatter).sum())


def multiview(x: np.ndarray, own_rows: list[np.ndarray], own_evidence: np.ndarray, priors: dict[str, tuple[float, float]], prior: NIW, iterations: int, rng: np.random.Generator, inner: int = 5, start: tuple | None = None):
    """Yields (iteration, views by column, row labels by view, column labels by view), the start first.

    ``own_rows`` and ``own_evidence`` are each column's own row partition and its log marginal under it: what a new view
    would start from.
    """
    n, p, _ = x.shape
    marginal = Marginal(prior, n * p)
    c_row, c_col = Concentration(prior=priors["row"]), Concentration(prior=priors["col"])
    views, rows, cols = start or (np.zeros(p, int), [np.zeros(n, int)], [np.zeros(p, int)])
    # drawn once, from its mean and the number of views and columns
    alpha = update_alpha(Concentration(prior=priors["redundant"]).start, *priors["redundant"], len(rows), p, rng)
    yield 0, views, rows, cols
    for t in range(1, iterations + 1):
        views, rows = views.copy(), list(rows)
        for j in range(p):
            h = views[j]
            if (views == h).sum() == 1:
                del rows[h]
                views[views > h] -= 1
            views[j] = -1
            counts = np.bincount(views[views >= 0], minlength=len(rows))
            weights = [column_evidence(x[:, j], r, marginal) + math.log(c) for r, c in zip(rows, counts, strict=True)] + [own_evidence[j] + math.log(alpha)]
            new = draw(np.array(weights), rng)
            if new == len(rows):
                rows.append(own_rows[j])
            views[j] = new
        cols = []
        for h in range(len(rows)):
            mine = np.flatnonzero(views == h)
            *_, last = cocluster(x[:, mine], rows[h], np.arange(len(mine)), c_row, c_col, prior, inner, rng)
            rows[h] = last[1]
            cols.append(last[2])
        yield t, views, rows, cols
