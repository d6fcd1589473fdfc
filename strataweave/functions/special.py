"""Special functions as Column expressions, and array helpers, inside whole-stage codegen where Spark allows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def lgamma(x: Column | str | float) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, then the recurrence down; relative error under 4e-12."""
    x = _col(x).cast("double")
    y = x + 8
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    falling = x
    for i in range(1, 8):
        falling = falling * (x + i)
    return series - F.ln(falling)


def multiloggamma(x: Column | str | float, d: int) -> Column:
    """ln of the d-variate gamma function."""
    x = _col(x)
    out = F.lit(d * (d - 1) / 4 * math.log(math.pi))
    for j in range(1, d + 1):
        out = out + lgamma(x + (1 - j) / 2)
    return out


def log_factorial(n: Column | str) -> Column:
    """ln n!, null for null and negative n."""
    n = _col(n)
    return F.when(n >= 0, F.when(n < 2, F.lit(0.0)).otherwise(lgamma(n.cast("double") + 1)))


def factorial(n: Column | str) -> Column:
    """n! as a double; infinite where a double can't hold it."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(_col(n).cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: a * i)


def logdet(m: list[list[Column]]) -> Column:
    """ln of the determinant of a positive definite matrix: in closed form up to three rows, beyond by Arrow batches."""
    if len(m) <= 3:
        return F.ln(det(m))
    d = len(m)

    @F.pandas_udf("double")
    def batch(cells: pd.Series) -> pd.Series:
        return _by_batch(lambda x: np.linalg.slogdet(x)[1], d, cells)

    return batch(_flat(m))


def _flat(m: list[list[Column]]) -> Column:
    return F.array(*[x.cast("double") for row in m for x in row])


def _by_batch(f, d: int, cells: pd.Series, *vectors: pd.Series) -> pd.Series:
    """``f`` of the matrices, and vectors, of the rows that have them whole; null elsewhere."""
    whole = [x is not None and not pd.isna(x).any() and all(v.iloc[i] is not None and not pd.isna(v.iloc[i]).any() for v in vectors) for i, x in enumerate(cells)]
    out = np.full(len(cells), np.nan)
    if any(whole):
        take = np.flatnonzero(whole)
        out[take] = f(np.stack(cells.iloc[take].to_numpy()).astype(float).reshape(-1, d, d), *(np.stack(v.iloc[take].to_numpy()).astype(float) for v in vectors))
    return pd.Series(out).replace({np.nan: None}) if len(out) and not all(whole) else pd.Series(out)


def det(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    if len(m) == 3:
        minor = lambda j, k: m[1][j] * m[2][k] - m[1][k] * m[2][j]
        return m[0][0] * minor(1, 2) - m[0][1] * minor(0, 2) + m[0][2] * minor(0, 1)
    raise ValueError("closed forms go up to three dimensions")


def quadratic(m: list[list[Column]], v: list[Column]) -> Column:
    """v' inverse(m) v: from cofactors up to three dimensions, beyond by Arrow batches."""
    d = len(v)
    if d == 1:
        return v[0] * v[0] / m[0][0]
    if d > 3:

        @F.pandas_udf("double")
        def batch(cells: pd.Series, vectors: pd.Series) -> pd.Series:
            return _by_batch(lambda x, y: (y * np.linalg.solve(x, y[..., None])[..., 0]).sum(axis=1), d, cells, vectors)

        return batch(_flat(m), F.array(*[x.cast("double") for x in v]))
    out = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            rest = [[m[a][b] for b in range(d) if b != i] for a in range(d) if a != j]
            out = out + v[i] * v[j] * det(rest) * (-1) ** (i + j)
    return out / det(m)


def round_half_up(x: Column | str, digits: int = 0) -> Column:
    """floor(x 10^digits + 1/2) / 10^digits: halves go up, -2.5 to -2."""
    f = 10.0**digits
    return F.floor(_col(x) * f + 0.5) / f


def _once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` taken once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def log_sum_exp(xs: Column | str) -> Column:
    """ln of the sum of exponentials of an array, stable; -inf elements count nothing."""
    xs = _col(xs)
    summed = lambda top: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return _once(F.array_max(xs), lambda top: F.when(top == float("-inf"), top).otherwise(top + F.ln(summed(top))))


def softmax(xs: Column | str) -> Column:
    """Probabilities from log weights."""
    xs = _col(xs)
    return _once(log_sum_exp(xs), lambda total: F.transform(xs, lambda x: F.exp(x - total)))


def normalize(ps: Column | str) -> Column:
    """Probabilities from weights, by way of logs; a weight of zero stays zero."""
    return softmax(F.transform(_col(ps), lambda p: F.coalesce(F.ln(p), F.lit(float("-inf")))))


def smoothed_one_hot(i: Column | str, size: int, log: bool = False) -> Column:
    """A distribution of ``size`` with all but a trace of 1e-8 on ``i``."""
    i, whole = _col(i), 1 + size * 1e-8
    value = lambda j: (F.when(j == i, F.lit(1.0)).otherwise(0.0) + 1e-8) / whole
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.ln(value(j)) if log else value(j))


def argmax(xs: Column | str) -> Column:
    """The first place, from 0, of an array's greatest element."""
    return F.array_position(_col(xs), F.array_max(_col(xs))) - 1


def inverse_cdf(ps: Column | str, u: Column | str | float) -> Column:
    """The first place whose cumulative probability reaches ``u``; the last if rounding leaves none."""
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(0).alias("at"), F.lit(-1).alias("hit"))

    def step(a: Column, p: Column, u: Column) -> Column:
        upto = a["upto"] + p
        return F.struct(upto.alias("upto"), (a["at"] + 1).alias("at"), F.when((a["hit"] < 0) & (upto >= u), a["at"]).otherwise(a["hit"]).alias("hit"))

    return _once(_col(u).cast("double"), lambda u: F.aggregate(_col(ps), start, lambda a, p: step(a, p, u), lambda a: F.when(a["hit"] >= 0, a["hit"]).otherwise(a["at"] - 1)))


def seeded_unit(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) that depends on ``seed`` and the keys alone: the same in every run and partition."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def sample(ps: Column | str, seed: int, *keys: Column | str) -> Column:
    """A category of each row by its probabilities; one seed and key give one draw."""
    return inverse_cdf(ps, seeded_unit(seed, *keys))


def sample_uniform(n: int, seed: int, *keys: Column | str) -> Column:
    """A category below ``n`` of each row, all alike."""
    return F.least(F.floor(seeded_unit(seed, *keys) * n).cast("int"), F.lit(n - 1))


def round_vector(xs: Column | str, digits: int = 0) -> Column:
    """An array of numbers, or of rows of numbers joined, each rounded half up."""
    return F.transform(_col(xs), lambda x: round_half_up(x, digits))


def remove_at(xs: Column, i: int) -> Column:
    return F.concat(F.slice(xs, 1, i), F.slice(xs, i + 2, F.greatest(F.size(xs) - i - 1, F.lit(0))))


def insert_at(xs: Column, i: int, value: Column) -> Column:
    return F.array_insert(xs, i + 1, value)


def insert_all(xs: Column, i: int, values: Column) -> Column:
    return F.concat(F.slice(xs, 1, i), values, F.slice(xs, i + 1, F.greatest(F.size(xs) - i, F.lit(0))))


def vector_sum(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def outer_product(x: Column | str, full: bool = True) -> Column:
    """x x' as an array of rows joined, or its diagonal alone on zeros."""
    x = _col(x)
    places = F.sequence(F.lit(0), F.size(x) - 1)
    cell = lambda i, j: F.get(x, i) * F.get(x, j) * (1 if full else F.when(i == j, 1.0).otherwise(0.0))
    return F.flatten(F.transform(places, lambda i: F.transform(places, lambda j: cell(i, j))))


def all_equal(a: Column | str, b: Column | str, tolerance: float = 0.0) -> Column:
    """Whether two arrays have one length and elements within ``tolerance`` of each other."""
    a, b = _col(a), _col(b)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda z: F.coalesce(z, F.lit(False)))


def is_integer(s: Column | str) -> Column:
    """Whether a string reads as a 32-bit integer."""
    return F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit("")).rlike(r"^[+-]?\d+$") & _col(s).try_cast("int").isNotNull()


def euclidean(x: Column | str, y: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
