"""The Normal-Inverse-Wishart algebra: identities, a golden value, and Columns against numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.functions import niw, special
from strataweave.functions.niw import NIW, Gaussian
from strataweave.operators import blocks

UNIT = NIW.of()


@pytest.mark.parametrize(("first", "second"), [([1.0], [2.0, 3.0]), ([1.0, 2.0], [3.0, 4.0])])
def test_updates_add_up_and_removal_inverts(first, second):
    a, b = (np.array(v)[:, None] for v in (first, second))
    both = UNIT.update(np.concatenate((a, b)))
    assert UNIT.update(a).update(b).equals(both)
    assert both.remove(b).equals(UNIT.update(a))
    assert UNIT.weighted_update(np.array([2.0]), 3).equals(UNIT.update(np.full((3, 1), 2.0)))
    assert UNIT.weighted_update(np.array([2.0]), 3).weighted_remove(np.array([2.0]), 2).equals(UNIT.update(np.array([[2.0]])))


def test_removal_is_guarded():
    with pytest.raises(ValueError, match="taken away"):
        UNIT.remove(np.ones((2, 1)))


def test_counts_after_an_update():
    x = np.random.default_rng(0).normal(size=(100, 2))
    after = NIW.of_data(x).update(x)
    assert (after.kappa, after.nu) == (101, 103)


def test_golden_density():
    p = NIW.of((0.2, 0.3), 2, ((3.1, 0), (0, 1.35)), 5)
    assert round(p.log_pdf(Gaussian(np.array([1.0, 0.0]), 1.2 * np.eye(2))), 7) == -5.9921409


def test_predictive_is_the_marginal_of_one_and_the_chain_rule_holds():
    x = np.random.default_rng(1).normal(size=(6, 2))
    p, total = NIW.of_dimension(2), 0.0
    for i, v in enumerate(x):
        now = p.update(x[:i]) if i else p
        assert now.predictive(v) == pytest.approx(now.log_marginal(v[None]))
        total += now.predictive(v)
    assert total == pytest.approx(p.log_marginal(x))
    assert p.joint_posterior_predictive(x[3:], x[:3]) == pytest.approx(p.log_marginal(x) - p.log_marginal(x[:3]))


def test_expectation_needs_degrees_of_freedom():
    with pytest.raises(ValueError, match="nu"):
        NIW.of_dimension(2).expectation()
    g = NIW.of_dimension(2).update(np.ones((5, 2))).expectation()
    assert g.cov.shape == (2, 2)


def test_draws_repeat_and_have_the_right_mean():
    p = NIW.of((1.0, -1.0), 5, ((4.0, 1.0), (1.0, 3.0)), 20)
    rng = np.random.default_rng(2)
    draws = [p.sample(rng) for _ in range(2000)]
    assert np.allclose(np.mean([g.mean for g in draws], axis=0), p.mu, atol=0.05)
    assert np.allclose(np.mean([g.cov for g in draws], axis=0), p.expectation().cov, atol=0.03)
    a, b = (p.sample_compat(np.random.default_rng(3)) for _ in range(2))
    assert np.array_equal(a.mean, b.mean)


def test_singular_empirical_prior_says_so():
    with pytest.raises(ValueError, match="singular"):
        NIW.of_data(np.ones((5, 2)))


@pytest.mark.parametrize("d", [1, 2, 3])
def test_columns_agree_with_numbers(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(60, d))
    prior = NIW.of_dimension(d)
    df = spark.createDataFrame([(i % 4, [float(v) for v in row]) for i, row in enumerate(x)], "k int, x array<double>")
    stats = blocks.block_stats(df, d, "k")
    point = F.array(*[F.lit(0.3)] * d)
    e = niw.expectation(prior)
    rows = stats.select("k", niw.log_marginal(prior).alias("lm"), niw.predictive(prior, point).alias("pr"), niw.posterior(prior).alias("po"), e.alias("e"), niw.niw_log_pdf(prior, e["mean"], e["cov"]).alias("pdf"), niw.gaussian_log_pdf(point, e["mean"], e["cov"], d).alias("g")).collect()
    for r in rows:
        part = x[np.arange(60) % 4 == r["k"]]
        after, g = prior.update(part), prior.update(part).expectation()
        assert r["lm"] == pytest.approx(prior.log_marginal(part), rel=1e-9)
        assert r["pr"] == pytest.approx(after.predictive(np.full(d, 0.3)), rel=1e-9)
        assert r["po"]["psi"] == pytest.approx(after.psi.ravel().tolist())
        assert r["e"]["cov"] == pytest.approx(g.cov.ravel().tolist())
        assert r["pdf"] == pytest.approx(prior.log_pdf(g), rel=1e-9)
        assert r["g"] == pytest.approx(g.log_pdf(np.full(d, 0.3)), rel=1e-9)


def test_special_functions(spark):
    x = [0.5, 1.0, 1.5, 7.0, 1000.5]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(special.lgamma("x").alias("g"), special.multiloggamma(F.col("x") + 1, 3).alias("m")).collect()
    assert [r["g"] for r in got] == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)
    assert [r["m"] for r in got] == pytest.approx([niw.multiloggamma_number(v + 1, 3) for v in x], rel=1e-9)
    one = spark.range(1).select(
        special.log_factorial(F.lit(5)).alias("f"), special.factorial(F.lit(25)).alias("big"), special.round_half_up(F.lit(-2.5)).alias("r"),
        special.softmax(F.array(F.lit(0.0), F.lit(float("-inf")), F.lit(0.0))).alias("s"), special.normalize(F.array(F.lit(1.0), F.lit(0.0), F.lit(3.0))).alias("n"),
        special.inverse_cdf(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)), 0.4).alias("c"), special.inverse_cdf(F.array(F.lit(0.2), F.lit(0.3)), 0.9).alias("last"),
        special.remove_at(F.array(*map(F.lit, range(4))), 1).alias("rm"), special.insert_at(F.array(*map(F.lit, range(3))), 1, F.lit(9)).alias("ins"),
        special.insert_all(F.array(*map(F.lit, range(3))), 1, F.array(F.lit(8), F.lit(9))).alias("many"), special.outer_product(F.array(F.lit(1.0), F.lit(2.0))).alias("o"),
        special.outer_product(F.array(F.lit(1.0), F.lit(2.0)), full=False).alias("od"), special.all_equal(F.array(F.lit(1.0)), F.array(F.lit(1.05)), 0.1).alias("eq"), special.vector_sum(F.array(F.lit(1)), F.array(F.lit(2))).alias("vs"),
    ).first()
    assert one["f"] == pytest.approx(math.log(120), abs=1e-10) and one["big"] == pytest.approx(math.factorial(25)) and one["r"] == -2.0
    assert one["s"] == [0.5, 0.0, 0.5] and one["n"] == pytest.approx([0.25, 0, 0.75]) and (one["c"], one["last"]) == (1, 1)
    assert (one["rm"], one["ins"], one["many"]) == ([0, 2, 3], [0, 9, 1, 2], [0, 8, 9, 1, 2])
    assert one["o"] == [1, 2, 2, 4] and one["od"] == [1, 0, 0, 4] and one["eq"] and one["vs"] == [3]
