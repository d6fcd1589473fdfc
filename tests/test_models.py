"""Samplers on generated data, partition algebra, scores, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave import utils
from strataweave.functions.niw import NIW
from strataweave.operators import blocks, matrix, metrics, partition, report
from strataweave.plans import kernel
from strataweave.plans.kernel import Concentration, Items, Marginal
from strataweave.plans.models import Clustering, Coclustering, MultiViewBlocks, iteration_components, last_partition
from strataweave.plans.queries import COVS, MODES
from strataweave.sources import generators
from strataweave.streaming.blocks import streaming_block_stats


def test_concentration_is_alpha_or_prior():
    for bad in ({}, {"alpha": 1.0, "prior": (1.0, 2.0)}):
        with pytest.raises(ValueError, match="alphaRow or alphaRowPrior"):
            Concentration(**bad)
    assert Concentration(prior=(1.0, 2.0)).start == 2.0 and Concentration(prior=(5.0, 10.0)).start == 50.0
    assert not Concentration(alpha=3.0).resampled


def test_likelihood_kept_through_sweeps_equals_likelihood_made_anew():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4, 2))
    x[3, 1] = np.nan
    prior, cols = NIW.of_dimension(2), np.array([0, 1, 1, 0])
    items, labels = Items.of_matrix(x, cols), rng.integers(0, 3, 30)
    marginal = Marginal(prior, 120)
    for _ in range(3):
        labels = kernel.sweep(items, labels, 1.0, marginal, rng)
        assert set(labels) == set(range(labels.max() + 1))
        want = kernel.crp_log_density(labels, 1.0)
        for k in range(labels.max() + 1):
            for l in range(2):
                cells = x[labels == k][:, cols == l].reshape(-1, 2)
                want += prior.log_marginal(cells[~np.isnan(cells[:, 0])])
        assert kernel.log_likelihood(items, labels, 1.0, marginal) == pytest.approx(want)


def test_pooling_takes_out_what_it_put_in():
    rng = np.random.default_rng(1)
    a, b = Items.of_matrix(rng.normal(size=(2, 5, 2)), np.zeros(5, int)), Items.of_matrix(rng.normal(size=(2, 3, 2)), np.zeros(3, int))
    both = kernel.pooled(a.n, a.mean, a.scatter, b.n, b.mean, b.scatter)
    back = kernel.pooled(*both, -b.n, b.mean, b.scatter)
    assert all(np.allclose(x, y) for x, y in zip(back, (a.n, a.mean, a.scatter), strict=True))


def ari(spark, trace, truth, axis="row", item="row_id", label="k"):
    last = last_partition(trace, axis, "est", item)
    return metrics.scores(last.join(truth.select(item, label).distinct(), item), "est", label).first()["ari"]


def test_mixture(spark):
    cells = generators.mixture(spark, MODES[0] + MODES[1], COVS[0] + COVS[1], [20] * 4, seed=5)
    model = Clustering(Concentration(alpha=2.0), sweeps=60, seed=1)
    trace = model.run(cells, 2).cache()
    assert ari(spark, trace, cells) >= 0.9
    assert trace.select("iteration").distinct().count() == 61
    assert trace.where("iteration = 0").agg(F.max("label")).first()[0] == 0
    assert model.run(cells, 2).exceptAll(trace).count() == 0
    cols = spark.createDataFrame([(0, 0)], "col_id int, l int")
    comps = iteration_components(cells, trace.where("iteration >= 59"), cols, NIW.of_dimension(2))
    assert comps.where("iteration = 60").count() == trace.where("iteration = 60").select("label").distinct().count()
    with pytest.raises(ValueError, match="dimensions"):
        Clustering(Concentration(alpha=1.0), prior=NIW.of_dimension(3)).run(cells, 2)


def test_latent_blocks(spark):
    cells = generators.lbm(spark, MODES, COVS, [15, 15], [6, 6, 6], seed=2, shuffle=True).cache()
    trace = Coclustering(Concentration(alpha=2.0), Concentration(alpha=2.0), iterations=15, seed=3).run(cells.select("row_id", "col_id", "x"), 2).cache()
    assert ari(spark, trace, cells) >= 0.9
    assert ari(spark, trace, cells, "col", "col_id", "l") >= 0.9
    start = cells.select("row_id").distinct().withColumn("k", F.col("row_id") % 6)
    rows, cols = Coclustering(Concentration(alpha=2.0), Concentration(alpha=2.0), iterations=4, seed=3).run_distributed(cells.select("row_id", "col_id", "x"), 2, start)
    assert metrics.scores(rows.withColumnRenamed("k", "e").join(cells.select("row_id", "k").distinct(), "row_id"), "e", "k").first()["ari"] >= 0.8
    assert cols.count() == 18


def test_views(spark):
    one = generators.lbm(spark, MODES[:2], COVS[:2], [15, 15], [5, 5], seed=1).drop("k", "l")
    two = generators.lbm(spark, [MODES[0], MODES[2]], [COVS[0], COVS[2]], [8, 22], [6, 4], seed=2).drop("k", "l")
    cells = generators.beside(one, two)
    trace = MultiViewBlocks((1, 1), (1, 1), (1, 1), iterations=6, column_sweeps=20, inner=3).run(cells, 2)
    views = trace.where("axis = 'view' and iteration = 6").select("item_id", "label").toPandas().set_index("item_id")["label"]
    assert len(views) == 20 and not set(views[:10]) & set(views[10:])
    assert generators.below(one, one).agg(F.max("row_id"), F.max("col_id")).first() == (59, 9)


def test_generator_repeats_and_mixes(spark):
    a, b = (generators.lbm(spark, MODES, COVS, [30, 30], [15, 15, 15], seed=4, mixing=m) for m in (0.0, 0.5))
    assert a.exceptAll(generators.lbm(spark, MODES, COVS, [30, 30], [15, 15, 15], seed=4)).count() == 0
    kept = a.join(b.withColumnRenamed("x", "y"), ["row_id", "col_id"]).where("x = y").count()
    assert 0.4 * 2700 < kept < 0.7 * 2700
    block = a.where("k = 0 and l = 0").agg(*blocks.moments(2)).first()
    assert block["n"] == 450 and block["mean"] == pytest.approx([1.9, 1.9], abs=0.1)
    assert block["scatter"][1] / 450 == pytest.approx(0.2, abs=0.05)
    assert generators.per_block(a).count() == 6


def test_partitions_equal_up_to_names(spark):
    def equal(a, b):
        return partition.partitions_equal(spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int"), "a", "b").first()["equal"]

    assert equal([0, 1, 1], [5, 2, 2]) and equal([1, 2, 2, 0], [0, 1, 1, 2])
    assert not equal([0, 1, 0], [0, 0, 1])


def test_scores_of_trivial_partitions_are_null(spark):
    row = metrics.scores(spark.createDataFrame([(0, 0), (0, 0)], "a int, b int"), "a", "b").first()
    assert row["ari"] is None and row["ri"] == 1.0 and row["nmi"] is None


def test_principal_components():
    cov = np.diag([5.0, 3.0, 1.0, 0.5, 0.5])
    assert metrics.loadings(cov, 10, 0.99).shape == (4, 5) and metrics.loadings(cov, 2, 0.99).shape == (2, 5)
    rows, share = metrics.loadings_and_variance(cov, 10, 0.6)
    assert rows.shape == (2, 5) and share.sum() >= 0.6 and (np.abs(rows).max(axis=1) == rows.max(axis=1)).all()
    assert metrics.loadings(cov, 3, 1.0).shape == (3, 5)
    with pytest.raises(ValueError, match="threshold"):
        metrics.loadings_and_variance(cov, 3, 1.0)
    assert metrics.is_positive_definite(cov) and not metrics.is_positive_definite(-cov)


def test_alpha_and_sticks():
    rng = np.random.default_rng(0)
    draws = [kernel.update_alpha(1.0, 2.0, 1.0, 5, 100, rng, west) for west in ("compat", "paper") for _ in range(500)]
    assert min(draws) >= 1e-8 and 0.5 < np.mean(draws) < 3
    w = kernel.stick_breaking(2.0, 1.0, 10, rng)
    assert len(w) == 10 and 0 < w.sum() < 1


def test_reports_and_matrices(spark):
    rows = spark.createDataFrame([(0, 0, 3), (0, 1, 2), (1, 0, 4)], "view_id int, k int, n int")
    cols = spark.createDataFrame([(0, 5), (1, 1)], "l int, n int")
    grid = report.clbm_report(rows, cols).collect()
    assert [tuple(r) for r in grid] == [(0, "15", "10"), (1, "4", "-")]
    assert "15" in report.text(report.clbm_report(rows, cols))
    assert report.grid(spark.createDataFrame([(0, 0, 7), (1, 0, 8)], "l int, k int, n int")).first()["1"] == 8
    cells = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0]), (1, 0, [3.0])], "row_id int, col_id int, x array<double>")
    dense = matrix.as_dense(cells, 1)
    assert dense.shape == (2, 2, 1) and np.isnan(dense[1, 1, 0])
    assert matrix.missing_cells(cells).first()["n_missing"] == 1
    assert sorted(tuple(r) for r in matrix.cells_of_rows(matrix.rows_of(cells)).collect()) == sorted(tuple(r) for r in cells.collect())
    assert matrix.columns_of(cells).count() == 2


def test_helpers():
    calls = []
    assert utils.retry(lambda: calls.append(1) or (1 if len(calls) > 2 else 1 / 0)) == 1
    with pytest.raises(ZeroDivisionError):
        utils.retry(lambda: 1 / 0, tries=2)
    assert utils.timed(lambda: 5)[0] == 5


def test_streaming_statistics(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, 0, [float(i)]) for i in range(10)], "k int, l int, x array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming_block_stats(stream, 1).writeStream.format("memory").queryName("stats").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["k"], r["n"]) for r in spark.table("stats").collect()} == {(0, 5), (1, 5)}
