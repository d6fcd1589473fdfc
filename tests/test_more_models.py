"""Dimensions above three, starts and checks of the models, the examples' expected clusters, grouped posterior samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.functions import niw, special
from strataweave.functions.niw import NIW, Gaussian
from strataweave.operators import blocks, matrix, metrics, partition
from strataweave.plans import kernel
from strataweave.plans.kernel import Concentration
from strataweave.plans.models import Clustering, Coclustering, MultiViewBlocks, last_partition
from strataweave.plans.queries import COVS, MODES
from strataweave.sources import generators


def floats(x):
    return F.array(*[F.lit(float(v)) for v in np.ravel(x)])


@pytest.mark.parametrize("d", [2, 5])
def test_columns_agree_with_numbers(spark, d):
    rng = np.random.default_rng(d)
    prior = NIW.of(rng.normal(size=d), 1.5, np.eye(d) + 0.1, d + 3)
    x = rng.normal(size=(40, d))
    cells = spark.createDataFrame([(i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "k int, x array<double>")
    got = {r["k"]: r for r in blocks.log_marginals(blocks.block_stats(cells, d, "k"), prior).collect()}
    for k in range(3):
        assert got[k]["log_marginal"] == pytest.approx(prior.log_marginal(x[k::3]))
    row = spark.range(1).select(
        niw.predictive(prior, floats(x[0]), F.lit(39), floats(x[1:].mean(axis=0)), floats((x[1:] - x[1:].mean(axis=0)).T @ (x[1:] - x[1:].mean(axis=0)))).alias("p"),
        niw.niw_log_pdf(prior, floats(x[0]), floats(np.cov(x.T))).alias("q"),
    ).first()
    assert row["p"] == pytest.approx(prior.update(x[1:]).predictive(x[0]))
    assert row["q"] == pytest.approx(prior.log_pdf(Gaussian(x[0], np.cov(x.T))))
    assert special.logdet([[F.lit(2.0)]]) is not None


def test_density_of_the_pinned_value(spark):
    """ln density of N((1, 0), 1.2 I) under NIW((0.2, 0.3), 2, diag(3.1, 1.35), 5)."""
    prior = NIW.of((0.2, 0.3), 2, ((3.1, 0.0), (0.0, 1.35)), 5)
    assert prior.log_pdf(Gaussian(np.array([1.0, 0.0]), 1.2 * np.eye(2))) == pytest.approx(-5.9921409, abs=1e-6)
    got = spark.range(1).select(niw.niw_log_pdf(prior, floats([1, 0]), floats(1.2 * np.eye(2))).alias("v")).first()["v"]
    assert got == pytest.approx(-5.9921409, abs=1e-6)


def test_statistics_without_a_part(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 2)) + 100
    cells = spark.createDataFrame([(int(i >= 8), i < 4, [float(v) for v in r]) for i, r in enumerate(x)], "k int, gone boolean, x array<double>")
    part = blocks.block_stats(cells.where("gone"), 2, "k").toDF("k", "n2", "m2", "s2")
    left = blocks.block_stats(cells, 2, "k").join(part, "k", "left").select("k", niw.without(2).alias("s")).select("k", "s.*")
    for r in left.collect():
        y = x[4:8] if r["k"] == 0 else x[8:]
        n, mean, scatter = niw.summarize(y)
        assert r["n"] == n and r["mean"] == pytest.approx(mean) and r["scatter"] == pytest.approx(scatter.ravel())
    swapped = blocks.block_stats(cells.where("gone"), 2, "k").join(blocks.block_stats(cells, 2, "k").toDF("k", "n2", "m2", "s2"), "k")
    assert swapped.select(niw.without(2).alias("s")).first()["s"] is None


def test_posterior_samples_by_block(spark):
    rng = np.random.default_rng(4)
    cells = spark.createDataFrame([(i % 2, j, [float(v) for v in rng.normal(size=2) + 10 * (i % 2)]) for i in range(400) for j in range(2)], "k int, l int, x array<double>")
    stats, prior = blocks.block_stats(cells, 2, "k", "l"), NIW.of_dimension(2)
    got = {(r["k"], r["l"]): r for r in blocks.posterior_samples(stats, prior, seed=1).collect()}
    assert set(got) == {(k, l) for k in range(2) for l in range(2)}
    for (k, _), r in got.items():
        assert r["mean"] == pytest.approx([10 * k] * 2, abs=0.6)
        assert np.linalg.eigvalsh(np.array(r["cov"]).reshape(2, 2)).min() > 0.5
    again = {(r["k"], r["l"]): r["mean"] for r in blocks.posterior_samples(stats.repartition(7), prior, seed=1).collect()}
    assert all(again[k] == r["mean"] for k, r in got.items())


def test_partitions_must_be_whole(spark):
    cells = generators.lbm(spark, MODES[:2], COVS[:2], [4, 4], [2, 2]).select("row_id", "col_id", "x")
    rows = cells.select("row_id").distinct().withColumn("k", F.lit(0))
    for bad in (rows.where("row_id < 7"), rows.unionByName(rows)):
        with pytest.raises(ValueError, match="partition"):
            Clustering(Concentration(alpha=1.0)).run(cells, 2, bad)
        with pytest.raises(ValueError, match="partition"):
            Coclustering(Concentration(alpha=1.0), Concentration(alpha=1.0)).run(cells, 2, bad)
    for bad in ({"alpha": 0.0}, {"alpha": -1.0}, {"prior": (0.0, 1.0)}):
        with pytest.raises(ValueError, match="greater than 0"):
            Concentration(**bad)
    with pytest.raises(ValueError, match="Providing both alphaRow or alphaRowPrior is not supported: remove one of the two parameters."):
        Concentration(alpha=1.0, prior=(1.0, 2.0))


def sizes(trace, axis="row"):
    last = last_partition(trace, axis, "k", "item")
    return sorted(r["count"] for r in last.groupBy("k").count().collect())


def test_examples(spark):
    mixture = generators.mixture(spark, MODES[0] + MODES[1], COVS[0] + COVS[1], [50] * 4)
    assert sizes(Clustering(Concentration(alpha=5.0), sweeps=100).run(mixture, 2))[-4:] == pytest.approx([50] * 4, abs=4)
    blocks_ = generators.lbm(spark, MODES, COVS, [30, 30], [15, 15, 15])
    trace = Coclustering(Concentration(alpha=10.0), Concentration(alpha=10.0), iterations=20).run(blocks_.select("row_id", "col_id", "x"), 2).cache()
    assert sizes(trace)[-2:] == [30, 30] and sizes(trace, "col")[-3:] == [15, 15, 15]


def test_views_from_a_start(spark):
    one = generators.lbm(spark, MODES[:2], COVS[:2], [15, 15], [5, 5], seed=1)
    two = generators.lbm(spark, [MODES[0], MODES[2]], [COVS[0], COVS[2]], [8, 22], [6, 4], seed=2)
    cells = generators.beside(one.drop("k", "l"), two.drop("k", "l"))
    views = cells.select("col_id").distinct().withColumn("view_id", (F.col("col_id") >= 10).cast("int"))
    rows = one.select(F.lit(0).alias("view_id"), "row_id", "k").distinct().unionByName(two.select(F.lit(1).alias("view_id"), "row_id", "k").distinct())
    cols = views.select("col_id", (F.col("col_id") % 2).alias("l"))
    trace = MultiViewBlocks((1, 1), (1, 1), (1, 1), iterations=2, column_sweeps=5, inner=2).run(cells, 2, views, rows, cols).cache()
    start = {(r["axis"], r["view_id"], r["item_id"]): r["label"] for r in trace.where("iteration = 0").collect()}
    assert all(start["view", int(j >= 10), j] == int(j >= 10) for j in range(20))
    assert all(start["row", r["view_id"], r["row_id"]] == r["k"] for r in rows.collect())
    assert all(start["col", int(j >= 10), j] == j % 2 for j in range(20))
    last = trace.where("iteration = 2 and axis = 'view'").toPandas().set_index("item_id")["label"]
    assert not set(last[:10]) & set(last[10:])
    with pytest.raises(ValueError, match="view partition"):
        MultiViewBlocks((1, 1), (1, 1), (1, 1)).run(cells, 2, None, rows)


def test_concentration_of_views_depends_on_their_number():
    """It is an update of the prior's mean, given the views and columns at the start."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 4, 1))
    priors = {"row": (1.0, 1.0), "col": (1.0, 1.0), "redundant": (2.0, 3.0)}
    first = next(kernel.multiview(x, [np.zeros(6, int)] * 4, np.zeros(4), priors, NIW.of_dimension(1), 1, np.random.default_rng(9)))
    assert first[0] == 0 and kernel.update_alpha(6.0, 2.0, 3.0, 1, 4, np.random.default_rng(9)) > 0


def test_distributed_run_draws_concentrations(spark):
    cells = generators.lbm(spark, MODES, COVS, [15, 15], [6, 6, 6], seed=2).cache()
    trace: list[dict] = []
    model = Coclustering(Concentration(prior=(1.0, 1.0)), Concentration(prior=(1.0, 1.0)), iterations=3, seed=3, update_alpha=True)
    start = cells.select("row_id").distinct().withColumn("k", F.col("row_id") % 6)
    rows, cols = model.run_distributed(cells.select("row_id", "col_id", "x"), 2, start, col_groups=6, trace=trace)
    assert rows.count() == 30 and cols.count() == 18 and [t["iteration"] for t in trace] == [1, 2, 3]
    assert len({t["alpha_row"] for t in trace}) == 3 and trace[-1]["log_likelihood"] >= trace[0]["log_likelihood"]
    assert metrics.scores(rows.withColumnRenamed("k", "e").join(cells.select("row_id", "k").distinct(), "row_id"), "e", "k").first()["ari"] >= 0.8


def test_dense_bridges(spark):
    x = np.arange(24.0).reshape(3, 4, 2)
    x[1, 2] = np.nan
    cells = matrix.cells_of_dense(spark, x)
    assert cells.count() == 11 and np.array_equal(matrix.as_dense(cells, 2), x, equal_nan=True)
    with pytest.raises(ValueError, match="bound"):
        matrix.as_dense(cells, 2, most=10)
    assert matrix.as_dense(cells.limit(0), 2).shape == (0, 0, 2)


def test_draws_depend_on_seed_and_key(spark):
    rows = spark.range(4000).select("id", special.sample(F.array(F.lit(0.2), F.lit(0.8)), 5, "id").alias("a"), special.sample_uniform(4, 5, "id").alias("b")).cache()
    assert rows.agg(F.avg("a")).first()[0] == pytest.approx(0.8, abs=0.03)
    assert {r["b"] for r in rows.select("b").distinct().collect()} == {0, 1, 2, 3}
    again = spark.range(4000).repartition(13).select("id", special.sample(F.array(F.lit(0.2), F.lit(0.8)), 5, "id").alias("c"))
    assert rows.join(again, "id").where("a <> c").count() == 0


def test_views_of_labelled_rows(spark):
    rows = spark.createDataFrame([(2, [1, 5]), (0, [0, 7]), (1, [1, 7])], "row_id int, labels array<int>")
    got = {r["view_id"]: r["labels"] for r in partition.view_labels(partition.partitions_by_view(rows)).collect()}
    assert got == {0: [0, 1, 1], 1: [7, 7, 5]}
