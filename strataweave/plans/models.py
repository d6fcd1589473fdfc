"""The three models as DataFrame plans: Spark aggregates, kernels sweep, Spark evaluates.

Randomness comes from ``[seed, chain, ...]`` alone, so a task that is run again draws the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.niw import NIW, empirical_prior
from strataweave.operators import blocks, partition
from strataweave.plans import kernel
from strataweave.plans.kernel import Concentration, Items

_TRACE = "chain_id int, iteration int, axis string, item_id int, label int, alpha double, log_likelihood double"


def _chains(df: DataFrame, chains: int) -> DataFrame:
    return df.withColumn("chain_id", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))


def labelled(cells: DataFrame, partition: DataFrame, item: str, label: str, start: str) -> DataFrame:
    """``cells`` with the ``label`` of their ``item`` as ``start``; raises if an item has no label, or several."""
    found = partition.select(item, F.col(label).alias(start))
    counts = found.agg(F.count("*").alias("n"), F.countDistinct(item).alias("m")).first()
    if counts["n"] != counts["m"]:
        raise ValueError(f"the partition has {counts['n']} labels for {counts['m']} values of {item}")
    missing = cells.select(item).distinct().join(found, item, "left_anti").count()
    if missing:
        raise ValueError(f"the partition lacks {missing} values of {item}")
    return cells.join(found, item)


def row_statistics(cells: DataFrame, d: int, col_partition: DataFrame | None = None, item: str = "row_id", other: str = "l") -> DataFrame:
    """``(item, l, n, mean, scatter)``; without a partition each column is its own cluster."""
    cells = cells.withColumn("l", F.col("col_id")) if col_partition is None else labelled(cells, col_partition, "col_id", "l", "l")
    return blocks.block_stats(cells, d, item, other)


def _items(pdf: pd.DataFrame, item: str, other: str, d: int) -> tuple[np.ndarray, Items]:
    ids, at = np.unique(pdf[item].to_numpy(), return_inverse=True)
    _, l = np.unique(pdf[other].to_numpy(), return_inverse=True)
    shape = (len(ids), l.max() + 1)
    n, mean, scatter = np.zeros(shape), np.zeros((*shape, d)), np.zeros((*shape, d, d))
    n[at, l] = pdf["n"]
    mean[at, l] = np.stack(pdf["mean"].to_numpy())
    scatter[at, l] = np.stack(pdf["scatter"].to_numpy()).reshape(-1, d, d)
    return ids, Items(n, mean, scatter)


@dataclass
class Clustering:
    """Dirichlet process mixture of rows; columns fixed, each its own cluster by default."""

    concentration: Concentration
    prior: NIW | None = None
    sweeps: int = 10
    seed: int = 0
    chains: int = 1
    west: str = "compat"

    def run(self, cells: DataFrame, d: int, row_partition: DataFrame | None = None, col_partition: DataFrame | None = None) -> DataFrame:
        """``(chain_id, iteration, axis, item_id, label, alpha, log_likelihood)``; iteration 0 is the start, all rows in cluster 0 by default."""
        prior = self.prior or empirical_prior(cells, d)
        if prior.d != d:
            raise ValueError(f"the prior has {prior.d} dimensions, the data {d}")
        stats = row_statistics(cells, d, col_partition)
        if row_partition is not None:
            stats = labelled(stats, row_partition, "row_id", "k", "start")
        else:
            stats = stats.withColumn("start", F.lit(0))
        conc, sweeps, seed, west = self.concentration, self.sweeps, self.seed, self.west

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            chain = int(pdf["chain_id"].iloc[0])
            ids, items = _items(pdf, "row_id", "l", d)
            labels = kernel.relabelled(pdf.drop_duplicates("row_id").sort_values("row_id")["start"])
            out = [pd.DataFrame({"chain_id": chain, "iteration": t, "axis": "row", "item_id": ids, "label": z, "alpha": a, "log_likelihood": ll}) for t, z, a, ll in kernel.cluster(items, labels, conc, prior, sweeps, np.random.default_rng([seed, chain]), west)]
            return pd.concat(out)

        return _chains(stats, self.chains).groupBy("chain_id").applyInPandas(run, _TRACE)


@dataclass
class Coclustering:
    """Latent block model: row and column partitions together. ``update_alpha`` resamples concentrations that have priors."""

    row: Concentration
    col: Concentration
    prior: NIW | None = None
    iterations: int = 10
    seed: int = 0
    chains: int = 1
    update_alpha: bool = False

    def run(self, cells: DataFrame, d: int, row_partition: DataFrame | None = None, col_partition: DataFrame | None = None) -> DataFrame:
        """The trace of both axes. The matrix of a chain is in one task: use :meth:`run_distributed` for one that is too large."""
        prior = self.prior or empirical_prior(cells, d)
        tagged = self._started(cells, row_partition, col_partition)
        c_row, c_col, iterations, seed, update = self.row, self.col, self.iterations, self.seed, self.update_alpha

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            chain = int(pdf["chain_id"].iloc[0])
            r_ids, r = np.unique(pdf["row_id"].to_numpy(), return_inverse=True)
            c_ids, c = np.unique(pdf["col_id"].to_numpy(), return_inverse=True)
            x = np.full((len(r_ids), len(c_ids), d), np.nan)
            x[r, c] = np.stack(pdf["x"].to_numpy())
            rows, cols = np.zeros(len(r_ids), int), np.zeros(len(c_ids), int)
            rows[r], cols[c] = pdf["k0"], pdf["l0"]
            out = []
            for t, z, w, a, b, ll in kernel.cocluster(x, kernel.relabelled(rows), kernel.relabelled(cols), c_row, c_col, prior, iterations, np.random.default_rng([seed, chain]), update):
                for axis, ids, labels, alpha in (("row", r_ids, z, a), ("col", c_ids, w, b)):
                    out.append(pd.DataFrame({"chain_id": chain, "iteration": t, "axis": axis, "item_id": ids, "label": labels, "alpha": alpha, "log_likelihood": ll}))
            return pd.concat(out)

        return _chains(tagged, self.chains).groupBy("chain_id").applyInPandas(run, _TRACE)

    @staticmethod
    def _started(cells: DataFrame, row_partition: DataFrame | None, col_partition: DataFrame | None) -> DataFrame:
        rows = cells.withColumn("k0", F.lit(0)) if row_partition is None else labelled(cells, row_partition, "row_id", "k", "k0")
        return rows.withColumn("l0", F.col("col_id")) if col_partition is None else labelled(rows, col_partition, "col_id", "l", "l0")

    def run_distributed(self, cells: DataFrame, d: int, row_partition: DataFrame | None = None, col_partition: DataFrame | None = None, col_groups: int = 32, trace: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
        """``(row_partition, col_partition)`` after the iterations, for matrices beyond one task.

        Two jobs an iteration: cells are aggregated to one row of statistics for each item and cluster of the other
        axis, a kernel sweeps those, and the new partition is written to the checkpoint folder. Columns start in ``col_groups``
        groups by their hash, so what comes to one task is a row's statistics times the groups at most, not the matrix;
        a sweep itself is sequential. With ``update_alpha``, concentrations that have priors are drawn anew after
        each iteration. ``trace`` gets a dict of each iteration: alphas, numbers of clusters, log likelihood.
        """
        prior = self.prior or empirical_prior(cells, d)
        rows = row_partition if row_partition is not None else cells.select("row_id").distinct().withColumn("k", F.lit(0))
        cols = col_partition if col_partition is not None else cells.select("col_id").distinct().withColumn("l", F.pmod(F.xxhash64("col_id"), F.lit(col_groups)).cast("int"))
        for table, item, label in ((rows, "row_id", "k"), (cols, "col_id", "l")):
            labelled(cells, table, item, label, "start")
        alphas, rng = [self.row.start, self.col.start], np.random.default_rng([self.seed, 7])
        for t in range(self.iterations):
            rows = self._half(cells, d, prior, rows, cols, "row_id", "k", "col_id", "l", alphas[0], [self.seed, t, 0])
            cols = self._half(cells, d, prior, cols, rows, "col_id", "l", "row_id", "k", alphas[1], [self.seed, t, 1])
            sizes = [p.agg(F.countDistinct(c).alias("k"), F.count("*").alias("n")).first() for p, c in ((rows, "k"), (cols, "l"))]
            if trace is not None:
                both = cells.join(rows, "row_id").join(cols, "col_id")
                fit = blocks.completed_log_likelihood(both, prior, rows, alphas[0], cols, alphas[1]).first()["log_likelihood"]
                trace.append({"iteration": t + 1, "alpha_row": alphas[0], "alpha_col": alphas[1], "rows": sizes[0]["k"], "cols": sizes[1]["k"], "log_likelihood": fit})
            for i, (c, size) in enumerate(zip((self.row, self.col), sizes, strict=True)):
                if self.update_alpha and c.resampled:
                    alphas[i] = kernel.update_alpha(alphas[i], *c.prior, size["k"], size["n"], rng)
        return rows, cols

    @staticmethod
    def _half(cells, d, prior, mine, theirs, item, label, other_item, other, alpha, seed) -> DataFrame:
        stats = blocks.block_stats(cells.join(theirs, other_item), d, item, other).join(mine, item)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, items = _items(pdf, item, other, d)
            start = kernel.relabelled(pdf.drop_duplicates(item).sort_values(item)[label])
            z = kernel.sweep(items, start, alpha, kernel.Marginal(prior, int(items.n.sum())), np.random.default_rng(seed))
            return pd.DataFrame({item: ids, label: z})

        out = stats.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, f"{item} int, {label} int")
        if not cells.sparkSession.sparkContext.getCheckpointDir():
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        return out.checkpoint()


@dataclass
class MultiViewBlocks:
    """Columns in views, each view with a latent block model of its own; Gamma (shape, scale) priors."""

    row: tuple[float, float]
    col: tuple[float, float]
    redundant: tuple[float, float]
    prior: NIW | None = None
    iterations: int = 10
    seed: int = 0
    chains: int = 1
    column_sweeps: int = 10
    inner: int = 5

    def column_models(self, cells: DataFrame, d: int, prior: NIW | None = None) -> DataFrame:
        """``(col_id, log_prior, rows array<int>, labels array<int>, x)``: a mixture for each column, all columns in parallel.

        A column's own prior is its mean, 1, its covariance and 1e-8 on the diagonal, d + 1; its evidence is taken under
        the model's prior.
        """
        whole = prior or self.prior or empirical_prior(cells, d)
        conc, sweeps, seed = Concentration(prior=self.row), self.column_sweeps, self.seed

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("row_id")
            x = np.stack(pdf["x"].to_numpy())
            cov = np.cov(x.T, ddof=1).reshape(d, d) if len(x) > 1 else np.zeros((d, d))
            own = NIW(x.mean(axis=0), 1.0, cov + 1e-8 * np.eye(d), d + 1)
            items = Items.of_matrix(x[:, None, :], np.zeros(1, int))
            col = int(pdf["col_id"].iloc[0])
            *_, (_, labels, _, _) = kernel.cluster(items, np.zeros(len(x), int), conc, own, sweeps, np.random.default_rng([seed, 1, col]))
            evidence = kernel.column_evidence(x, labels, kernel.Marginal(whole, len(x)))
            return pd.DataFrame({"col_id": [col], "log_prior": [evidence], "rows": [pdf["row_id"].tolist()], "labels": [labels.tolist()], "x": [x.ravel().tolist()]})

        return cells.groupBy("col_id").applyInPandas(run, "col_id int, log_prior double, rows array<int>, labels array<int>, x array<double>")

    def run(self, cells: DataFrame, d: int, view_partition: DataFrame | None = None, row_partitions: DataFrame | None = None, col_partitions: DataFrame | None = None) -> DataFrame:
        """``(chain_id, iteration, axis, view_id, item_id, label)``: axis "view" says the view of each column, "row" and "col" the labels in a view.

        All columns start in view 0, all labels at 0. A start of one's own is ``view_partition(col_id, view_id)`` with
        ``row_partitions(view_id, row_id, k)`` and ``col_partitions(col_id, l)``; those left out start at 0.
        """
        prior = self.prior or empirical_prior(cells, d)
        models = self.column_models(cells, d, prior)
        priors = {"row": self.row, "col": self.col, "redundant": self.redundant}
        iterations, seed, inner = self.iterations, self.seed, self.inner
        if view_partition is None and (row_partitions is not None or col_partitions is not None):
            raise ValueError("row and column partitions need a view partition")
        models = models.withColumn("h0", F.lit(0)) if view_partition is None else labelled(models, view_partition, "col_id", "view_id", "h0")
        models = models.withColumn("l0", F.lit(0)) if col_partitions is None else labelled(models, col_partitions, "col_id", "l", "l0")
        if row_partitions is None:
            models = models.withColumn("z0", F.lit(None).cast("array<int>"))
        else:
            views = partition.view_labels(row_partitions).select(F.col("view_id").alias("h0"), F.col("labels").alias("z0"))
            models = labelled(models, views, "h0", "z0", "z0")

        given, given_rows = view_partition is not None, row_partitions is not None

        def started(pdf: pd.DataFrame, n: int) -> tuple | None:
            if not given:
                return None
            names, views = np.unique(pdf["h0"].to_numpy(), return_inverse=True)
            rows = []
            for h in range(len(names)):
                z = pdf["z0"][views == h].iloc[0] if given_rows else np.zeros(n, int)
                if len(z) != n:
                    raise ValueError(f"a view's row partition has {len(z)} labels for {n} rows")
                rows.append(kernel.relabelled(z))
            return views, rows, [kernel.relabelled(pdf["l0"][views == h]) for h in range(len(names))]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            chain, pdf = int(pdf["chain_id"].iloc[0]), pdf.sort_values("col_id").reset_index(drop=True)
            ids = np.array(pdf["rows"].iloc[0])
            if any(len(r) != len(ids) for r in pdf["rows"]):
                raise ValueError("every column needs a cell in every row")
            x = np.stack([np.array(v).reshape(len(ids), d) for v in pdf["x"]], axis=1)
            own, cols = [np.array(v) for v in pdf["labels"]], pdf["col_id"].to_numpy()
            out = []
            for t, views, rows, labels in kernel.multiview(x, own, pdf["log_prior"].to_numpy(), priors, prior, iterations, np.random.default_rng([seed, chain]), inner, started(pdf, len(ids))):
                out.append(pd.DataFrame({"axis": "view", "view_id": views, "item_id": cols, "label": views, "iteration": t}))
                for h, (r, c) in enumerate(zip(rows, labels, strict=True)):
                    out.append(pd.DataFrame({"axis": "row", "view_id": h, "item_id": ids, "label": r, "iteration": t}))
                    out.append(pd.DataFrame({"axis": "col", "view_id": h, "item_id": cols[views == h], "label": c, "iteration": t}))
            return pd.concat(out).assign(chain_id=chain)[["chain_id", "iteration", "axis", "view_id", "item_id", "label"]]

        return _chains(models, self.chains).groupBy("chain_id").applyInPandas(run, "chain_id int, iteration int, axis string, view_id int, item_id int, label int")


def last_partition(trace: DataFrame, axis: str = "row", name: str = "k", item: str = "row_id") -> DataFrame:
    """``(chain_id, item, label)`` of each chain's last iteration."""
    last = trace.groupBy("chain_id").agg(F.max("iteration").alias("iteration"))
    return trace.join(last, ["chain_id", "iteration"]).where(F.col("axis") == axis).select("chain_id", F.col("item_id").alias(item), F.col("label").alias(name))


def iteration_components(cells: DataFrame, trace: DataFrame, col_partition: DataFrame, prior: NIW) -> DataFrame:
    """``(chain_id, iteration, k, l, mean, cov)``: the expected components at every iteration of a row trace, one aggregate."""
    rows = trace.where("axis = 'row'").select("chain_id", "iteration", F.col("item_id").alias("row_id"), F.col("label").alias("k"))
    labelled = cells.select("row_id", "col_id", "x").join(col_partition, "col_id").join(rows, "row_id")
    return blocks.components(blocks.block_stats(labelled, prior.d, "chain_id", "iteration", "k", "l"), prior)
