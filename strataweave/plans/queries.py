"""One query for each operator over the tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import niw, special, stats
from strataweave.functions.niw import NIW
from strataweave.operators import blocks, matrix, metrics, partition, report
from strataweave.plans.kernel import Concentration
from strataweave.plans.models import Clustering, Coclustering, MultiViewBlocks, last_partition
from strataweave.sources import adapters, generators

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

P1 = NIW.of_dimension(1)
P2 = NIW.of((0.0, 0.0), 1.0, ((1.0, 0.0), (0.0, 1.0)), 3)

#: CTEs: view A, view C, the lineitem blocks, and moments of each.
_A = """a as (select cast(vec_id as int) as row_id, cast(i - 1 as int) as col_id, embedding[i]::double as x, label as k, cast((i - 1) // 16 as int) as l
  from embeddings, range(1, 65) t(i)),
rp as (select cast(vec_id as int) as row_id, label as k from embeddings), cp as (select cast(i as int) as col_id, cast(i // 16 as int) as l from range(64) t(i)),
sa as (select k, l, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as scatter from a group by k, l)"""
_C = """c as (select cast(user_id as int) as row_id, cast(dense_rank() over (order by event_type) - 1 as int) as col_id, avg(value) as x0, count(*)::double as x1
  from events group by user_id, event_type)"""
_D = """d as (select l_returnflag as k, l_linestatus as l, l_quantity as x0, l_extendedprice as x1 from lineitem),
sd as (select k, l, count(*) as n, avg(x0) as m0, avg(x1) as m1, var_pop(x0) * count(*) as s00, covar_pop(x0, x1) * count(*) as s01, var_pop(x1) * count(*) as s11 from d group by k, l)"""


def _lm1(n: str, m: str, s: str) -> str:
    """SQL for the log marginal under P1: mu 0, kappa 1, psi 1, nu 2."""
    return f"(-0.5::double * {n} * ln(pi()) + 0.5::double * ln(1.0::double / (1 + {n})) + lgamma((2 + {n}) / 2.0::double) - lgamma(1.0::double) - (2 + {n}) / 2.0::double * ln(1 + {s} + {n} * {m} * {m} / (1 + {n})))"


def _crp(table: str, label: str, alpha: float) -> str:
    return f"(select count(*) * ln({alpha}::double) + sum(lgamma(n::double)) - (lgamma({alpha}::double + sum(n)) - lgamma({alpha}::double)) from (select {label}, count(*) as n from {table} group by {label}))"


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _a(s: SparkSession, d: str) -> DataFrame:
    return blocks.label_cells(adapters.embeddings(s, d), *adapters.embedding_labels(s, d))


def _items(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("l"), F.array("l_quantity", "l_extendedprice").alias("x"))


def _at(c: str, i: int) -> Column:
    return F.get(F.col(c), F.lit(i))


# partitions


@query("select p_brand, count(*) as n from part group by p_brand")
def ordered_count(s, d):
    return partition.ordered_count(_table(s, d, "part"), "p_brand")


@query("select l_returnflag, round(count(*) / (select count(*) from lineitem)::double, 9) as proportion from lineitem group by l_returnflag")
def proportions(s, d):
    return partition.proportions(_table(s, d, "lineitem"), "l_returnflag").select("l_returnflag", _r("proportion", 9).alias("proportion"))


@query("select p_partkey, cast(dense_rank() over (order by p_brand) - 1 as int) as label from part")
def relabel(s, d):
    return partition.relabel(_table(s, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "label")


@query("select o_orderkey, cast(dense_rank() over (order by o_orderstatus, o_orderpriority) - 1 as int) as label from orders")
def relabel_tuples(s, d):
    return partition.relabel(_table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority").select("o_orderkey", "label")


@query("""with s as (select n_regionkey as label, count(*) as n from nation group by all), b as (select label, n, sum(n) over (order by label) - n as b from s)
select cast(unnest(range(cast(b as bigint), cast(b + n as bigint))) as bigint) as item, label from b""")
def partition_from_size(s, d):
    return partition.partition_from_sizes(_table(s, d, "nation").groupBy(F.col("n_regionkey").alias("label")).agg(F.count("*").alias("n")))


@query("select count(*) = count(distinct a) and count(*) = count(distinct b) as equal from (select distinct quality as a, toxic as b from labels)")
def partition_equal(s, d):
    return partition.partitions_equal(_table(s, d, "labels"), "quality", "toxic")


@query(f"""with {_C}, v as (select row_id, list(case when x0 > 50 then 1 else 0 end order by col_id) as t from c group by row_id), f as (select t, min(row_id) as m from v group by t)
select row_id, cast(dense_rank() over (order by m) - 1 as int) as label from v join f using (t)""")
def joint_row_partition(s, d):
    # a mean of just 50 is not to pass it by the rounding of a sum, which changes with the order of rows
    views = adapters.events(s, d, stats.exact_mean).select(F.col("col_id").alias("view_id"), "row_id", F.when(_at("x", 0) > 50, 1).otherwise(0).alias("k"))
    return partition.joint_row_partition(views)


@query(f"""with {_A}, f as (select k, l, min(col_id * 1000000::bigint + row_id) as m from a group by k, l)
select row_id, col_id, cast(dense_rank() over (order by m) - 1 as int) as label from a join f using (k, l)""")
def block_partition(s, d):
    return partition.block_partition(*adapters.embedding_labels(s, d))


def _views(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two views of A: columns by parity, four correlated clusters in each, rows by label mod 3 or mod 4."""
    rows, cols = adapters.embedding_labels(s, d)
    redundant = cols.select("col_id", (F.col("col_id") % 2).alias("h"))
    correlated = cols.select((F.col("col_id") % 2).alias("h"), "col_id", "l")
    labels = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("view_id"), "row_id", (F.col("k") % 3).alias("k")), F.struct(F.lit(1).alias("view_id"), "row_id", (F.col("k") % 4).alias("k")))).alias("v")).select("v.*")
    return redundant, correlated, labels


_V = f"{_A}, v as (select row_id, col_id, col_id % 2 as h, l, case when col_id % 2 = 0 then k % 3 else k % 4 end as k from a)"


@query(f"with {_V} select row_id, col_id, k, h as l from v")
def cond_block_partition(s, d):
    redundant, _, labels = _views(s, d)
    return partition.conditional_block_partition(labels, redundant.withColumnRenamed("h", "l"))


@query("with cp as (select cast(i as int) as col_id, cast(i % 2 as int) as h, cast(i // 16 as int) as l from range(64) t(i)) select col_id, h, l, cast(dense_rank() over (order by h, l) - 1 as int) as label from cp")
def combined_col_partition(s, d):
    redundant, correlated, _ = _views(s, d)
    return partition.combined_col_partition(redundant, correlated)


@query(f"with {_V}, w as (select *, dense_rank() over (order by h, l) as c from v) select row_id, col_id, cast(dense_rank() over (order by k, c) - 1 as int) as label from w")
def mcc_block_partition(s, d):
    return partition.mcc_block_partition(*_views(s, d))


@query("""with cp as (select cast(i as int) as col_id, cast(i // 16 as int) as l from range(64) t(i)), t as (select col_id, row_number() over (order by col_id) - 1 as t from cp where l = 1)
select col_id, cast(dense_rank() over (order by l) - 1 as int) as label from cp where l <> 1 union all select col_id, cast(t % 2 + 3 as int) as label from t""")
def split_col_cluster(s, d):
    _, cols = adapters.embedding_labels(s, d)
    return partition.split_col_cluster(cols, 1, s.range(16).select(F.col("id").cast("int").alias("t"), (F.col("id") % 2).cast("int").alias("label")))


# matrices


@query(f"with {_C} select row_id, cast(case col_id when 2 then 0 when 0 then 1 else 2 end as int) as col_id, round(x0, 6) as x0, x1 from c where col_id in (2, 0, 4)")
def select_columns(s, d):
    return matrix.select_columns(adapters.events(s, d), [2, 0, 4]).select("row_id", "col_id", _r(_at("x", 0)).alias("x0"), _at("x", 1).alias("x1"))


@query(f"with {_C} select col_id as row_id, row_id as col_id, round(x0, 6) as x0 from c")
def transpose(s, d):
    return matrix.transpose(adapters.events(s, d)).select("row_id", "col_id", _r(_at("x", 0)).alias("x0"))


@query(f"with {_C} select row_id, cast(len(list(col_id)) as int) as n, round(list(x0 order by col_id)[1], 6) as first, round(list(x0 order by col_id desc)[1], 6) as last from c group by row_id")
def rows_as_arrays(s, d):
    xs = matrix.rows_of(adapters.events(s, d))
    return xs.select("row_id", F.size("xs").alias("n"), _r(F.get(F.get("xs", F.lit(0)), F.lit(0))).alias("first"), _r(F.get(F.element_at("xs", -1), F.lit(0))).alias("last"))


@query("with g as (select distinct c_nationkey, c_mktsegment from customer) select cast(max(c_nationkey) + 1 as int) as n_rows, cast(count(distinct c_mktsegment) as int) as n_cols, cast((max(c_nationkey) + 1) * count(distinct c_mktsegment) - count(*) as bigint) as n_missing from g")
def missing_cells(s, d):
    return matrix.missing_cells(adapters.customers(s, d))


@query(f"with {_C} select row_id, cast(col_id + j as int) as col_id, round(x0, 6) as x0 from c, range(3) t(j) where col_id = 1 union all select row_id, cast(case when col_id > 1 then col_id + 2 else col_id end as int), round(x0, 6) from c where col_id <> 1")
def duplicate_column(s, d):
    return matrix.duplicate_column(adapters.events(s, d), 1, 3).select("row_id", "col_id", _r(_at("x", 0)).alias("x0"))


@query(f"with {_C}, w as (select *, stddev_samp(x0) over (partition by col_id) as s0, stddev_samp(x1) over (partition by col_id) as s1 from c) select row_id, col_id, round(x0 / s0, 6) as x0, round(x1 / nullif(s1, 0), 6) as x1 from w")
def scale_columns(s, d):
    return stats.scale(adapters.events(s, d), 2).select("row_id", "col_id", _r(_at("x", 0)).alias("x0"), _r(_at("x", 1)).alias("x1"))


@query(f"with {_C} select row_id, col_id, round(x0 * 2, 6) as x0, round(x1 * 0.5::double, 6) as x1 from c")
def weight_columns(s, d):
    return stats.weight(adapters.events(s, d), [2.0, 0.5]).select("row_id", "col_id", _r(_at("x", 0)).alias("x0"), _r(_at("x", 1)).alias("x1"))


@query(f"with {_C} select row_id, col_id, round(x0 + x0, 6) as x0, x1 + x1 as x1 from c")
def sum_matrices(s, d):
    c = adapters.events(s, d)
    return matrix.sum_cells(c, c, d=2).select("row_id", "col_id", _r(_at("x", 0)).alias("x0"), _at("x", 1).alias("x1"))


@query(f"with {_C} select row_id, col_id, round(x0 * x0, 4) as x0 from c")
def nested_map(s, d):
    c = adapters.events(s, d)
    return matrix.map_cells(c, matrix.transpose(matrix.transpose(c)), lambda a, b: F.zip_with(a, b, lambda x, y: x * y)).select("row_id", "col_id", _r(_at("x", 0), 4).alias("x0"))


@query("select r_name, n_name from region, nation")
def cross(s, d):
    return matrix.cross(_table(s, d, "region").select("r_name"), _table(s, d, "nation").select("n_name"))


@query("select cast(a as int) as a, cast(b as int) as b, cast(c as int) as c from range(1, 6) x(a), range(1, 6) y(b), range(1, 6) z(c) where a <= b and b <= c")
def combinations(s, d):
    return matrix.combinations_with_replacement(s, 5, 3).select(*[F.get("combination", F.lit(i)).alias(c) for i, c in enumerate("abc")])


# statistics


@query(f"with {_D} select k, l, count(*) as size, round(sum(x0), 2) as t0, round(sum(x1), 2) as t1 from d group by k, l")
def block_size_sum(s, d):
    return blocks.block_size_and_sum(_items(s, d), 2).select("k", "l", "size", _r(_at("total", 0), 2).alias("t0"), _r(_at("total", 1), 2).alias("t1"))


@query(f"with {_D} select k, l, n as size, round(m0, 6) as m0, round(m1, 4) as m1, round(s00 / (n - 1), 4) as c00, round(s01 / (n - 1), 2) as c01, round(s11 / (n - 1) / 1e6::double, 4) as c11 from sd")
def block_mean_cov(s, d):
    m = blocks.means_and_covariances(_items(s, d), 2)
    return m.select("k", "l", "size", _r(_at("mean", 0)).alias("m0"), _r(_at("mean", 1), 4).alias("m1"), _r(_at("cov", 0), 4).alias("c00"), _r(_at("cov", 1), 2).alias("c01"), _r(_at("cov", 3) / 1e6, 4).alias("c11"))


@query(f"with {_D} select k, l, n as size, round(s00 / (n - 1), 4) as c00, 0.0::double as c01 from sd")
def block_mean_cov_diagonal(s, d):
    return blocks.means_and_covariances(_items(s, d), 2, full=False).select("k", "l", "size", _r(_at("cov", 0), 4).alias("c00"), _at("cov", 1).alias("c01"))


@query(f"with {_D} select k, l, round((s00 + n * (m0 - 25) * (m0 - 25)) / (n - 1), 4) as c00, round((s01 + n * (m0 - 25) * (m1 - 30000)) / (n - 1), 1) as c01 from sd")
def block_cov_around_modes(s, d):
    items = _items(s, d)
    modes = items.select("k", "l").distinct().withColumn("mode", F.array(F.lit(25.0), F.lit(30000.0)))
    return blocks.covariance_around(items, modes, 2, "k", "l").select("k", "l", _r(_at("cov", 0), 4).alias("c00"), _r(_at("cov", 1), 1).alias("c01"))


@query("select round(var_samp(l_quantity), 6) as variance, round(covar_samp(l_quantity, l_discount), 8) as covariance, round(avg(l_quantity), 6) as mean from lineitem")
def variance_covariance_mean(s, d):
    return _table(s, d, "lineitem").agg(_r(F.var_samp("l_quantity")).alias("variance"), _r(F.covar_samp("l_quantity", "l_discount"), 8).alias("covariance"), _r(F.avg("l_quantity")).alias("mean"))


@query("select round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) as weighted_mean from lineitem")
def weighted_mean(s, d):
    return _table(s, d, "lineitem").agg(_r(stats.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("weighted_mean"))


@query("with m as (select avg(l_discount) as a, avg(l_tax) as b from lineitem) select round(sum(l_quantity * (l_discount - a) * (l_tax - b)) / sum(l_quantity), 10) as weighted_cov from lineitem, m")
def weighted_cov(s, d):
    return stats.weighted_covariance(_table(s, d, "lineitem"), "l_discount", "l_tax", "l_quantity").select(_r("weighted_cov", 10).alias("weighted_cov"))


@query("""with m as (select avg(l_discount) as a, avg(l_tax) as b from lineitem)
select round(sum(l_quantity * (l_discount - a) * (l_discount - a)) / sum(l_quantity), 10) as c00, round(sum(l_quantity * (l_discount - a) * (l_tax - b)) / sum(l_quantity), 10) as c01 from lineitem, m""")
def weighted_cov_matrix(s, d):
    x = _table(s, d, "lineitem").select("l_quantity", F.array("l_discount", "l_tax").alias("x"))
    return stats.weighted_covariance_matrix(x, 2, "l_quantity").select(_r(_at("cov", 0), 10).alias("c00"), _r(_at("cov", 1), 10).alias("c01"))


@query("select round(floor(covar_samp(l_quantity, l_quantity) * 1e8 + 0.5::double) / 1e8, 6) as c00, round(floor(covar_samp(l_quantity, l_discount) * 1e8 + 0.5::double) / 1e8, 6) as c01 from lineitem")
def covariance_matrix(s, d):
    x = _table(s, d, "lineitem").select(F.array("l_quantity", "l_discount").alias("x"))
    return stats.covariance_matrix(x, 2).select(_r(_at("cov", 0)).alias("c00"), _r(_at("cov", 1)).alias("c01"))


@query("with b as (select n_nationkey as j, (n_nationkey % 5 + 1) / 10.0::double as beta from nation) select j, round(beta * coalesce(exp(sum(ln(1 - beta)) over (order by j rows between unbounded preceding and 1 preceding)), 1), 9) as weight from b")
def stick_breaking_weights(s, d):
    b = _table(s, d, "nation").select(F.col("n_nationkey").alias("j"), ((F.col("n_nationkey") % 5 + 1) / 10).alias("beta"))
    return stats.stick_breaking_weights(b).select("j", _r("weight", 9).alias("weight"))


@query("select n_nationkey, round(((case when j = n_regionkey then 1 else 0 end) + 1e-8::double) / (1 + 5e-8::double), 12) as p, cast(j as int) as j from nation, range(5) t(j)")
def one_hot_probs(s, d):
    rows = _table(s, d, "nation").select("n_nationkey", F.posexplode(special.smoothed_one_hot("n_regionkey", 5)).alias("j", "p"))
    return rows.select("n_nationkey", _r("p", 12).alias("p"), "j")


@query("select vec_id, round(m + ln(list_sum(list_transform(embedding, lambda x: exp(x::double - m)))), 6) as lse, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as top from (select vec_id, embedding, list_max(embedding)::double as m from embeddings)")
def logsumexp(s, d):
    e = _table(s, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", _r(special.log_sum_exp("v")).alias("lse"), special.argmax("embedding").cast("bigint").alias("top"))


@query("select cast(i as bigint) as id, round(lgamma(i + 1.0::double), 6) as log_factorial from range(1, 2000) t(i)")
def log_factorial(s, d):
    return s.range(1, 2000).select("id", _r(special.log_factorial("id")).alias("log_factorial"))


@query("select l_linenumber, floor((l_extendedprice - 30000.5::double) * 10 + 0.5::double) / 10 as x from lineitem")
def round_half_up(s, d):
    return _table(s, d, "lineitem").select("l_linenumber", special.round_half_up(F.col("l_extendedprice") - 30000.5, 1).alias("x"))


@query("select p_type, try_cast(case when p_size % 2 = 0 then p_size::varchar else p_brand end as int) is not null as is_int, count(*) as n from part group by all")
def is_integer(s, d):
    text = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return _table(s, d, "part").groupBy("p_type", special.is_integer(text).alias("is_int")).agg(F.count("*").alias("n"))


# Normal-Inverse-Wishart


@query(f"with {_A} select k, l, round(n * mean / (1 + n), 9) as mu, 1.0::double + n as kappa, round(1 + scatter + n * mean * mean / (1 + n), 6) as psi, cast(2 + n as int) as nu from sa")
def niw_update(s, d):
    p = blocks.posteriors(blocks.block_stats(_a(s, d), 1), P1).select("k", "l", "niw.*")
    return p.select("k", "l", _r(_at("mu", 0), 9).alias("mu"), "kappa", _r(_at("psi", 0)).alias("psi"), "nu")


@query(f"""with {_A}, r as (select k, l, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as scatter from a where row_id % 2 = 0 group by k, l)
select k, l, round(n * mean / (1 + n), 6) as mu, 1.0::double + n as kappa, round(1 + scatter + n * mean * mean / (1 + n), 6) as psi, cast(2 + n as int) as nu from r""")
def niw_remove(s, d):
    """The odd rows are taken out of each block's statistics again."""
    a = _a(s, d)
    taken = blocks.block_stats(a.where("row_id % 2 = 1"), 1).select("k", "l", F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("scatter").alias("s2"))
    left = blocks.block_stats(a, 1).join(taken, ["k", "l"], "left").select("k", "l", niw.without(1).alias("left")).select("k", "l", "left.*").where("n > 0")
    p = blocks.posteriors(left, P1).select("k", "l", "niw.*")
    return p.select("k", "l", _r(_at("mu", 0)).alias("mu"), "kappa", _r(_at("psi", 0)).alias("psi"), "nu")


@query(f"with {_A} select k, l, round({_lm1('n', 'mean', 'scatter')}, 5) as log_marginal from sa")
def niw_log_marginal(s, d):
    return blocks.log_marginals(blocks.block_stats(_a(s, d), 1), P1).select("k", "l", _r("log_marginal", 5).alias("log_marginal"))


_PSI2 = "(1 + s00 / 1e2::double + n * m0 * m0 / 1e2::double / (1 + n))", "(s01 / 1e6::double + n * m0 * m1 / 1e6::double / (1 + n))", "(1 + s11 / 1e10::double + n * m1 * m1 / 1e10::double / (1 + n))"


@query(f"""with {_D} select k, l, round(-n * ln(pi()) + ln(1.0::double / (1 + n)) + lgamma((3 + n) / 2.0::double) + lgamma((2 + n) / 2.0::double) - lgamma(1.5::double) - lgamma(1.0::double)
  - (3 + n) / 2.0::double * ln({_PSI2[0]} * {_PSI2[2]} - {_PSI2[1]} * {_PSI2[1]}), 3) as log_marginal from sd""")
def niw_log_marginal_2d(s, d):
    items = _items(s, d).withColumn("x", F.array(_at("x", 0) / 1e1, _at("x", 1) / 1e5))
    return blocks.log_marginals(blocks.block_stats(items, 2), P2).select("k", "l", _r("log_marginal", 3).alias("log_marginal"))


_STUDENT = "lgamma((f + 1) / 2) - lgamma(f / 2) - 0.5::double * ln(f * pi()) - 0.5::double * ln(sg) - (f + 1) / 2 * ln(1 + (x - mu) * (x - mu) / sg / f)"


@query(f"""with {_A}, q as (select row_id, col_id, x, n * mean / (1 + n) as mu, 2.0::double + n as f, (1 + scatter + n * mean * mean / (1 + n)) * (2 + n) / ((1 + n) * (2.0::double + n)) as sg from a join sa using (k, l))
select row_id, col_id, round({_STUDENT}, 6) as predictive from q""")
def niw_predictive(s, d):
    a = _a(s, d)
    return a.join(blocks.block_stats(a, 1), ["k", "l"]).select("row_id", "col_id", _r(niw.predictive(P1, "x")).alias("predictive"))


@query(f"""with {_A}, r as (select k, l, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as scatter from a where row_id % 2 = 0 group by k, l)
select k, l, round({_lm1('sa.n', 'sa.mean', 'sa.scatter')} - {_lm1('r.n', 'r.mean', 'r.scatter')}, 4) as joint from sa join r using (k, l)""")
def joint_posterior_predictive(s, d):
    """Odd rows given even ones, by the chain rule."""
    a = _a(s, d)
    whole = blocks.log_marginals(blocks.block_stats(a, 1), P1).select("k", "l", "log_marginal")
    seen = blocks.log_marginals(blocks.block_stats(a.where("row_id % 2 = 0"), 1), P1, "seen").select("k", "l", "seen")
    return whole.join(seen, ["k", "l"]).select("k", "l", _r(F.col("log_marginal") - F.col("seen"), 4).alias("joint"))


@query(f"with {_A} select k, l, round(n * mean / (1 + n), 9) as mean, round((1 + scatter + n * mean * mean / (1 + n)) / n, 9) as cov from sa")
def niw_expectation(s, d):
    c = blocks.components(blocks.block_stats(_a(s, d), 1), P1)
    return c.select("k", "l", _r(_at("mean", 0), 9).alias("mean"), _r(_at("cov", 0), 9).alias("cov"))


@query()
def components_by_view(s, d):
    redundant, correlated, labels = _views(s, d)
    cells = adapters.embeddings(s, d).join(correlated, "col_id").join(labels.withColumnRenamed("view_id", "h"), ["h", "row_id"])
    c = blocks.components(blocks.block_stats(cells, 1, "h", "l", "k"), P1)
    return c.select("h", "l", "k", _r(_at("mean", 0), 9).alias("mean"), _r(_at("cov", 0), 9).alias("cov"))


SQL["components_by_view"] = f"""with {_V.replace('select row_id, col_id, col_id', 'select row_id, col_id, x, col_id')},
t as (select h, l, k, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as scatter from v group by all)
select h, l, k, round(n * mean / (1 + n), 9) as mean, round((1 + scatter + n * mean * mean / (1 + n)) / n, 9) as cov from t"""


_PRIORS = "pr as (select cast(i as int) as col_id, i / 100.0::double as mu0, 1.0::double + i % 3 as kappa0, 1 + i / 10.0::double as psi0, 2 + i % 4 as nu0 from range(64) t(i))"
_OWN = """own as (select *, (kappa0 * mu0 + n * mean) / (kappa0 + n) as mu, (psi0 + scatter + n * kappa0 / (n + kappa0) * (mean - mu0) * (mean - mu0)) / (nu0 + n - 2) as cv from t join pr using (col_id))"""


def _priors() -> dict[int, NIW]:
    return {i: NIW.of((i / 100,), 1 + i % 3, ((1 + i / 10,),), 2 + i % 4) for i in range(64)}


@query(f"""with {_A}, {_PRIORS}, t as (select col_id, k, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as scatter from a group by all), {_OWN}
select col_id, k, round(mu, 9) as mean, round(cv, 9) as cov from own""")
def components_per_column(s, d):
    stats_by = blocks.block_stats(blocks.label_cells(adapters.embeddings(s, d), adapters.embedding_labels(s, d)[0]), 1, "col_id", "k")
    c = blocks.components_per_column_prior(stats_by, _priors())
    return c.select("col_id", "k", _r(_at("mean", 0), 9).alias("mean"), _r(_at("cov", 0), 9).alias("cov"))


# models


@query(f"select round({_crp('embeddings', 'label', 2.5)}, 6) as crp")
def crp_density(s, d):
    return blocks.crp_log_density(adapters.embedding_labels(s, d)[0], 2.5).select(_r("crp").alias("crp"))


@query(f"with {_A} select round(sum({_lm1('n', 'mean', 'scatter')}) + {_crp('rp', 'k', 2.5)}, 3) as log_likelihood from sa")
def dpmm_completed_ll(s, d):
    rows, _ = adapters.embedding_labels(s, d)
    return blocks.completed_log_likelihood(_a(s, d), P1, rows, 2.5).select(_r("log_likelihood", 3).alias("log_likelihood"))


@query(f"with {_A} select round(sum({_lm1('n', 'mean', 'scatter')}) + {_crp('rp', 'k', 2.5)} + {_crp('cp', 'l', 1.5)}, 3) as log_likelihood from sa")
def lbm_completed_ll(s, d):
    rows, cols = adapters.embedding_labels(s, d)
    return blocks.completed_log_likelihood(_a(s, d), P1, rows, 2.5, cols, 1.5).select(_r("log_likelihood", 3).alias("log_likelihood"))


_ROWS = "ra as (select row_id, l, count(*) as rn, avg(x) as rm, var_pop(x) * count(*) as rs from a group by row_id, l)"


@query(f"with {_A}, {_ROWS} select row_id, round(sum({_lm1('rn', 'rm', 'rs')}), 6) as log_prior from ra group by row_id")
def prior_predictive_rows(s, d):
    return blocks.row_prior_predictive(adapters.embeddings(s, d), adapters.embedding_labels(s, d)[1], P1).select("row_id", _r("log_prior").alias("log_prior"))


_W = f"""{_A}, {_ROWS}, ct as (select k, count(*) as c from rp group by k),
m as (select row_id, sa.k, n, mean, scatter, n + rn as nn, mean + (rm - mean) * rn / (n + rn) as nm, scatter + rs + (rm - mean) * (rm - mean) * n * rn / (n + rn) as ns from ra join sa using (l)),
w as (select row_id, k, ln(any_value(c)) + sum({_lm1('nn', 'nm', 'ns')} - {_lm1('n', 'mean', 'scatter')}) as w from m join ct using (k) group by row_id, k)"""


def _weights(s: SparkSession, d: str) -> DataFrame:
    rows, cols = adapters.embedding_labels(s, d)
    counts = rows.groupBy("k").agg(F.count("*").alias("n_k"))
    return blocks.membership_log_weights(adapters.embeddings(s, d), cols, blocks.block_stats(_a(s, d), 1), counts, P1)


@query(f"with {_W} select row_id, k, round(w, 5) as log_weight from w")
def membership_log_weights(s, d):
    return _weights(s, d).select("row_id", "k", _r("log_weight", 5).alias("log_weight"))


@query(f"with {_W}, x as (select row_id, k, exp(w - max(w) over (partition by row_id)) as e from w) select row_id, k, round(e / sum(e) over (partition by row_id), 6) as probability from x")
def membership_probs(s, d):
    return blocks.normalized(_weights(s, d), "row_id").select("row_id", "k", _r("probability").alias("probability"))


@query(f"with {_W} select row_id, arg_max(k, w) as k from w group by row_id")
def map_assignment(s, d):
    return blocks.map_assignment(_weights(s, d), "row_id")


_GAUSS = "-0.5::double * (ln(2 * pi()) + ln(cv) + (x - mu) * (x - mu) / cv)"
_NIWPDF = "(-0.5::double * (ln(2 * pi()) + ln(cv) + mu * mu / cv)) + (-ln(2.0::double) - lgamma(1.0::double) - 2 * ln(cv) - 0.5::double / cv)"


@query(f"""with {_A}, g as (select k, l, n * mean / (1 + n) as mu, (1 + scatter + n * mean * mean / (1 + n)) / n as cv from sa)
select round((select sum({_GAUSS}) from a join g using (k, l)) + (select sum({_NIWPDF}) from g) + {_crp('rp', 'k', 2.5)} + {_crp('cp', 'l', 1.5)}, 3) as log_likelihood""")
def gaussian_lls(s, d):
    rows, cols = adapters.embedding_labels(s, d)
    a = _a(s, d)
    comps = blocks.components(blocks.block_stats(a, 1), P1)
    return blocks.gaussian_log_likelihood(a, comps, P1, [(rows, "k", 2.5), (cols, "l", 1.5)], "k", "l").select(_r("log_likelihood", 3).alias("log_likelihood"))


@query(f"""with {_A}, sk as (select k, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as scatter from a group by k), g as (select k, n * mean / (1 + n) as mu, (1 + scatter + n * mean * mean / (1 + n)) / n as cv from sk)
select round((select sum({_GAUSS}) from a join g using (k)) + (select sum({_NIWPDF}) from g) + {_crp('rp', 'k', 2.5)}, 3) as log_likelihood""")
def gaussian_lls_dpmm(s, d):
    rows, _ = adapters.embedding_labels(s, d)
    a = blocks.label_cells(adapters.embeddings(s, d), rows)
    comps = blocks.components(blocks.block_stats(a, 1, "k"), P1)
    return blocks.gaussian_log_likelihood(a, comps, P1, [(rows, "k", 2.5)], "k").select(_r("log_likelihood", 3).alias("log_likelihood"))


@query(f"""with {_A}, v as (select 0 as view_id, row_id, k % 3 as k from rp union all select 1, row_id, k % 4 from rp),
t as (select col_id, view_id, v.k, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as scatter from a join v using (row_id) group by all)
select col_id, view_id, round(sum({_lm1('n', 'mean', 'scatter')}) + ln(32.0::double), 5) as log_weight from t group by all""")
def redundant_view_weights(s, d):
    redundant, _, labels = _views(s, d)
    sizes = redundant.groupBy(F.col("h").alias("view_id")).agg(F.count("*").alias("size"))
    return blocks.view_log_weights(adapters.embeddings(s, d), labels, sizes, P1).select("col_id", "view_id", _r("log_weight", 5).alias("log_weight"))


# scores, distances, reports


def _score_sql(table: str, a: str, b: str) -> str:
    return f"""with t as (select {a} as a, {b} as b, count(*)::double as n from {table} group by all), x as (select sum(n * (n - 1) / 2) as s, sum(n) as t, sum(n * ln(n)) as h from t),
l as (select sum(n * (n - 1) / 2) as sa, sum(n * ln(n)) as ha, count(*) as k from (select a, sum(n) as n from t group by a)), r as (select sum(n * (n - 1) / 2) as sb, sum(n * ln(n)) as hb from (select b, sum(n) as n from t group by b)),
e as (select *, t * (t - 1) / 2 as p, ln(t) - ha / t as h1, ln(t) - hb / t as h2, ln(t) - h / t as h12 from x, l, r)
select round((s - sa * sb / p) / nullif((sa + sb) / 2 - sa * sb / p, 0), 9) as ari, round((p + 2 * s - sa - sb) / p, 9) as ri, round(2 * (h1 + h2 - h12) / nullif(h1 + h2, 0), 9) as nmi, k as n_clusters from e"""


def _scores(df: DataFrame, a: str, b: str) -> DataFrame:
    return metrics.scores(df, a, b).select(_r("ari", 9).alias("ari"), _r("ri", 9).alias("ri"), _r("nmi", 9).alias("nmi"), "n_clusters")


@query(_score_sql("lineitem", "l_returnflag", "l_linestatus"))
def scores(s, d):
    return _scores(_table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


@query(_score_sql("(select * from documents join labels using (doc_id))", "quality", "lang"))
def scores_of_labels(s, d):
    return _scores(_table(s, d, "documents").select("doc_id", "lang").join(_table(s, d, "labels"), "doc_id"), "quality", "lang")


@query("with v as (select vec_id, embedding::double[] as e from embeddings) select a.vec_id as i, b.vec_id as j, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) as distance from v a, v b")
def distance_matrix(s, d):
    """All pairs of the whole table, n^2 rows."""
    v = _table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return metrics.distance_matrix(v, digits=6)


@query(f"with {_C}, j as (select sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2) as d from c a join c b using (row_id) where a.col_id = 0 and b.col_id = 1) select round(max(d), 6) as dist_max, round(min(d), 6) as dist_min, round(avg(d), 6) as dist_mean from j")
def dist_max_min_mean(s, d):
    c = adapters.events(s, d)
    out = metrics.series_distances(c.where("col_id = 0"), c.where("col_id = 1"), "row_id")
    return out.select(*[_r(x).alias(x) for x in out.columns])


@query("with r as (select n_regionkey as k, count(*) as n from nation group by all), c as (select c_mktsegment as l, count(*) as n from customer group by all) select k, l, cast(sum(r.n * c.n) as bigint) as n from r, c group by cube (k, l)")
def lbm_report(s, d):
    rows = _table(s, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))
    cols = _table(s, d, "customer").groupBy(F.col("c_mktsegment").alias("l")).agg(F.count("*").alias("n"))
    return report.lbm_report(rows, cols)


@query(f"with {_V}, r as (select h as view_id, k, count(distinct row_id) as n from v group by all), c as (select h as view_id, l, count(distinct col_id) as n from v group by all) select view_id, k, l, cast(r.n * c.n as bigint) as n from r join c using (view_id)")
def mcc_report(s, d):
    _, correlated, labels = _views(s, d)
    cols = correlated.groupBy(F.col("h").alias("view_id"), "l").agg(F.count("*").alias("n"))
    return report.mcc_report(labels.groupBy("view_id", "k").agg(F.count("*").alias("n")), cols)


@query("select l_linestatus as l, coalesce(cast(nullif(count(*) filter (l_returnflag = 'A'), 0) as varchar), '-') as \"A\", coalesce(cast(nullif(count(*) filter (l_returnflag = 'N'), 0) as varchar), '-') as \"N\", coalesce(cast(nullif(count(*) filter (l_returnflag = 'R'), 0) as varchar), '-') as \"R\" from lineitem group by all")
def clbm_report(s, d):
    rows = _table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("view_id"), F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    return report.clbm_report(rows, rows.select(F.col("view_id").alias("l")).distinct().withColumn("n", F.lit(1)))


@query(_score_sql("lineitem", "l_returnflag", "l_linestatus").replace("select round(", "select ari_col, round(", 1).replace("as ari,", "as ari_row,").replace("as ri,", "as ri_row,").replace("as nmi,", "as nmi_row,").replace("as n_clusters from e", "as n_row_clusters from e, (select ari as ari_col from (" + _score_sql("part", "p_brand", "p_type") + "))"))
def coclustering_scores(s, d):
    rows = _table(s, d, "lineitem").select(F.col("l_returnflag").alias("e"), F.col("l_linestatus").alias("t"))
    cols = _table(s, d, "part").select(F.col("p_brand").alias("e"), F.col("p_type").alias("t"))
    out = metrics.coclustering_scores(rows, cols, "e", "t")
    return out.select(*[_r(c, 9).alias(c) if c != "n_row_clusters" else c for c in out.columns])


@query("select l_returnflag as k, count(*) filter (l_linestatus = 'F') as \"F\", count(*) filter (l_linestatus = 'O') as \"O\" from lineitem group by all")
def block_grid(s, d):
    sizes = _table(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("l"), F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    return report.grid(sizes).select("k", F.coalesce("F", F.lit(0).cast("bigint")).alias("F"), F.coalesce("O", F.lit(0).cast("bigint")).alias("O"))


_EIGEN = """with c as (select floor(var_samp(p_size) * 1e8 + 0.5::double) / 1e8 as a, floor(covar_samp(p_size, p_retailprice / 100) * 1e8 + 0.5::double) / 1e8 as b, floor(var_samp(p_retailprice / 100) * 1e8 + 0.5::double) / 1e8 as c from part),
r as (select *, (a + c) / 2 as m, sqrt((a - c) * (a - c) / 4 + b * b) as q from c),
v as (select 0 as i, m + q as value, 2 * m as total, a, b from r union all select 1, m - q, 2 * m, a, b from r),
u as (select i, value, value / total as proportion, b / sqrt(b * b + (value - a) * (value - a)) as x, (value - a) / sqrt(b * b + (value - a) * (value - a)) as y from v),
e as (select i, value, proportion, case when (abs(x) >= abs(y) and x < 0) or (abs(y) > abs(x) and y < 0) then -x else x end as x, case when (abs(x) >= abs(y) and x < 0) or (abs(y) > abs(x) and y < 0) then -y else y end as y,
  sum(proportion) over (order by i) as upto from u)"""


def _part_cov(s: SparkSession, d: str):
    x = _table(s, d, "part").select(F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("x"))
    return np.array(stats.covariance_matrix(x, 2).first()["cov"]).reshape(2, 2)


@query(f"{_EIGEN} select i, round(value, 6) as value, round(proportion, 9) as proportion, round(x, 6) as x, round(y, 6) as y from e")
def principal_components(s, d):
    e = metrics.eigen(_part_cov(s, d))
    rows = [(i, float(v), float(p), float(l[0]), float(l[1])) for i, (v, p, l) in enumerate(zip(e.values, e.proportions, e.loadings, strict=True))]
    out = s.createDataFrame(rows, "i int, value double, proportion double, x double, y double")
    return out.select("i", _r("value").alias("value"), _r("proportion", 9).alias("proportion"), _r("x").alias("x"), _r("y").alias("y"))


@query(f"{_EIGEN} select i, round(x, 6) as x, round(y, 6) as y from e where i < least((select min(i) from e where upto > 0.99::double), 3)")
def leading_loadings(s, d):
    rows = [(i, float(l[0]), float(l[1])) for i, l in enumerate(metrics.loadings(_part_cov(s, d)))]
    return s.createDataFrame(rows, "i int, x double, y double").select("i", _r("x").alias("x"), _r("y").alias("y"))


@query(f"{_EIGEN} select i, round(x, 6) as x, round(y, 6) as y, round(proportion, 9) as proportion from e where i < least((select min(i) + 1 from e where upto > 0.5::double), 3)")
def loadings_and_variance(s, d):
    rows, share = metrics.loadings_and_variance(_part_cov(s, d), threshold=0.5)
    out = s.createDataFrame([(i, float(l[0]), float(l[1]), float(p)) for i, (l, p) in enumerate(zip(rows, share, strict=True))], "i int, x double, y double, proportion double")
    return out.select("i", _r("x").alias("x"), _r("y").alias("y"), _r("proportion", 9).alias("proportion"))


@query(f"with {_A} select round(avg(x), 9) as mu, 1.0::double as kappa, round(1 / (floor(var_samp(x) * 1e8 + 0.5::double) / 1e8), 6) as psi, 2 as nu from a")
def empirical_prior(s, d):
    p = niw.empirical_prior(adapters.embeddings(s, d), 1)
    return s.createDataFrame([(float(p.mu[0]), p.kappa, float(p.psi[0, 0]), p.nu)], "mu double, kappa double, psi double, nu int").select(_r("mu", 9).alias("mu"), "kappa", _r("psi").alias("psi"), "nu")


def _weighted(s: SparkSession, d: str, weight: Column) -> DataFrame:
    return _table(s, d, "part").select("p_partkey", weight.cast("bigint").alias("n"), F.array(F.col("p_retailprice") / 3.712345711).alias("mean"), F.array(F.lit(0.0)).alias("scatter"))


@query("select p_partkey, round(p_size * p_retailprice / 3.712345711::double / (1 + p_size), 6) as mu, 1.0::double + p_size as kappa, round(1 + p_size * (p_retailprice / 3.712345711::double) * (p_retailprice / 3.712345711::double) / (1 + p_size), 2) as psi, 2 + p_size as nu from part")
def niw_weighted_update(s, d):
    p = blocks.posteriors(_weighted(s, d, F.col("p_size")), P1).select("p_partkey", "niw.*")
    return p.select("p_partkey", _r(_at("mu", 0)).alias("mu"), "kappa", _r(_at("psi", 0), 2).alias("psi"), "nu")


@query("select p_partkey, round(p_retailprice / 3.712345711::double / 2, 6) as mu, 2.0::double as kappa, round(1 + (p_retailprice / 3.712345711::double) * (p_retailprice / 3.712345711::double) / 2, 4) as psi, 3 as nu from part")
def niw_weighted_remove(s, d):
    """All but one of a vector's weight is taken away again."""
    both = _weighted(s, d, F.col("p_size")).join(_weighted(s, d, F.col("p_size") - 1).toDF("p_partkey", "n2", "m2", "s2"), "p_partkey")
    p = blocks.posteriors(both.select("p_partkey", niw.without(1).alias("left")).select("p_partkey", "left.*"), P1).select("p_partkey", "niw.*")
    return p.select("p_partkey", _r(_at("mu", 0)).alias("mu"), "kappa", _r(_at("psi", 0), 4).alias("psi"), "nu")


@query(f"""with {_A}, {_PRIORS}, la as (select row_id, col_id, x, l, k % (l + 2) as k from a), t as (select col_id, k, count(*) as n, avg(x) as mean, var_pop(x) * count(*) as scatter from la group by all), {_OWN},
data as (select sum({'-0.5::double * (ln(2 * pi()) + ln(cv) + (x - mu) * (x - mu) / cv)'}) as v from la join own using (col_id, k)),
prior as (select sum(-0.5::double * (ln(2 * pi()) + ln(cv / kappa0) + (mu - mu0) * (mu - mu0) / (cv / kappa0)) + nu0 / 2.0::double * ln(psi0) - nu0 / 2.0::double * ln(2.0::double) - lgamma(nu0 / 2.0::double) - (nu0 + 2) / 2.0::double * ln(cv) - 0.5::double * psi0 / cv) as v from own),
rk as (select l, k, count(distinct row_id) as n from la group by all), rw as (select l, count(*) * ln(1.0::double + l) + sum(lgamma(n::double)) - (lgamma(1.0::double + l + sum(n)) - lgamma(1.0::double + l)) as v from rk group by l)
select round((select v from data) + (select v from prior) + (select sum(v) from rw) + {_crp('cp', 'l', 1.5)}
  + (select sum(ln(1.0::double + l) - (1.0::double + l) / 3 - 2 * ln(3.0::double)) from range(4) t(l)) + (2 * ln(1.5::double) - 1.5::double / 0.5::double - 3 * ln(0.5::double) - lgamma(3.0::double)), 2) as log_likelihood""")
def likelihood_by_variable(s, d):
    """Each column its own prior, each column cluster its own row partition and concentration."""
    rows, cols = adapters.embedding_labels(s, d)
    views = rows.select("row_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda l: F.struct(l.alias("l"), (F.col("k") % (l + 2)).alias("k")))).alias("v")).select("v.l", "row_id", "v.k")
    labelled = adapters.embeddings(s, d).join(cols, "col_id").join(views, ["l", "row_id"])
    comps = blocks.components_per_column_prior(blocks.block_stats(labelled, 1, "col_id", "k"), _priors())
    out = blocks.log_likelihood_by_variable(labelled.select("row_id", "col_id", "k", "x"), comps, _priors(), views, {l: 1.0 + l for l in range(4)}, cols, 1.5, (2.0, 3.0), (3.0, 0.5))
    return out.select(_r("log_likelihood", 2).alias("log_likelihood"))


_E = "e as (select vec_id, embedding::double[] as v from embeddings)"


def _e(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query(f"with {_E}, a as (select vec_id, list_transform(v, lambda x: abs(x)) as v from e) select vec_id, round(v[1] / list_sum(v), 9) as first, round(v[64] / list_sum(v), 9) as last from a")
def normalized_weights(s, d):
    p = _e(s, d).select("vec_id", special.normalize(F.transform("v", lambda x: F.abs(x))).alias("p"))
    return p.select("vec_id", _r(_at("p", 0), 9).alias("first"), _r(_at("p", 63), 9).alias("last"))


@query(f"""with {_E}, a as (select vec_id, list_transform(v, lambda x: abs(x)) as v from e), u as (select vec_id, unnest(v) / list_sum(v) as p, unnest(range(64)) as i, (vec_id * 37 % 1000 + 0.5::double) / 1000 as u from a),
c as (select vec_id, i, u, sum(p) over (partition by vec_id order by i) as upto from u) select vec_id, cast(min(i) as int) as category from c where upto >= u group by vec_id""")
def inverse_cdf_sample(s, d):
    p = _e(s, d).select("vec_id", special.normalize(F.transform("v", lambda x: F.abs(x))).alias("p"))
    return p.select("vec_id", special.inverse_cdf("p", (F.col("vec_id") * 37 % 1000 + 0.5) / 1000).cast("int").alias("category"))


@query(f"with {_E} select vec_id, round(v[1] * v[1], 9) as c00, round(v[1] * v[2], 9) as c01, round(v[2] * v[2], 9) as c11, 0.0::double as d01 from e")
def outer_products(s, d):
    x = _e(s, d).withColumn("v", F.slice("v", 1, 2)).select("vec_id", special.outer_product("v").alias("o"), special.outer_product("v", full=False).alias("g"))
    return x.select("vec_id", _r(_at("o", 0), 9).alias("c00"), _r(_at("o", 1), 9).alias("c01"), _r(_at("o", 3), 9).alias("c11"), _at("g", 1).alias("d01"))


@query(f"with {_E} select vec_id, round(v[4], 9) as removed, 64 - 1 as n_removed, round(v[3], 9) as inserted, 64 + 1 as n_inserted, 7.0::double as put, round(v[3], 9) as after, 64 + 2 as n_all from e")
def list_edits(s, d):
    x = _e(s, d).select("vec_id", special.remove_at(F.col("v"), 2).alias("r"), special.insert_at(F.col("v"), 2, F.lit(7.0)).alias("i"), special.insert_all(F.col("v"), 2, F.array(F.lit(7.0), F.lit(8.0))).alias("a"))
    return x.select("vec_id", _r(_at("r", 2), 9).alias("removed"), F.size("r").alias("n_removed"), _r(_at("i", 3), 9).alias("inserted"), F.size("i").alias("n_inserted"), _at("i", 2).alias("put"), _r(_at("a", 4), 9).alias("after"), F.size("a").alias("n_all"))


@query(f"with {_E} select a.vec_id, list_bool_and(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]) <= 0.2::double)) as close, a.v = b.v as same from e a join e b on b.vec_id = a.vec_id - a.vec_id % 3")
def all_equal(s, d):
    b = _e(s, d).select(F.col("vec_id").alias("other"), F.col("v").alias("w"))
    both = _e(s, d).join(b, F.col("vec_id") - F.col("vec_id") % 3 == F.col("other"))
    return both.select("vec_id", special.all_equal("v", "w", 0.2).alias("close"), special.all_equal("v", "w").alias("same"))


@query(f"with {_E} select vec_id, floor(v[1] * 100 + 0.5::double) / 100 as first, floor(v[2] * 100 + 0.5::double) / 100 as second from e")
def round_vectors(s, d):
    r = _e(s, d).select("vec_id", special.round_vector("v", 2).alias("r"))
    return r.select("vec_id", _at("r", 0).alias("first"), _at("r", 1).alias("second"))


@query(f"with {_A} select l, round(avg(x), 9) as mean from a group by l")
def vector_means(s, d):
    return stats.vector_mean(_a(s, d), 1, "x", "l").select("l", _r(_at("mean", 0), 9).alias("mean"))


@query(f"with {_V} select h as view_id, array_to_string(list(k order by row_id), ',') as labels from v where col_id < 2 group by h")
def view_labels(s, d):
    _, _, labels = _views(s, d)
    return partition.view_labels(labels).select("view_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(f"with {_C} select col_id, cast(count(*) as int) as n, round(list(x0 order by row_id)[1], 6) as first, round(list(x0 order by row_id desc)[1], 6) as last from c group by col_id")
def columns_as_arrays(s, d):
    xs = matrix.columns_of(adapters.events(s, d))
    return xs.select("col_id", F.size("xs").alias("n"), _r(F.get(F.get("xs", F.lit(0)), F.lit(0))).alias("first"), _r(F.get(F.element_at("xs", -1), F.lit(0))).alias("last"))


# generators and samplers: rows only


MODES = [[(1.9, 1.9), (1.4, -1.4)], [(-1.7, 1.7), (-1.7, -1.7)], [(-3.0, -3.0), (5.0, 5.0)]]
COVS = [[((0.25, 0.2), (0.2, 0.25)), ((0.17, 0.1), (0.1, 0.17))], [((0.12, 0.0), (0.0, 0.12)), ((0.3, 0.0), (0.0, 0.3))], [((0.22, 0.0), (0.0, 0.15)), ((0.1, 0.0), (0.0, 0.1))]]


def _flat(cells: DataFrame) -> DataFrame:
    return cells.select("row_id", "col_id", _at("x", 0).alias("x0"), _at("x", 1).alias("x1"), *[c for c in ("k", "l") if c in cells.columns])


@query()
def generate_mixture(s, d):
    return _flat(generators.mixture(s, MODES[0] + MODES[1], COVS[0] + COVS[1], [50] * 4))


@query()
def generate_lbm(s, d):
    return _flat(generators.lbm(s, MODES, COVS, [30, 30], [15, 15, 15], mixing=0.1, shuffle=True))


@query()
def dpmm_run(s, d):
    cells = generators.mixture(s, MODES[0] + MODES[1], COVS[0] + COVS[1], [50] * 4)
    return Clustering(Concentration(alpha=5.0), sweeps=100).run(cells, 2)


@query()
def lbm_run(s, d):
    cells = generators.lbm(s, MODES, COVS, [30, 30], [15, 15, 15])
    return Coclustering(Concentration(alpha=10.0), Concentration(alpha=10.0), iterations=20).run(cells, 2)


@query()
def multiview_run(s, d):
    one = generators.lbm(s, MODES[:2], COVS[:2], [30, 30], [15, 15], seed=1)
    two = generators.lbm(s, [MODES[0], MODES[2]], [COVS[0], COVS[2]], [20, 40], [20, 10], seed=2)
    cells = generators.beside(one.drop("k", "l"), two.drop("k", "l"))
    return MultiViewBlocks((10, 5), (100, 200), (10, 1), iterations=20).run(cells, 2)


@query()
def posterior_samples(s, d):
    """A draw from the posterior of each block, and of each row cluster."""
    a = _a(s, d)
    by_block = blocks.posterior_samples(blocks.block_stats(a, 1, "k", "l"), P1, seed=3)
    by_cluster = blocks.posterior_samples(blocks.block_stats(a, 1, "k"), P1, seed=3).withColumn("l", F.lit(None).cast("int"))
    return by_block.unionByName(by_cluster).select("k", "l", _at("mean", 0).alias("mean"), _at("cov", 0).alias("cov"))


@query()
def dpmm_events(s, d):
    """Users clustered by their five event types, and the components of the last partition."""
    cells = adapters.events(s, d)
    trace = Clustering(Concentration(prior=(1.0, 2.0)), sweeps=20).run(cells, 2).where("item_id is not null")
    prior = niw.empirical_prior(cells, 2)
    labelled = cells.withColumn("l", F.col("col_id")).join(last_partition(trace), "row_id")
    return blocks.components(blocks.block_stats(labelled, 2, "chain_id", "k", "l"), prior)
