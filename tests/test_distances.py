"""The distance matrix over the whole of a table."""

import math
from collections import Counter

import duckdb
import numpy as np

from strataweave.operators import metrics
from strataweave.plans.queries import QUERIES, SQL


def test_distance_matrix(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = {int(i): rng.normal(size=4).astype("f4") for i in (0, 3, 49, 50, 51, 700)}
    spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["distance_matrix"](spark, str(tmp_path)).collect()
    assert len(got) == 36
    want = {(i, j): math.dist(x[i].astype(float), x[j].astype(float)) for i in x for j in x}
    assert {(r["i"], r["j"]) for r in got} == set(want)
    assert all(abs(r["distance"] - want[r["i"], r["j"]]) < 1e-5 for r in got)


def test_null_and_repeated_ids(spark, tmp_path):
    """As many rows as the SQL gives, whatever the ids."""
    rows = [(1, [0.0, 0.0]), (1, [3.0, 4.0]), (None, [0.0, 1.0]), (2, [0.0, 2.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = Counter(map(tuple, QUERIES["distance_matrix"](spark, str(tmp_path)).collect()))
    assert got == Counter(db.sql(SQL["distance_matrix"]).fetchall())


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrics, "BLOCK", 7)
    x = np.random.default_rng(3).normal(size=(40, 5))
    got = metrics.distance_matrix(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")).collect()
    assert Counter((r["i"], r["j"]) for r in got) == Counter((i, j) for i in range(40) for j in range(40))
    assert all(abs(r["distance"] - math.dist(x[r["i"]], x[r["j"]])) < 1e-12 for r in got)


def test_rounded_in_the_blocks(spark, monkeypatch):
    """Rounding is the operator's, halves up, and leaves null, infinite and huge distances as they are."""
    monkeypatch.setattr(metrics, "BLOCK", 3)
    rows = [(0, [0.0]), (1, [0.5]), (2, [1.25]), (3, [0.3749]), (4, None), (5, [None]), (6, [1.0, 2.0]), (7, [float("inf")]), (8, [1e308 ** 0.5])]
    table = spark.createDataFrame(rows, "id bigint, x array<double>")
    got = {(r["i"], r["j"]): r["distance"] for r in metrics.distance_matrix(table, digits=1).collect()}
    assert len(got) == 81
    assert (got[0, 1], got[0, 2], got[2, 0], got[3, 0], got[1, 3], got[6, 6]) == (0.5, 1.3, 1.3, 0.4, 0.1, 0.0)
    assert all(got[k, j] is None and got[j, k] is None for k in (4, 5) for j in range(9)) and got[6, 0] is None
    assert got[7, 0] == got[0, 7] == float("inf") and got[0, 8] == 1e308 ** 0.5 and math.isnan(got[7, 7])


def test_a_vector_is_shuffled_once(spark, monkeypatch):
    """However many blocks there are, rows are not copied for each of them: both sides read one exchange of the vectors."""
    monkeypatch.setattr(metrics, "BLOCK", 2)
    found = metrics.distance_matrix(spark.createDataFrame([(i // 3, [float(i % 5)]) for i in range(50)], "id bigint, x array<double>"))
    assert len(found.collect()) == 2500
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate" not in plan and plan.count("ReusedExchange") == 1 and plan.count("ShuffleQueryStage") == 2
