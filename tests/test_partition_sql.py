"""Partitions against their SQL where rows lack views."""

import duckdb

from strataweave.plans.queries import QUERIES, SQL


def test_joint_row_partition(spark, tmp_path):
    rows = [(0, "a", 60.0), (0, "b", 40.0), (1, "a", 60.0), (2, "b", 60.0), (3, "c", 60.0), (3, "a", 40.0), (4, "a", 60.0), (4, "c", 40.0), (5, "a", None), (6, "b", 10.0), (7, None, 60.0), (7, "a", 10.0), (8, "a", 10.0), (8, "b", 99.0), (None, "c", 1.0), (None, "a", 1.0)]
    spark.createDataFrame(rows, "user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    key = lambda r: (r[0] is None, r)
    got = sorted(map(tuple, QUERIES["joint_row_partition"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(db.sql(SQL["joint_row_partition"]).fetchall(), key=key)


def test_a_mean_of_just_50_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Six decimals with the sum 300: added up as doubles, in the first order they give a mean over 50, in the second one under it."""
    over, under = (2.18, 113.34, 37.43, 93.72, 36.91, 16.42), (113.34, 37.43, 16.42, 93.72, 36.91, 2.18)
    huge, spoilt = (1e300, -1e299), (float("nan"),)
    rows = [(i, "a", v) for i, vs in enumerate((over, under, (50.0,), (50.00000000000001,), huge, spoilt, (None, 1e19, 1e19))) for v in vs]
    spark.createDataFrame(rows, "user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["row_id"]: r["label"] for r in QUERIES["joint_row_partition"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1}
