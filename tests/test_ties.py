"""Queries against their SQL and against values by hand, on rows that share a time, an id or a mean."""

from datetime import datetime, timedelta

import duckdb
import pytest

from prismfield.plans import catalog

START = datetime(2024, 1, 1)


def both(spark, tmp_path, name, table, rows, schema, order="id"):
    """Rows of a query, and of its SQL, over one small table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path)).orderBy(order)
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    columns = got.columns
    return [tuple(r) for r in got.collect()], c.sql(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]}) order by {order}").fetchall()


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_rate_of_one_sample_and_of_samples_at_one_time(spark, tmp_path):
    rows = [(1, at(0), 1, "view", 1.0), (2, at(5), 2, "view", 1.0), (3, at(5), 2, "view", 1.0), (4, at(0), 3, "view", 1.0), (5, at(4), 3, "view", 1.0)]
    got, want = both(spark, tmp_path, "continuity_stats", "events", rows, EVENTS, "user_id")
    assert [repr(r) for r in got] == [repr(r) for r in want]
    assert [repr(r[3]) for r in got] == ["nan", "inf", "0.25"]


TIED = [(10, at(100), 1, "view", 0.0), (11, at(200), 1, "view", 0.0), (12, at(300), 1, "view", 0.0), *((i, at(90), 1, "click", float(v)) for i, v in ((25, 3.0), (21, 9.0), (23, 1.0))), *((i, at(240), 1, "click", float(v)) for i, v in ((35, 2.0), (31, 5.0), (33, 1.0))), *((i, at(280), 1, "purchase", 0.0) for i in (47, 41, 44))]


def test_nearest_of_events_at_one_time_is_the_one_of_smallest_id(spark, tmp_path):
    got, want = both(spark, tmp_path, "asof_nearest_events", "events", TIED, EVENTS)
    assert got == want == [(10, 21, -10.0), (11, 31, 40.0), (12, 31, -60.0)]


def test_within_tolerance_of_events_at_one_time_is_the_one_of_smallest_id(spark, tmp_path):
    got, want = both(spark, tmp_path, "asof_within_tolerance", "events", [*TIED, (13, at(5000), 1, "view", 0.0)], EVENTS)
    assert got == want == [(10, 21), (11, 31), (12, 31), (13, None)]


def test_fan_out_asks_the_message_of_smallest_id(spark, tmp_path):
    got, want = both(spark, tmp_path, "nearest_fan_out", "events", TIED, EVENTS, "message")
    assert got == want == [(21, 1, "10", 10.0), (31, 2, "11,12", 60.0)]


def test_triplets_take_images_and_poses_of_smallest_id(spark, tmp_path):
    got, want = both(spark, tmp_path, "sync_triplets", "events", TIED, EVENTS)
    assert got == want and [r[:3] for r in got] == [(10, 21, 41), (11, 31, 41), (12, 31, 41)]


def test_interpolation_between_samples_at_one_time_is_between_those_of_smallest_id(spark, tmp_path):
    got, want = both(spark, tmp_path, "pose_interpolation", "events", TIED, EVENTS)
    assert got == want == [(10, pytest.approx(9.0 - 4.0 * 10 / 150, abs=1e-4), 10.0), (11, pytest.approx(9.0 - 4.0 * 110 / 150, abs=1e-4), 40.0), (12, 5.0, 60.0)]


def test_means_that_spread_by_just_the_limit_are_known(spark, tmp_path):
    line = "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"
    rows = [(n, 1, 1, 1, 1.0, 1.0, d, 0.0, "A", at(0)) for n, d in ((0, 0.01), (1, 0.07))]  # 0.07 * 100 - 0.01 * 100 is above 6 in doubles
    got, want = both(spark, tmp_path, "temporal_consensus", "lineitem", rows, line, "pixel")
    assert got == want == [(1, 2, 4.0, 6.0)]
