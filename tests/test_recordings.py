"""Recordings in splits: round trips, what filters pass over, errors."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from prismfield.sources import recordings as S

ROWS = [(r, f"/{'ab'[k % 2]}", k, 1000 + k // 3, None if k % 7 == 0 else bytes([k % 256, r])) for r in (1, 2) for k in range(100)] + [(1, "/a", 5, 1001, b"again")] * 2


@pytest.fixture
def base(spark, tmp_path):
    S.register(spark)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    S.sorted_for_writing(spark.createDataFrame(ROWS, S.SCHEMA), 3).write.format("recording").option("messages", 16).mode("overwrite").save(path)
    return path


def _read(spark, base, **options):
    return spark.read.format("recording").options(**options).load(base)


def _plain(rows):
    return sorted([(r, t, i, s, d and bytes(d)) for r, t, i, s, d in rows], key=repr)


def _list(base):
    return [json.loads(line) for line in open(f"{base}/{S.LIST}")]


def test_all_rows_come_back_from_splits_of_bounded_size(spark, base):
    assert _plain(_read(spark, base).collect()) == _plain(ROWS)
    splits = _list(base)
    assert max(s["n"] for s in splits) == 16 and sum(s["n"] for s in splits) == len(ROWS) and _read(spark, base).rdd.getNumPartitions() == len(splits)


def test_long_payloads_end_a_split_early(spark, base, tmp_path):
    rows = [(1, "/a", k, k, b"x" * 100) for k in range(20)]
    df = S.sorted_for_writing(spark.createDataFrame(rows, S.SCHEMA), 1)
    df.write.format("recording").option("bytes", 250).mode("overwrite").save(f"{tmp_path}/long")
    assert [s["n"] for s in _list(f"{tmp_path}/long")] == [3] * 6 + [2] and _plain(_read(spark, f"{tmp_path}/long").collect()) == _plain(rows)


@pytest.mark.parametrize("rule", ["recording = 2", "topic = '/a' AND stamp > 1010", "stamp = 1005", "topic IN ('/b', '/c') AND stamp BETWEEN 1004 AND 1020", "topic = '/none'", "stamp < 1000 OR id = 3", "topic = '/a' AND topic = '/b'", "data IS NULL AND stamp <= 1004"])
def test_filters_equal_spark_filters(spark, base, rule):
    want = spark.createDataFrame(ROWS, S.SCHEMA).where(rule).collect()
    assert _plain(_read(spark, base).where(rule).collect()) == _plain(want)


def test_filters_pass_over_whole_splits(spark, base):
    late = _read(spark, base).where("recording = 2 AND stamp >= 1030")
    assert 0 < late.rdd.getNumPartitions() < len([s for s in _list(base) if s["recording"] == 2])


def test_conversion_keeps_order_and_renames_by_the_longest_prefix(spark, base, tmp_path):
    S.convert(spark, base, f"{tmp_path}/to", ["/a"], {"/": "/rig/", "/a": "/rig/left"}, 5)
    want = [(r, "/rig/left", i, s, d) for r, t, i, s, d in ROWS if t == "/a"]
    got = _read(spark, f"{tmp_path}/to")
    assert _plain(got.collect()) == _plain(want) and max(s["n"] for s in _list(f"{tmp_path}/to")) == 5


def test_bad_recordings_are_named(spark, base, tmp_path):
    with pytest.raises(Exception, match="no list of splits"):
        _read(spark, f"{tmp_path}/nowhere").collect()
    with pytest.raises(Exception, match="no topic.*/c"):
        _read(spark, base, topics="/a,/c").collect()
    assert {r["topic"] for r in _read(spark, base, topics="/a").collect()} == {"/a"}
    with pytest.raises(Exception, match="without a recording"):
        spark.createDataFrame([(1, None, 1, 1, None)], S.SCHEMA).write.format("recording").mode("overwrite").save(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="overwrite"):
        spark.createDataFrame(ROWS, S.SCHEMA).write.format("recording").mode("append").save(base)
    first = _list(base)[0]
    lines = open(f"{base}/{S.LIST}").read().replace(json.dumps(first), json.dumps(first | {"n": 99}))
    open(f"{base}/{S.LIST}", "w").write(lines)
    with pytest.raises(Exception, match="its list says 99"):
        _read(spark, base).collect()


def test_an_empty_table_is_an_empty_recording(spark, tmp_path):
    S.register(spark)
    spark.createDataFrame([], S.SCHEMA).write.format("recording").mode("overwrite").save(f"{tmp_path}/empty")
    assert _read(spark, f"{tmp_path}/empty").collect() == [] and _read(spark, f"{tmp_path}/empty").where(F.col("stamp") > 3).count() == 0


def test_a_stride_goes_on_from_split_to_split(spark, base):
    order = sorted(ROWS, key=lambda x: (x[0], x[3], x[2]))
    want = [row for r in (1, 2) for t in ("/a", "/b") for row in [x for x in order if x[:2] == (r, t)][::3]]
    assert _plain(_read(spark, base, stride=3).collect()) == _plain(want)
    late = _read(spark, base, topics="/b", stride=3).where("stamp >= 1010")
    assert _plain(late.collect()) == _plain([x for x in want if x[1] == "/b" and x[3] >= 1010])


def test_topic_scan_writes_a_recording_in_many_splits(spark):
    from prismfield.plans import catalog

    got = catalog.QUERIES["recording_topic_scan"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BinaryFile" not in plan and "binaryFile" not in plan and "recording" in plan and got.count() > 0
