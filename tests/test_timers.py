"""Streams with timers over several batches, against plain loops over the rows that the watermark closed."""

import random

from pyspark.sql import functions as F

from prismfield.streaming import timers as S
from prismfield.streaming.sessions import run_to_table

MS = 1000
SCHEMA = "event_id long, user_id long, event_type string, value double, event_time timestamp"


def _rows(seed, n=400):
    r = random.Random(seed)
    out = [(i, r.choice([1, 1, 2]), r.choice(["view", "click"]), r.choice([10.0, 10.0, 90.0]), r.randrange(100_000) * MS) for i in range(n)]
    return sorted(out, key=lambda x: x[4])


def _stream(spark, tmp_path, rows, parts=5):
    """The rows as files that come one a batch, each later in time than the one before."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        df = spark.createDataFrame(rows[k * size : (k + 1) * size], "event_id long, user_id long, event_type string, value double, us long")
        df.withColumn("event_time", F.timestamp_micros("us")).drop("us").coalesce(1).write.mode("append").parquet(str(tmp_path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def _run(spark, df):
    with S.rocks_state(spark):
        return run_to_table(df).collect()


def test_asof_settles_each_closed_target_once(spark, tmp_path):
    rows = _rows(1)
    rows[100:100] = [(1000, None, "view", 1.0, rows[100][4])]
    reach, stretch = 900 * MS, 7_000 * MS
    before = spark.conf.get(S.PROVIDER, None)
    got = _run(spark, S.asof_when_closed(_stream(spark, tmp_path, rows), F.col("event_type") == "view", F.col("event_type") == "click", reach, stretch, "1 second"))
    assert spark.conf.get(S.PROVIDER, None) == before
    passed = max(r[4] for r in rows) - 1_000 * MS
    want = set()
    for i, user, kind, _, us in rows:
        if kind != "view" or user is None or (us // stretch + 1) * stretch + reach > passed:
            continue
        near = min(((abs(c[4] - us), c[4], c[0]) for c in rows if c[1] == user and c[2] == "click" and abs(c[4] - us) <= reach), default=None)
        want.add((user, i, near and near[2], near and near[0]))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r[2] is None for r in want) and any(r[2] is not None for r in want)


def test_poses_over_several_batches(spark, tmp_path):
    rows = _rows(2)
    stretch, move, still = 7_000 * MS, 2, 3
    got = _run(spark, S.poses_when_closed(_stream(spark, tmp_path, rows), F.col("value") > 40, stretch, "1 second", move, still))
    passed = max(r[4] for r in rows) - 1_000 * MS
    want = set()
    for user in (1, 2):
        own = sorted((r[4], r[0], r[3] > 40) for r in rows if r[1] == user)
        moving, at = [m for _, _, m in own], 0
        noise = [False] * len(own)
        while at < len(own):
            end = at
            while end < len(own) and moving[end] == moving[at]:
                end += 1
            for k in range(at, end):
                noise[k] = moving[at] and end - at >= move
            at = end
        first = None
        for k, stop in enumerate([*noise, None]):
            if stop is False and first is None:
                first = k
            elif stop is True and first is not None:
                if k - first >= still and (own[k + move - 1][0] // stretch + 1) * stretch <= passed:
                    want.add((user, first + 1, k, k - first, own[first][0], own[k - 1][0]))
                first = None
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 5


def test_an_empty_stream_emits_nothing(spark, tmp_path):
    assert _run(spark, S.poses_when_closed(_stream(spark, tmp_path, [], 1), F.col("value") > 40, 1_000 * MS, "1 second")) == []
