"""Steps whose cost once grew faster than their input, on small examples."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismfield.operators import kernels as K
from prismfield.plans import catalog

D = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["prior_gate_cascade", "snapped_grid_lines"])
def test_choices_are_kept_in_place_without_a_sort(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, D))
    assert "HashAggregate" in plan and "SortAggregate" not in plan and plan.count("Generate") <= (name == "snapped_grid_lines") * plan.count("Scan parquet")


def test_small_groups_share_calls_and_stay_whole(spark):
    rows = [(k, g, i) for k in range(1500) for g in ("a", None) for i in range(1 + (k % 5 == 0) * 7)]
    df = spark.createDataFrame(rows, "k long, g string, i long").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        def fn(pdf):
            sizes = [len(g) for g in K.each_group(pdf, ["k", "g"])]
            return pd.DataFrame([(len(sizes), sum(sizes), len(pdf.drop_duplicates(["k", "g"])))], columns=["groups", "n", "distinct"])

        got = K.whole_groups(df, ["k", "g"], "groups long, n long, distinct long", fn).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got["groups"].sum() == got["distinct"].sum() == 3000 and got["n"].sum() == len(rows)
    assert len(got) < 300  # one call a group would be 3000


def test_a_group_longer_than_batches_stays_whole(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.createDataFrame([(0, i) for i in range(95)] + [(k, k) for k in range(1, 4)], "k long, i long").coalesce(1)
        fn = lambda pdf: pdf.groupby("k", as_index=False).agg(n=("i", "size"))
        assert sorted(map(tuple, K.whole_groups(df, ["k"], "k long, n long", fn).collect())) == [(0, 95), (1, 1), (2, 1), (3, 1)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_nearest_distances_equal_a_plain_sort_and_hold_a_block_only():
    import tracemalloc

    p = np.random.default_rng(5).normal(size=(1500, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = np.sort(d, axis=1)[:, 1:9].mean(1)
    tracemalloc.start()
    got = K.knn_mean(p, 8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, want, rtol=0, atol=1e-12) and most < 6e6
    assert np.isnan(K.knn_mean(p[:1], 8)).all() and np.allclose(K.knn_mean(p[:2], 8), d[0, 1])


def test_files_are_written_many_a_call_and_read_many_a_batch(spark, tmp_path):
    from prismfield.sinks import files as W
    from prismfield.sources import files as R

    df = spark.range(600).select((F.col("id") % 200).alias("frame"), *(F.col("id").cast("double").alias(c) for c in "xyz"))
    out = W.write_groups(df, "frame", f"file://{tmp_path}/clouds", ".ply", W.binary_ply)
    assert "FlatMapGroupsInPandas" not in _plan(out) and out.agg(F.sum("n_bytes")).first()[0] > 0
    got = R.read_files(spark, f"file://{tmp_path}/clouds", "*.ply", "frame long, x double, y double, z double", R.parse_cloud_file)
    assert sorted(map(tuple, got.select("frame", "x").collect())) == sorted((i % 200, float(i)) for i in range(600))


def test_sightings_are_not_shuffled_in_every_round(spark):
    from prismfield.operators import odometry as O

    rows = [(0, s, bool(i % 2), *np.random.default_rng(i).normal(size=6).tolist()) for s in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, f"graph long, step long, known boolean, {', '.join(f'{c} double' for c in O.SIGHT)}")
    held, name = O._stored_by_step(df, len(rows))
    try:
        met = O._beside(held, df.select("graph", "step").distinct().withColumn("mark", F.col("step") * 2))
        plan = _plan(met)
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Bucketed: true" in plan
        assert met.count() == len(rows) and met.where("mark <> 2 * step").count() == 0
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_users_of_a_share_settle_together(spark, tmp_path):
    from prismfield.streaming import timers as S
    from prismfield.streaming.sessions import run_to_table

    ms = 1000
    rows = [(100 * u + i, u, "view" if i % 2 else "click", 90.0 if i % 7 > 4 else 1.0, (i * 37 + u + 1) * ms) for u in range(40) for i in range(30)] + [(9999, 999, "none", 1.0, 10**9)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, us long")
    df.withColumn("event_time", F.timestamp_micros("us")).drop("us").write.parquet(str(tmp_path / "in"))

    def run(make, **more):
        with S.rocks_state(spark):
            return run_to_table(make(spark.readStream.schema("event_id long, user_id long, event_type string, value double, event_time timestamp").parquet(str(tmp_path / "in")), **more)).collect()

    asof = lambda e, **m: S.asof_when_closed(e, F.col("event_type") == "view", F.col("event_type") == "click", 50 * ms, 400 * ms, "1 second", **m)
    got = run(asof, shares=2)
    own = {u: [r for r in rows if r[1] == u and r[2] == "click"] for u in range(40)}
    want = {(r[1], r[0], *min((abs(c[4] - r[4]), c[4], c[0]) for c in own[r[1]])[::-2]) for r in rows if r[2] == "view"}
    assert {tuple(r) for r in got} == want and len(got) == 600
    poses = lambda e, **m: S.poses_when_closed(e, F.col("value") > 40, 400 * ms, "1 second", **m)
    got = [tuple(r) for r in run(poses, shares=2)]
    assert len(got) == 40 * 4 and {r[1:4] for r in got} == {(1 + 7 * k, 5 + 7 * k, 5) for k in range(4)}


def test_hits_equal_the_plain_sum_even_at_the_threshold():
    from prismfield.operators import planes as P

    r = np.random.default_rng(3)
    xyz = np.concatenate([r.normal(size=(3000, 3)) * 5, r.integers(-40, 40, (500, 3)) / 100])
    h = np.concatenate([r.normal(size=(40, 4)), np.eye(4)[:3], [[0.6, 0.8, 0.0, 0.02]]]).T.copy()
    h[:3] /= np.linalg.norm(h[:3], axis=0)
    x, y, z = xyz.T[:, :, None]
    want = (np.abs(h[0] * x + h[1] * y + h[2] * z + h[3]) < 0.02).sum(0)
    assert (P._hits(xyz, h, 0.02) == want).all() and want.min() > 0


def test_drawing_sorts_a_bounded_part_and_notices_repeated_ids(spark):
    from prismfield.operators import planes as P
    from prismfield.sources import adapters as A

    r = np.random.default_rng(4)
    pts = r.normal(size=(4000, 3))
    df = spark.createDataFrame([(k, "same" if k else f"{i}", *map(float, p)) for k in (0, 1) for i, p in enumerate(pts)], "k int, id string, x double, y double, z double")
    state = A.stored(P.unpeeled(df, ["k"]), "state")
    args = (df, state, ["k"], 0.02, 10, F.lit(0), "id", True)
    part = P.draw(*args)
    assert "md5" in (plan := _plan(part)) and plan.index("Window") < plan.index("bound#") and "< bound#" in plan
    got, whole = ({x.k: (x.n, x.kept, sorted(x.h or [])) for x in d.collect()} for d in (part, P.draw(*args, False)))
    assert got[0] == whole[0] and whole[0][:2] == (4000, 30) and len(whole[0][2]) == 10 and whole[1][1] == 30
    assert P.best_planes(df, ["k"], 0.02, 10, F.lit(0), "id", A.stored).count() == 2


def test_patches_reach_the_points_without_a_shuffle_of_them(spark):
    from prismfield.operators import planes as P
    from prismfield.sources import adapters as A

    rows = [(1, i * 0.1, j * 0.1) for i in range(20) for j in range(20)] + [(1, 50.0, 50.0), (2, 0.0, 0.0)]
    flat = A.stored(spark.createDataFrame(rows, "k int, u double, v double"), "flat")
    got = P.in_patches(flat, ["k"], 0.5, A.stored)
    assert sorted(map(tuple, got.select("k", "u", "v").collect())) == sorted(r for r in rows if r[1] < 50)
    assert "BroadcastHashJoin" in _plan(got) and "SortMergeJoin" not in _plan(got)


def test_nearest_points_shuffle_one_row_a_point(spark):
    from prismfield.operators import registration as R
    from prismfield.sources import adapters as A

    r = np.random.default_rng(6)
    a, b = r.uniform(0, 3, (60, 3)), r.uniform(0, 3, (90, 3))
    rows = lambda m: spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(m)], "k int, id int, x double, y double, z double")
    around = A.stored(R.surroundings(rows(b), ["k"], 0.5), "around")
    near = R.nearest_of(rows(a), around, ["k"], 0.5)
    assert "Generate explode(sequence" not in _plan(near) and "Aggregate" not in _plan(near)
    got = {x.id: (x.fx, x.d2) for x in near.collect()}
    d2 = ((a[:, None] - b[None]) ** 2).sum(2)
    want = {i: (b[d2[i].argmin(), 0], d2[i].min()) for i in range(60) if d2[i].min() <= 0.25}
    assert got.keys() == want.keys() and 0 < len(got) < 60 and all(np.allclose(got[i], want[i], rtol=0, atol=1e-12) for i in got)


def test_rounds_of_motions_are_no_jobs_of_their_own(spark):
    from prismfield.operators import odometry as O
    from prismfield.sources import adapters as A

    made = []
    cut = lambda df, label: made.append(label) or A.stored(df, label)
    rows = [(0, s, bool(i % 2), *np.random.default_rng(i).normal(size=6).tolist()) for s in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, f"graph long, step long, known boolean, {', '.join(f'{c} double' for c in O.SIGHT)}")
    assert O.solve_motions(df, cut, rounds=8).count() == 3 and len(made) == 2  # once three and a table a round


def _ring(spark, n, loops):
    from prismfield.operators import posegraph as G

    node = spark.range(n).select(F.lit(0).cast("long").alias("graph"), F.col("id").alias("node"))
    yaw = F.col("node") * 0.3 + F.sin("node") * 0.02
    poses = node.select("graph", "node", F.array(F.cos(yaw) * 3, F.sin(yaw) * 3, F.lit(0.0)).alias("t"), F.array(F.lit(0.0), F.lit(0.0), F.sin(yaw / 2), F.cos(yaw / 2)).alias("q"))
    seen = spark.createDataFrame([(0, i, j, [0.1, 0.0, 0.02 * i % 0.3], [0.0, 0.0, 0.0, 1.0], 50.0) for i, j in loops], "graph long, i long, j long, t array<double>, q array<double>, weight double")
    return poses, G.graph_edges(poses, seen, poses.select("graph", "node", F.when(F.col("node") % 3 != 1, F.lit(1.2)).alias("distance")))


@pytest.mark.parametrize(("segment", "fan", "loops"), [(8, 2, [(3, 24), (3, 45), (9, 14), (9, 60), (33, 38), (34, 38), (0, 21)]), (64, 8, [(2, 9), (2, 30), (11, 52), (0, 40)]), (5, 3, [(k, k + 21) for k in range(0, 40, 2)])])
def test_runs_of_poses_are_solved_as_the_whole_system_is(spark, monkeypatch, segment, fan, loops):
    from prismfield.operators import posegraph as G

    poses, edges = _ring(spark, 70, loops)
    want = {r.node: r for r in G.optimise(poses, edges, most_steps=2).collect()}  # one segment: a dense solve of what runs leave
    for name, value in {"SEGMENT": segment, "FAN": fan, "TOGETHER": 3, "PART": 20}.items():
        monkeypatch.setattr(G, name, value)
    got = {r.node: r for r in G.optimise(poses, edges, most_steps=2).collect()}
    assert got.keys() == want.keys() and len(got) == 70
    assert all(np.allclose(got[k].t, want[k].t, rtol=0, atol=1e-8) and np.allclose(got[k].q, want[k].q, rtol=0, atol=1e-8) for k in got)


def test_inner_edges_of_a_segment_are_no_rows_of_a_step(spark):
    from prismfield.operators import posegraph as G
    from prismfield.sources import adapters as A

    made = {}

    def cut(df, label):
        out = A.stored(df, label)
        made.setdefault(label, []).append(out.count())
        return out

    poses, edges = _ring(spark, 400, [(3, 300)])
    assert G.optimise(poses, edges, most_steps=1, cut=cut).count() == 400
    assert made["fronts"] == [4] and made["poses"] == [4, 4]  # three steps of the path and a loop between four segments; once a front an edge, a row a pose


def test_batches_of_wide_rows_are_short_and_the_setting_goes_back(spark):
    from prismfield.operators import posegraph as G

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with G._wide_rows(spark.range(1)):
        assert spark.conf.get(name) == str(G.TOGETHER)
    assert spark.conf.get(name) == before
