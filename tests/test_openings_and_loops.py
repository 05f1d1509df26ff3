import itertools

import numpy as np
import pytest

from prismfield.operators import frames as FR
from prismfield.operators import openings as O
from prismfield.operators import posegraph as G
from prismfield.operators import registration as R
from prismfield.sources import adapters as A


def wall_points(spark, pitch, phase, width, sill, head, seed, n=60_000, doors=()):
    """Points of a wall of 24 by 3; nothing comes back from the bays, a mullion in each does."""
    rng = np.random.default_rng(seed)
    u, z = rng.uniform(0, 24, n), rng.uniform(0, 3, n)
    slot, at = np.divmod(u - phase, pitch)
    low = np.where(np.isin(slot, doors), -1.0, sill)
    open_ = (at < width) & (z > low) & (z < head) & (np.abs(at - width / 2) > 0.05)
    keep = ~open_
    return spark.createDataFrame([(0, a, b, 0.0, 24.0, 0.0, 3.0) for a, b in zip(u[keep].tolist(), z[keep].tolist(), strict=True)], "wall int, u double, z double, lo double, hi double, z0 double, z1 double").repartition(3)


@pytest.mark.parametrize(("pitch", "phase", "width", "seed"), [(3.18, 0.7, 1.6, 1), (2.4, 0.3, 1.2, 2)])
def test_planted_bays_are_found(spark, pitch, phase, width, seed):
    df = wall_points(spark, pitch, phase, width, 0.8, 2.4, seed, doors=(2,))
    got = O.bays(df, ["wall"]).orderBy("u0").collect()
    starts = np.arange(phase, 24, pitch)
    whole = [r for r in got if r["u1"] < 24 - 0.2 and r["u0"] < starts[starts + width < 24][-1] + 1]  # a bay that the wall's end cuts is another width
    assert len(whole) >= (starts + width < 24).sum() - 1
    for r in whole:
        near = starts[np.argmin(np.abs(starts - r["u0"]))]
        assert abs(r["u0"] - near) < 0.12 and abs(r["u1"] - r["u0"] - width) < 0.12 and r["pitch"] == pytest.approx(pitch, abs=0.05)
        door = abs(near - (phase + 2 * pitch)) < 0.1
        assert r["reaches_floor"] == door and abs(r["head"] - 2.4) < 0.2 and abs(r["sill"] - (0.0 if door else 0.8)) < 0.2 and r["sill_outlier"] == door
    row = O.pitches(df, ["wall", "lo", "hi", "z0", "z1"]).first()
    assert row["pitch"] == pytest.approx(pitch, abs=0.05)


def test_walls_without_rhythm_have_no_bays(spark):
    df = wall_points(spark, 3.0, 0.0, 0.0, 0.8, 2.4, 3, 8000)
    assert O.bays(df, ["wall"]).count() == 0 and O.bays(df.where("false"), ["wall"]).count() == 0


def test_profile_helpers():
    rng = np.random.default_rng(1)
    p = rng.poisson(5, (4, 50)).astype(float)
    want = [np.correlate(x - x.mean(), x - x.mean(), "full")[49:] for x in p]
    assert np.allclose(O.autocorrelations(p), [w / w[0] for w in want]) and len(O.autocorrelations(np.ones((2, 9)))) == 0
    mask = np.array([1, 1, 0, 1, 1, 1, 0, 1], bool)
    assert O.runs(mask).tolist() == [[0, 1], [3, 5], [7, 7]] and O.without_short(mask, 2).astype(int).tolist() == [1, 1, 0, 1, 1, 1, 0, 0]
    assert O.agreeing_mean([1, 1, 1, 9], 1.0)[0] == 1 and O.agreeing_mean([1, 5], 1.0)[0] == 3 and O.agreeing_mean([2, 2, 2], 1.0)[1].all()
    assert O.tallest_runs(np.array([0, 4, 9, 8, 1, 6, 5, 0.0]), 2) == [(2, 3, 2), (5, 6, 5)]


def test_views_are_gathered_around_the_best_one(spark):
    rng = np.random.default_rng(4)
    rows = []
    for face, k in itertools.product(range(3), range(40)):
        u, v = rng.uniform(0, 10), rng.uniform(0, 1)
        rows.append((face, k, int(rng.integers(0, 9)), float(u), float(u + rng.uniform(0.3, 2)), float(v), float(v + rng.uniform(0.3, 2))))
    rows.append((0, 99, 5, 1.0, 1.0, 0.0, 1.0))  # no area
    df = spark.createDataFrame(rows, "face int, view long, n_points long, u0 double, u1 double, v0 double, v1 double")
    want = []
    for face in range(3):
        left = sorted((r for r in rows if r[0] == face and r[4] > r[3]), key=lambda r: (-r[2], r[1]))
        while left:
            s = left[0]

            def fits(a, s=s):
                w, h = min(a[4], s[4]) - max(a[3], s[3]), min(a[6], s[6]) - max(a[5], s[5])
                return a is s or (w > 0 and h > 0 and w * h / min((a[4] - a[3]) * (a[6] - a[5]), (s[4] - s[3]) * (s[6] - s[5])) >= 0.5)

            mine = [a for a in left if fits(a)]
            left = [a for a in left if not fits(a)]
            want.append((face, s[1], len(mine), sum(a[2] for a in mine), *(round(float(np.median([a[i] for a in mine])), 9) for i in (3, 4, 5, 6))))
    got = [tuple(r[:4]) + tuple(round(x, 9) for x in r[4:]) for r in O.merge_views(df, ["face"]).collect()]
    assert sorted(got) == sorted(want)


def test_rays_choose_the_wall_that_can_be_built(spark):
    boxes = spark.createDataFrame([(0, 0, 0.0, 6.0, 0.0, 4.0, 0.0, 3.0), (0, 1, 6.0, 10.0, 0.0, 4.0, 0.0, 3.0)], "building long, box int, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    walls = O.walls_of(boxes)
    r = [0.0, 0.0, 1.0, -1.0, 0.0, 0.0, 0.0, -1.0, 0.0]  # looks along x
    cameras = spark.createDataFrame([(7, 0, 40.0, 40.0, 32.0, 24.0, 2.0, 2.0, 1.5, r)], "frame long, building long, fx double, fy double, cx double, cy double, ox double, oy double, oz double, r array<double>")
    pixels = spark.createDataFrame([(7, 1, a, b) for a in range(20, 29) for b in range(28, 37)] + [(7, 2, a, b) for a in range(0, 3) for b in range(31, 34)], "frame long, segment long, row long, col long")
    outline = O.boundaries(pixels)
    assert outline.where("segment = 1").count() == 32
    chosen = O.faces_by_ray(outline, cameras, walls, boxes).collect()
    assert [(c["segment"], c["face"], round(c["t"], 6), c["share"]) for c in chosen] == [(1, 5, 8.0, 1.0)]  # not the inner wall at x = 6; the other mask looks over the top
    rect = O.mask_rectangles(outline, cameras, O.faces_by_ray(outline, cameras, walls, boxes), walls).collect()
    assert np.allclose([rect[0][c] for c in ("u0", "u1", "v0", "v1")], [2 - 0.8, 2 + 0.8, 1.5 - 0.8, 1.5 + 0.8]) and rect[0]["used"] == 32


def frame_rows(h, w, boxes):
    grid = np.full((h, w), -1)
    for k, (r0, r1, c0, c1) in enumerate(boxes):
        grid[r0:r1, c0:c1] = k
    return [(0, r, c, int(grid[r, c])) for r in range(h) for c in range(w) if grid[r, c] >= 0], grid


LIMITS = {"dilation": 1, "floor_gap": 4, "edge_band": 4, "door_width": 4, "area": 12}
SCHEMA = ("frame long, row long, col long, segment long", "frame long, segment long, class string, zone string, confidence double")


def test_each_rule_of_frames(spark):
    boxes = [
        (38, 40, 0, 80),  # 0 floor
        (10, 20, 2, 8), (10, 20, 9, 14),  # 1, 2 a window in two pieces with a seam
        (24, 36, 20, 26),  # 3 a door that stands
        (24, 36, 30, 36), (24, 36, 37, 40),  # 4 a window, 5 a door at its edge
        (34, 36, 44, 49),  # 6 too small a door
        (24, 36, 52, 54),  # 7 too narrow a door
        (10, 36, 58, 63),  # 8 as tall as a glass wall
        (10, 22, 66, 72),  # 9 a door that hangs
        (24, 36, 75, 79),  # 10 measured, not of a door's size
    ]
    rows, _ = frame_rows(40, 80, boxes)
    classes = ["other", "window", "window", "door", "window", "door", "door", "door", "door", "door", "door"]
    segs = [(0, k, c, "floor" if k == 0 else "wall", 0.1 * k) for k, c in enumerate(classes)] + [(0, 50, "door", "wall", 0.5)]
    pixels, segments = spark.createDataFrame(rows, SCHEMA[0]), spark.createDataFrame(segs, SCHEMA[1])

    def metric(regions):
        by = regions.groupBy("frame", "region").agg({"col": "min"}).withColumnRenamed("min(col)", "c")
        return by.selectExpr("frame", "region", "CASE WHEN c = 75 THEN 'bad' WHEN c = 52 THEN 'ok' ELSE 'unknown' END AS verdict")

    out = FR.judge(pixels, segments, (40, 80), A.stored, metric, limits=LIMITS)
    got = {r["segment"]: r for r in out.segments.collect()}
    rule = {k: r["rule"] for k, r in got.items() if r["rule"]}
    assert rule == {5: "door_window_edge_adjacent", 6: "door_below_min_area", 8: "door_taller_than_glass_wall", 9: "door_not_floor_standing", 10: "door_metric_dims"}
    new = {k: r for k, r in got.items() if k > 50}
    assert sorted((r["class"], r["area"], r["n_merged"]) for r in new.values()) == [("door", 24, 1), ("door", 72, 1), ("window", 72, 1), ("window", 110, 2)]
    merged = next(r for r in new.values() if r["area"] == 110)
    assert merged["confidence"] == pytest.approx((0.1 * 60 + 0.2 * 50) / 110) and (merged["x0"], merged["x1"], merged["y0"], merged["y1"]) == (2, 14, 10, 20)
    assert got[5]["class"] == "other" and got[0]["class"] == "other" and 50 not in got and 3 not in got
    assert out.pixels.count() == len(rows)


def test_windows_on_the_floor_and_what_no_region_took_in(spark):
    rows, _ = frame_rows(40, 80, [(38, 40, 0, 80), (30, 36, 2, 12), (5, 20, 30, 40), (24, 36, 66, 68)])
    rows += [(0, 5, 60, 2)]  # a far piece of segment 2, too small a region
    segs = [(0, 0, "other", "floor", 0.5), (0, 1, "window", "wall", 0.5), (0, 2, "window", "wall", 0.5), (0, 3, "door", "wall", 0.5)]
    df = spark.createDataFrame(rows, SCHEMA[0]), spark.createDataFrame(segs, SCHEMA[1])
    got = {r["segment"]: r for r in FR.judge(*df, (40, 80), A.stored, filter_windows=True, limits=LIMITS).segments.collect()}
    assert got[1]["rule"] == "window_floor_contact_not_glass_wall" and (got[2]["class"], got[2]["residual"], got[2]["area"]) == ("other", True, 1) and got[3]["rule"] == "door_below_min_width"
    assert FR.judge(df[0].where("false"), df[1], (40, 80), A.stored).segments.count() == 0


def test_gaps_bridged_by_dilation_equal_a_plain_search(spark):
    rng = np.random.default_rng(3)
    cells = {(int(a), int(b)) for a, b in rng.integers(0, 30, (90, 2))}
    for reach, corners in ((1, True), (3, False)):
        label = {}
        for start in sorted(cells):
            if start in label:
                continue
            todo = [start]
            label[start] = start
            while todo:
                a = todo.pop()
                for b in cells - label.keys():
                    d = abs(a[0] - b[0]), abs(a[1] - b[1])
                    if max(d) <= reach and (corners or min(d) < reach):
                        label[b] = start
                        todo.append(b)
        got = {(r["i"], r["j"]): tuple(r["component"]) for r in O.components_of_cells(spark.createDataFrame([(1, *c) for c in cells], "k int, i int, j int"), ["k"], reach, A.stored, corners).collect()}
        assert got == label


def scan(seed, n=500):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 1, (n, 3)) * [8, 5, 3]
    side = rng.integers(0, 5, n)
    for k, (axis, v) in enumerate([(0, 0), (0, 8), (1, 0), (1, 5), (2, 0)]):
        p[side == k, axis] = v
    return p - [3, 2, 1.2]


def loops_case(spark):
    """Four scans of one room and one of another; node 9 was displaced."""
    true_t = {0: [0, 0, 0], 9: [0.4, -0.3, 0.0], 20: [0, 0, 0], 30: [1, 1, 0]}
    true_v = {0: [0, 0, 0], 9: [0, 0, 0.2], 20: [0, 0, 0], 30: [0, 0, 0.1]}
    base, other = scan(1), scan(2) * [1.0, 2.5, 1.0] + [9, 9, 3]
    scans, poses = [], []
    for node in true_t:
        r, t = G.spin(np.array([true_v[node]], float))[0], np.array(true_t[node], float)
        pts = (other if node == 20 else base - t) @ r
        scans += [(0, node, *map(float, p)) for p in pts]
        drift = np.array([0.25, 0.15, 0.3]) if node == 9 else np.array([7.0, 0, 0]) if node == 30 else np.zeros(3)
        poses.append((0, node, (t + drift).tolist(), G.quaternion((r @ G.spin(np.array([[0, 0, 0.05 if node == 9 else 0]]))[0])[None])[0].tolist()))
    return spark.createDataFrame(scans, "graph long, node long, x double, y double, z double"), spark.createDataFrame(poses, "graph long, node long, t array<double>, q array<double>"), true_t, true_v


def test_registration_recovers_displacements_and_names_reasons(spark):
    scans, poses, true_t, true_v = loops_case(spark)
    pairs = spark.createDataFrame([(0, 0, 9), (0, 0, 20), (0, 0, 30)], "graph long, i long, j long")
    got = {r["j"]: r for r in R.close_loops(pairs, poses, scans, A.stored, distance=1.0, coarse=2.0, steps=(12, 6), most_shift=1.0).collect()}
    r = got[9]
    assert r["reason"] is None and r["rmse"] < 0.02 and r["overlap"] > 0.95
    assert np.allclose(r["t"], true_t[9], atol=0.02) and np.allclose(G.turn(np.array([r["q"]]))[0], G.spin(np.array([true_v[9]], float))[0], atol=0.01)
    assert got[20]["reason"] == "no overlap" and got[30]["reason"] in ("contradicts", "rmse", "no overlap")


def test_rigid_alignment_from_moments_equals_a_plain_one(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(0, 1, (40, 3))
    r, t = G.spin(np.array([[0.2, -0.4, 0.9]]))[0], np.array([1.0, -2.0, 0.5])
    rows = [(0, k, *map(float, a), *map(float, r @ a + t), 0.0) for k, a in enumerate(p)]
    m = R.moments(spark.createDataFrame(rows, "k int, id long, x double, y double, z double, fx double, fy double, fz double, d2 double"), ["k"]).toPandas()
    got_r, got_t = R.rigid(m)
    assert np.allclose(got_r[0], r) and np.allclose(got_t[0], t)


def test_candidates_by_appearance_and_by_place(spark):
    turn = G.spin(np.array([[0.0, 0.0, 2 * np.pi / 6]]))[0]
    base = scan(1)
    rows = [(0, n, *map(float, p)) for n, pts in ((0, base), (9, base @ turn.T), (12, base @ turn), (20, scan(2) * [0.3, 3.0, 1.0])) for p in pts]
    described = A.stored(R.descriptors(spark.createDataFrame(rows, "graph long, node long, x double, y double, z double"), radius=12.0), "described")
    got = {(r["i"], r["j"]) for r in R.appearance_candidates(described, 0.3, 0.1, excluded=5).collect()}
    assert got == {(0, 9), (0, 12)}  # 9 and 12 are too near each other on the path
    assert {(r["i"], r["j"]) for r in R.appearance_candidates(described, 0.3, 0.1, excluded=1, most=1).collect()} == {(0, 9), (0, 12)}
    a = np.zeros((4, 6))
    a[1, 2], a[3, 4] = 2.0, 1.0
    assert R.descriptor_distance(a, np.roll(a, 3, 1)) == pytest.approx(0) and R.descriptor_distance(a, np.zeros((4, 6))) == 1
    at = spark.createDataFrame([(0, k, [float(k % 10), 0.1 * k, 0.0], [0.0, 0.0, 0.0, 1.0]) for k in range(40)], "graph long, node long, t array<double>, q array<double>")
    p = np.array([[k % 10, 0.1 * k] for k in range(40)])
    want = {(i, j) for i in range(40) for j in range(40) if j - i >= 8 and np.hypot(*(p[i] - p[j])) <= 1.5}
    assert {(r["i"], r["j"]) for r in R.place_candidates(at, 1.5, 8).collect()} == want and len(want) > 10


def _plans_of_judge(spark):
    """Plans of all tables that `judge` stores, and of its records, for a few pixels: as small to Spark as millions that compress well."""
    pixels = spark.createDataFrame([(f, 3, c, 1 + c // 5) for f in range(3) for c in range(10)], "frame long, row int, col int, segment int")
    segments = spark.createDataFrame([(f, s, k, "wall", 0.5) for f in range(3) for s, k in ((1, "door"), (2, "window"))], "frame long, segment int, class string, zone string, confidence double")
    plans = []

    def cut(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return A.stored(df, label)

    out = FR.judge(pixels, segments, (10, 10), cut)
    return plans, out.segments._jdf.queryExecution().executedPlan().toString()


def test_frame_rules_broadcast_no_table_of_pixels(spark):
    plans, _ = _plans_of_judge(spark)
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_frame_regions_equal_a_plain_search(spark):
    import random

    rng = random.Random(8)
    cells = {f: {(rng.randrange(30), rng.randrange(40)) for _ in range(110)} for f in range(3)}
    df = spark.createDataFrame([(f, r, c, 0) for f, s in cells.items() for r, c in s], "frame long, row int, col int, segment int")
    got = {(x.frame, x.row, x.col): tuple(x.region) for x in FR.regions_of(df, 1, A.stored).collect()}
    want = {}
    for f, s in cells.items():
        for start in sorted(s):
            todo = [] if (f, *start) in want else [start]
            while todo:
                r, c = todo.pop()
                if (f, r, c) not in want:
                    want[f, r, c] = start
                    todo += [(a, b) for a, b in s if max(abs(a - r), abs(b - c)) <= 3 and min(abs(a - r), abs(b - c)) < 3]
    assert got == want


def test_frame_records_broadcast_no_table_of_segments(spark):
    assert "BroadcastHashJoin" not in _plans_of_judge(spark)[1]


def test_frame_records_broadcast_nothing_while_they_run(spark):
    """Adaptive execution may turn a join that was planned as a merge into a broadcast once its sides are known: the plans that ran hold none."""
    at = {1: (3, 0), 2: (3, 20), 3: (5, 0)}  # a door, a window away from it, the floor below the door; the last frame has no floor
    pixels = spark.createDataFrame([(f, r, c + k, s) for f in range(3) for s, (r, c) in at.items() for k in range(5) if (f, s) != (2, 3)], "frame long, row int, col int, segment int")
    kinds = ((1, "door", "wall"), (2, "window", "wall"), (3, "other", "floor"))
    segments = spark.createDataFrame([(f, s, k, z, 0.5) for f in range(3) for s, k, z in kinds], "frame long, segment int, class string, zone string, confidence double")
    ran = []

    def run(df, label):
        rows = df.collect()
        ran.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return rows if label == "segments" else A.stored(df, label)

    records = run(FR.judge(pixels, segments, (10, 30), run, limits={"dilation": 1, "floor_gap": 5, "edge_band": 2, "door_width": 2, "area": 2}).segments, "segments")
    assert {r["rule"] for r in records} == {None, FR.RULES[5]} and sum(r["class"] == "door" for r in records) == 2  # no join met an empty side
    assert len(ran) > 5 and all("isFinalPlan=true" in p and "Broadcast" not in p for p in ran) and ran[-1].count("SortMergeJoin") >= 6


def test_pose_graph_leaves_its_result_and_edges_alone(spark):
    """Of the tables that the steps store, only those that are read again are left."""
    from pyspark.sql import functions as F

    node = spark.range(130).select(F.lit(0).cast("long").alias("graph"), F.col("id").alias("node"), F.array(F.col("id") * 1.0, F.sin("id"), F.lit(0.0)).alias("t"), F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))).alias("q"))
    loop = spark.createDataFrame([(0, 5, 120, [100.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], 400.0)], "graph long, i long, j long, t array<double>, q array<double>, weight double")
    made = []

    def cut(df, label):
        made.append(A.stored(df, label))
        return made[-1]

    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    poses = A.stored(node, "given")
    out = G.optimise(poses, G.graph_edges(poses, loop, None), most_steps=2, cut=cut)
    assert out.count() == 130 and len(made) > 8 and sum(map(there, made)) == 2 and there(poses)
