import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismfield.operators import planes as P
from prismfield.operators import posegraph as G
from prismfield.sources import adapters as A


def room(seed, without=(), thin=None, n=400):
    """Points of a box of 6 by 4 by 3 with a little noise, and clutter."""
    rng = np.random.default_rng(seed)
    size, out = np.array([6.0, 4.0, 3.0]), []
    for axis, end in itertools.product(range(3), (0, 1)):
        if (axis, end) not in without:
            p = rng.uniform(0, 1, (n // 2 if (axis, end) == thin else n, 3)) * size
            p[:, axis] = end * size[axis] + rng.uniform(-0.004, 0.004, len(p))
            out.append(p)
    out.append(rng.uniform(0, 1, (n // 4, 3)) * size)
    return np.concatenate(out)


def cloud(spark, rooms):
    rows = [(k, f"{k}-{i}", *map(float, p)) for k, pts in rooms.items() for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "hall int, id string, x double, y double, z double").repartition(4)


def plain_peel(spark, pts, ids, threshold, trials, least, rounds):
    """The same draws, one round after another, in numpy."""
    import hashlib

    left, out = np.arange(len(pts)), []
    for attempt in range(rounds):
        order = sorted(left, key=lambda i: hashlib.md5(f"{attempt}:{ids[i]}".encode()).hexdigest())[: 3 * trials]
        best = None
        for k in range(len(order) // 3):
            a, b, c = pts[order[3 * k : 3 * k + 3]]
            n = np.cross(b - a, c - a)
            if np.linalg.norm(n) > 1e-12:
                n = n / np.linalg.norm(n)
                near = left[np.abs((pts[left] - a) @ n) < threshold]
                if best is None or len(near) > len(best):
                    best = near
        if best is None or len(best) < least:
            break
        centre = pts[best].mean(0)
        out.append((len(best), centre, np.linalg.svd(pts[best] - centre)[2][2]))
        left = np.setdiff1d(left, best)
    return out


def test_peel_equals_a_plain_loop_and_keeps_rounds_apart(spark):
    rooms = {1: room(1), 2: room(2, n=250), 3: room(3)[:2]}
    df = cloud(spark, rooms).unionByName(spark.createDataFrame([(1, "bad", float("nan"), 0.0, 0.0), (1, "gone", None, 0.0, 0.0)], "hall int, id string, x double, y double, z double"))
    got = P.peel(df, ["hall"], A.stored, 0.02, 200, 0.0, 100, 20, 7, 0.0).toPandas().sort_values(["hall", "attempt"])
    for hall in (1, 2):
        want = plain_peel(spark, rooms[hall], [f"{hall}-{i}" for i in range(len(rooms[hall]))], 0.02, 200, 100, 7)
        g = got[got.hall == hall]
        assert g.inliers.tolist() == [w[0] for w in want] and len(want) >= 6
        for (_, r), (_, centre, normal) in zip(g.iterrows(), want, strict=True):
            assert np.allclose([r.cx, r.cy, r.cz], centre) and abs(abs(normal @ [r.nx, r.ny, r.nz]) - 1) < 1e-4 and r.rms < 0.02
    assert 3 not in set(got.hall)


def test_tilted_planes_are_noise_and_snapping_turns_normals(spark):
    rng = np.random.default_rng(4)
    u = rng.uniform(0, 4, (600, 2))
    tilted = np.c_[u[:, 0], u[:, 1], u[:, 0]]  # 45 degrees
    floor = np.c_[rng.uniform(0, 4, (300, 2)), rng.uniform(-0.003, 0.003, 300) + 0.001]
    got = P.peel(cloud(spark, {0: np.concatenate([tilted, floor])}), ["hall"], A.stored, 0.02, 60, 0.0, 100, 5, 4, 15.0, True).orderBy("attempt").collect()
    assert [r["accepted"] for r in got] == [False, True] and got[0]["plane"] is None and got[1]["plane"] == 0
    assert (got[1]["nx"], got[1]["ny"], got[1]["nz"], got[1]["tilt"]) == (0.0, 0.0, 1.0, 0.0) and got[1]["d"] == pytest.approx(-got[1]["cz"])
    assert P.peel(cloud(spark, {0: tilted}).where("false"), ["hall"], A.stored, 0.02, 5).count() == 0


def test_many_clouds_are_joined_by_salted_keys(spark, monkeypatch):
    rooms = {k: room(k, n=150) for k in range(3)}
    run = lambda: sorted(map(tuple, P.peel(cloud(spark, rooms), ["hall"], A.stored, 0.02, 150, 0.05, 3, 2, 2).select("hall", "attempt", "inliers").collect()))
    want = run()
    monkeypatch.setattr(P, "MOST_BROADCAST", 0)
    assert run() == want and len(want) == 6


def test_rectangles_leave_stray_inliers_out(spark):
    rng = np.random.default_rng(5)
    wall = np.c_[np.full(400, 1.0), rng.uniform(0, 4, 400), rng.uniform(0, 3, 400)]
    stray = np.c_[np.full(3, 1.0), rng.uniform(9, 9.2, 3), rng.uniform(0, 1, 3)]
    pts = np.concatenate([wall, stray])
    df = cloud(spark, {0: pts})
    plane = spark.createDataFrame([(0, 1.0, 0.0, 0.0, *map(float, pts.mean(0)))], "hall int, nx double, ny double, nz double, cx double, cy double, cz double")
    for gap, w in ((0.5, np.ptp(wall[:, 1])), (0.0, np.ptp(pts[:, 1]))):
        r = P.rectangles(df, plane, ["hall"], gap, A.stored).first()
        assert r["width"] == pytest.approx(w) and r["height"] == pytest.approx(np.ptp(wall[:, 2]) if gap else np.ptp(pts[:, 2]))


def test_least_rectangles_equal_a_search_over_angles(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k, (w, h, deg) in enumerate([(4, 2, 30), (3, 1, 77), (2, 2, 10), (5, 1, 0)]):
        p = rng.uniform(-0.5, 0.5, (200, 2)) * [w, h]
        t = np.radians(deg)
        p = p @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + [7, -3]
        best = min((np.ptp(p @ [np.cos(a), np.sin(a)]) * np.ptp(p @ [-np.sin(a), np.cos(a)])) for a in np.radians(np.arange(0, 90, 0.02)))
        want[k] = best
        rows += [(k, float(a), float(b)) for a, b in p]
    rows += [(9, 1.0, 1.0), (8, 0.0, 0.0), (8, 3.0, 4.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r["k"]: r for r in P.least_rectangles(spark.createDataFrame(rows, "k int, u double, v double"), ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, area in want.items():
        assert area * 0.999 <= got[k]["width"] * got[k]["height"] * 1.0001 <= area * 1.001 * 1.0001
    assert (got[9]["width"], got[9]["height"]) == (0, 0) and (got[8]["width"], got[8]["height"]) == (5, 0)


def test_fragments_of_a_surface_are_one_plane(spark):
    rows = [(0, 0, 90, 0.0, 0.0, 1.0, 0.0), (0, 1, 100, 0.0, 0.05, -0.99, 0.1), (0, 2, 80, 0.0, 0.0, 1.0, -3.0), (0, 3, 70, 1.0, 0.0, 0.0, 0.0)]
    got = P.unlike(spark.createDataFrame(rows, "hall int, plane int, inliers long, nx double, ny double, nz double, d double"), ["hall"]).orderBy("plane").collect()
    assert [(r["plane"], r["inliers"]) for r in got] == [(0, 100), (1, 80), (2, 70)]


def closed(spark, rooms, roi=None, cap=True):
    df = cloud(spark, rooms)
    found = A.stored(P.peel(df, ["hall"], A.stored, 0.02, 200, 0.1, 3, 20, 9), "planes")
    keys = ["hall", "attempt"]
    sized = found.where("accepted").join(P.rectangles(P.members(df, found, ["hall"], 0.02, A.stored), found.where("accepted"), keys, 0.6, A.stored), keys)
    return P.close_box(A.stored(P.unlike(sized, ["hall"]), "unlike"), df, ["hall"], A.stored, 0.02, 200, 3, 0.04, 0.5, 0.4, 0.6, roi, cap).toPandas()


def test_boxes_close_and_edges_meet(spark):
    got = closed(spark, {0: room(10), 1: room(11, thin=(1, 1)), 2: room(12, without=[(0, 1)])})
    for hall, g in got.groupby("hall"):
        assert len(g) == 6 and set(zip(g.axis, g.side, strict=True)) == {(a, s) for a in range(3) for s in "-+"}
        at = {(r.axis, r.side): r.fixed for r in g.itertuples()}
        for r in g.itertuples():
            a, b = [k for k in range(3) if k != r.axis]
            assert (r.a0, r.a1, r.b0, r.b1) == (at[a, "-"], at[a, "+"], at[b, "-"], at[b, "+"])
        assert np.allclose([at[k, "+"] - at[k, "-"] for k in range(3)], [6, 4, 3], atol=0.03), hall
    assert not got[got.hall == 0].synthetic.any() and not got[got.hall == 0].retried.any()
    thin = got[got.hall == 1]
    assert thin[thin.retried][["axis", "side"]].values.tolist() == [[1, "+"]]  # missed at first, found in the slab
    gone = got[got.hall == 2]
    assert gone[gone.synthetic][["axis", "side", "inliers"]].values.tolist() == [[0, "+", 0]]


def test_a_crop_stays_open(spark):
    df = room(11, thin=(1, 1))
    got = closed(spark, {1: df}, roi=(-9, 9, -9, float(df[:, 1].max()), -9, 9), cap=False)
    assert len(got) == 5 and not got.retried.any()


def test_reclosed_box_in_its_own_frame(spark):
    t = np.radians(20)
    r = np.array([[np.cos(t), np.sin(t), 0], [-np.sin(t), np.cos(t), 0], [0, 0, 1]])
    rows = []
    for k, (axis, end) in enumerate(itertools.product(range(3), (0, 1))):
        c = np.array([3.0, 2.0, 1.5])
        c[axis] = end * [6, 4, 3][axis]
        corners = []
        for a, b in itertools.product((0, 1), (0, 1)):
            q = np.array([6.0 * a, 4.0 * b, 0.0]) if axis == 2 else np.array([0.0, 4.0 * a, 3.0 * b]) if axis == 0 else np.array([6.0 * a, 0.0, 3.0 * b])
            q[axis] = c[axis]
            corners.append(tuple(map(float, r.T @ (q - [1, 1, 0]))))
        rows.append((0, k, 100 - k, 1.0, *map(float, r.T @ np.eye(3)[axis]), *map(float, r.T @ (c - [1, 1, 0])), corners))
    df = spark.createDataFrame(rows, "hall int, plane int, inliers long, area double, nx double, ny double, nz double, cx double, cy double, cz double, corners array<struct<x: double, y: double, z: double>>")
    frames = spark.createDataFrame([(0, [float(v) for v in r.ravel()], [1.0, 1.0, 0.0])], "hall int, r array<double>, t array<double>")
    got = P.reclose(df, frames, ["hall"], A.stored).orderBy("face").collect()
    assert np.allclose([g["fixed"] for g in got], [0, 6, 0, 4, 0, 3]) and np.allclose([g["area"] for g in got], [12, 12, 18, 18, 24, 24])
    # With an axis left out, both its ends are capped at the corners.
    got = P.reclose(df.where("plane < 4"), frames, ["hall"], A.stored).orderBy("face").collect()
    assert [g["synthetic"] for g in got] == [False] * 4 + [True] * 2 and sorted(round(g["fixed"], 6) for g in got[4:]) == [0, 3]


def path(n, seed=0, drift=0.02):
    rng = np.random.default_rng(seed)
    turn = np.arange(n) * 0.2
    true_t = np.c_[5 * np.cos(turn), 5 * np.sin(turn), 0.01 * np.arange(n)]
    true_r = G.spin(np.c_[np.zeros(n), np.zeros(n), turn])
    r = true_r @ G.spin(rng.normal(0, drift, (n, 3)))
    return true_t, true_r, true_t + rng.normal(0, 5 * drift, (n, 3)), r


def rows_of(t, r, graph=0):
    return [(graph, k, [float(v) for v in a], [float(v) for v in q]) for k, (a, q) in enumerate(zip(t, G.quaternion(r), strict=True))]


POSE, EDGE = "graph long, node long, t array<double>, q array<double>", "graph long, i long, j long, t array<double>, q array<double>, w array<double>"


def edges_of(t, r, pairs, seed, noise, graph=0):
    rng = np.random.default_rng(seed)
    out = []
    for i, j in pairs:
        z_t = r[i].T @ (t[j] - t[i]) + rng.normal(0, noise, 3)
        z_r = (r[i].T @ r[j])[None] @ G.spin(rng.normal(0, noise, (1, 3)))
        out.append((graph, i, j, z_t.tolist(), G.quaternion(z_r)[0].tolist(), [float(x) for x in rng.uniform(0.5, 3, 6)]))
    return out


def dense(poses, edges, steps=15):
    """Gauss-Newton with one matrix."""
    t, r = np.array([p[2] for p in poses]), G.turn(np.array([p[3] for p in poses]))
    i, j = np.array([e[1] for e in edges]), np.array([e[2] for e in edges])
    zt, zr, w = np.array([e[3] for e in edges]), G.turn(np.array([e[4] for e in edges])), np.array([e[5] for e in edges])
    for _ in range(steps):
        e, a, b = G.residuals(t[i], r[i], t[j], r[j], zt, zr)
        jac = np.zeros((6 * len(edges), 6 * len(t)))
        for k in range(len(edges)):
            jac[6 * k : 6 * k + 6, 6 * i[k] : 6 * i[k] + 6] = a[k]
            jac[6 * k : 6 * k + 6, 6 * j[k] : 6 * j[k] + 6] = b[k]
        jac, ww = jac[:, 6:], w.ravel()
        d = np.linalg.solve(jac.T @ (ww[:, None] * jac) + 1e-9 * np.eye(jac.shape[1]), -jac.T @ (ww * e.ravel())).reshape(-1, 6)
        t = t.copy()
        t[1:] += np.einsum("nab,nb->na", r[1:], d[:, :3])
        r[1:] = r[1:] @ G.spin(d[:, 3:])
    return t, r


def test_derivatives_of_edges():
    rng = np.random.default_rng(1)
    n = 5
    ti, tj, tz = (rng.normal(0, 1, (n, 3)) for _ in range(3))
    ri, rj, rz = (G.spin(rng.normal(0, 1, (n, 3))) for _ in range(3))
    e, a, b = G.residuals(ti, ri, tj, rj, tz, rz)
    for k in range(6):
        d = np.zeros((n, 6))
        d[:, k] = 1e-6
        up = G.residuals(ti + np.einsum("nab,nb->na", ri, d[:, :3]), ri @ G.spin(d[:, 3:]), tj, rj, tz, rz)[0]
        assert np.allclose((up - e) / 1e-6, a[:, :, k], atol=1e-4)
        up = G.residuals(ti, ri, tj + np.einsum("nab,nb->na", rj, d[:, :3]), rj @ G.spin(d[:, 3:]), tz, rz)[0]
        assert np.allclose((up - e) / 1e-6, b[:, :, k], atol=1e-4)
    assert np.allclose(G.turn(G.quaternion(ri)), ri) and np.allclose(G.spin(G.axis_angle(ri)), ri)


@pytest.mark.parametrize(("segment", "fan"), [(64, 8), (4, 2), (3, 3)])
def test_pose_graph_equals_a_dense_solve(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(G, "SEGMENT", segment)
    monkeypatch.setattr(G, "FAN", fan)
    n = 31
    true_t, true_r, t, r = path(n)
    pairs = [(k, k + 1) for k in range(n - 1)] + [(0, 30), (2, 17), (5, 28), (9, 10), (0, 12), (20, 7)]
    edges = edges_of(true_t, true_r, pairs, 3, 0.02)
    other = edges_of(true_t[:4], true_r[:4], [(0, 1), (1, 2)], 4, 0.0, 1)  # the last node has no edge
    poses = rows_of(t, r) + rows_of(t[:4], r[:4], 1)
    bad = [(0, 3, 3, [0.0] * 3, [0.0, 0.0, 0.0, 1.0], [1.0] * 6), (0, 3, 99, [0.0] * 3, [0.0, 0.0, 0.0, 1.0], [1.0] * 6), (0, 3, 4, None, None, None)]
    trace = []
    got = G.optimise(spark.createDataFrame(poses, POSE), spark.createDataFrame(edges + other + bad, EDGE), most_steps=12, tolerance=1e-12, trace=trace).toPandas()
    g = got[got.graph == 0].sort_values("node")
    want_t, want_r = dense(rows_of(t, r), edges)
    assert np.allclose(np.array(g["t"].tolist()), want_t, atol=1e-5) and np.allclose(G.turn(np.array(g["q"].tolist())), want_r, atol=1e-5)
    assert trace[-1][1] < 0.05 * trace[0][0]
    left = got[(got.graph == 1) & (got.node == 3)].iloc[0]
    assert np.allclose(left["t"], t[3])


def test_floors_and_loops_make_edges(spark):
    true_t, true_r, t, r = path(12, drift=0.0)
    poses = spark.createDataFrame(rows_of(t, r), POSE)
    loops = spark.createDataFrame([(0, 0, 9, [0.0] * 3, [0.0, 0.0, 0.0, 1.0], 7.0)], "graph long, i long, j long, t array<double>, q array<double>, weight double")
    floors = spark.createDataFrame([(0, k, None if k == 5 else 1.0 + 0.1 * k) for k in range(12)], "graph long, node long, distance double")
    got = G.graph_edges(poses, loops, floors).toPandas()
    assert len(got) == 11 + 1 + 11
    tied = got[(got.i == 0) & (got.w.map(lambda w: w[3] == 1000))].set_index("j")
    assert tied.loc[4, "t"][2] == pytest.approx(0.4) and tied.loc[4, "w"][2] == 500 and tied.loc[5, "w"][2] == 1e-3
    assert spark.range(1).select(G.loop_weight(F.lit(0.2), F.lit(2)).alias("w")).first()["w"] == pytest.approx(2 * 500 * 0.25)
