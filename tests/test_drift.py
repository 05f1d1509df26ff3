import numpy as np
from pyspark.sql import functions as F

from prismfield.operators import drift as D
from prismfield.operators import posegraph as G
from prismfield.sources import adapters as A


def corridor(spark, n=24, seed=1):
    """A straight drive of n steps in a hall, and the same path tilted more and more and turned off."""
    rng = np.random.default_rng(seed)
    scans, poses, true_t = [], [], []
    for k in range(n):
        t = np.array([0.5 * k, 0.0, 1.0])
        p = rng.uniform(0, 1, (2000, 3)) * [8, 4, 3] - [4, 2, 0]  # around the sensor
        side = rng.integers(0, 3, 2000)
        p[side == 0, 2] = 0.0
        p[side == 1, 1] = np.where(p[side == 1, 1] > 0, 2.0, -2.0)
        p[side == 2, 0] = np.where(p[side == 2, 0] > 0, 4.0, -4.0)
        body = p - [0, 0, 1.0] + rng.normal(0, 0.002, (2000, 3))
        if k % 5 == 3:
            body = body[body[:, 2] > 0.5]  # no floor seen
        scans += [(0, k, f"{k}-{i}", *map(float, q)) for i, q in enumerate(body)]
        drift = G.spin(np.array([[0.01 * k, 0.004 * k, 0.0]]))[0] @ G.spin(np.array([[0, 0, 0.008 * k]]))[0]
        true_t.append(t)
        poses.append(drift)
    # The odometry: each step is right in the sensor's frame, the attitude drifts.
    at, rows = true_t[0].copy(), []
    for k in range(n):
        rows.append((0, k, at.tolist(), G.quaternion(poses[k][None])[0].tolist()))
        at = at + poses[k] @ np.array([0.5, 0.0, 0.0])
    return spark.createDataFrame(scans, "graph long, node long, id string, x double, y double, z double"), spark.createDataFrame(rows, "graph long, node long, t array<double>, q array<double>"), np.array(true_t)


def test_a_tilted_and_turning_path_comes_back_straight(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 5)
    scans, poses, true_t = corridor(spark)
    seen = A.stored(D.floors(scans, A.stored), "floors")
    assert {r["node"] for r in seen.collect()} == {k for k in range(24) if k % 5 != 3}
    assert abs(seen.agg(F.avg("distance")).first()[0] - 1.0) < 0.02
    levelled, tilts = D.level(poses, seen, A.stored)
    levelled = A.stored(levelled, "levelled")
    assert tilts.where("node = 22").first()["tilt"] > 10
    _, after = D.level(levelled, seen, A.stored)
    assert after.agg(F.max("tilt")).first()[0] < 0.5
    straight = D.straighten(levelled, A.stored(D.walls(scans, levelled, 1.0), "walls"), A.stored, 2, 3).orderBy("node").collect()
    t = np.array([r["t"] for r in straight])
    before = np.array([r["t"] for r in poses.orderBy("node").collect()])
    assert np.abs(t - true_t).max() < 0.25 < 0.5 < np.abs(before - true_t).max()
    r = G.turn(np.array([r["q"] for r in straight]))
    assert np.degrees(np.arccos(np.clip((np.trace(r[-1]) - 1) / 2, -1, 1))) < 3


def test_paths_without_floor_or_wall_keep_their_poses(spark):
    scans, poses, _ = corridor(spark, 4)
    none = scans.where("false")
    levelled, tilts = D.level(poses, D.floors(none, A.stored), A.stored)
    straight = D.straighten(levelled, D.walls(none, poses), A.stored)
    want = {r["node"]: r for r in poses.collect()}
    for r in straight.collect():
        assert np.allclose(r["t"], want[r["node"]]["t"]) and np.allclose(G.turn(np.array([r["q"]])), G.turn(np.array([want[r["node"]]["q"]])))
    assert tilts.count() == 0


def test_values_are_filled_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    has = {4: 1.0, 5: 2.0, 13: 3.0}
    df = spark.createDataFrame([(0, k, has.get(k)) for k in range(20)], "graph long, node long, v double")
    for r in D.neighbours_with(df, "v").collect():
        before, after = [k for k in has if k <= r["node"]], [k for k in has if k >= r["node"]]
        assert (r["before"]["node"] if r["before"] else None) == (max(before) if before else None)
        assert (r["after"]["node"] if r["after"] else None) == (min(after) if after else None)
