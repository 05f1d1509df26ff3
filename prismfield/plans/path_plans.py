"""Trajectory correction: pose graphs, loops, floors and walls."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismfield.operators import posegraph as G
from prismfield.sources import adapters as A

from .registry import query


def driven_path(spark, sf_dir):
    """Poses (graph, node, t, q) and loops of one path over all events: rounds of 400 events on a circle, each step turned off by the event's value.

    Every 50th pose sees the one a round earlier where it is in truth.
    """
    e = A.table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("graph"), F.col("event_id").cast("long").alias("node"), "value")
    turn = F.col("node") * (2 * 3.141592653589793 / 400)
    drift = turn * 0.01 + (F.col("value") % 7 - 3) * 0.002  # yaw off by more and more
    away = lambda c: F.array(10 * F.cos(c), 10 * F.sin(c), F.lit(0.002) * F.col("node"))
    about_z = lambda c: F.array(F.lit(0.0), F.lit(0.0), F.sin(c / 2), F.cos(c / 2))
    poses = e.select("graph", "node", away(turn + drift).alias("t"), about_z(turn + drift).alias("q"))
    loops = poses.where("node >= 400 AND node % 50 = 0").select("graph", (F.col("node") - 400).alias("i"), F.col("node").alias("j"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("t"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("q"), F.lit(400.0).alias("weight"))
    return A.stored(poses, "poses"), loops


@query()
def pose_graph_optimisation(spark, sf_dir):
    """Paths with loops and floors brought to least cost; the systems are solved by nested elimination along the path."""
    poses, loops = driven_path(spark, sf_dir)
    floors = poses.select("graph", "node", F.when(F.col("node") % 3 != 1, F.lit(1.2)).alias("distance"))
    out = G.optimise(poses, G.graph_edges(poses, loops, floors), most_steps=4)
    return out.select("graph", "node", *(F.round(F.get("t", F.lit(k)), 4).alias(c) for k, c in enumerate("xyz")), F.round(F.abs(F.get("q", F.lit(3))), 5).alias("w"))


def revisited_rooms(spark, sf_dir):
    """Scans and poses of a path of eight stops in each hall: stops four apart see the same points, displaced; the path's own poses drift.

    As for any keyframe, a scan is what its points average to in cells of 0.3 metres: its size is the room's, not the data's.
    The points themselves are read once and neither stored nor shuffled.
    """
    from .plane_plans import room_points

    stop = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("round")
    cloud = room_points(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(4)))
    p = cloud.select(F.col("hall").cast("long").alias("graph"), "part", "x", "y", "z", stop).withColumn("node", F.col("part") + 4 * F.col("round"))
    yaw, cx, cy = F.col("round") * 0.15, 3 + 0.3 * F.col("round"), 2 - 0.2 * F.col("round")
    dx, dy = F.col("x") - cx, F.col("y") - cy
    scans = p.select("graph", "node", (F.cos(yaw) * dx + F.sin(yaw) * dy).alias("x"), (F.cos(yaw) * dy - F.sin(yaw) * dx).alias("y"), (F.col("z") - 1.2).alias("z"))
    scans = scans.groupBy("graph", "node", *(F.floor(F.col(a) / 0.3).alias(f"c{a}") for a in "xyz")).agg(*(F.avg(a).alias(a) for a in "xyz")).drop("cx", "cy", "cz")
    scans = A.stored(scans, "scans")
    nodes = scans.select("graph", "node", F.floor(F.col("node") / 4).alias("round")).distinct()
    off = F.col("node") * 0.02
    half = yaw / 2 + off / 4
    poses = nodes.select("graph", "node", F.array(cx + off, cy - off / 2, 1.2 + off).alias("t"), F.array(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)).alias("q"))
    return scans, A.stored(poses, "poses")


@query()
def loop_closures(spark, sf_dir):
    """Revisits by appearance and by place, registered by closest points from two guesses, with the first reason that turns a loop down."""
    from prismfield.operators import registration as R

    scans, poses = revisited_rooms(spark, sf_dir)
    seen = R.appearance_candidates(A.stored(R.descriptors(scans, radius=8.0), "descriptors"), 0.35, 0.35, excluded=2)
    pairs = A.stored(seen.select("graph", "i", "j").union(R.place_candidates(poses, 1.0, 4).select("graph", "i", "j")).distinct(), "candidates")
    out = R.close_loops(pairs, poses, scans, A.stored, distance=0.4, coarse=0.6, steps=(4, 3), most_rmse=0.12)
    return out.select("graph", "i", "j", "reason", F.round("rmse", 4).alias("rmse"), F.round("overlap", 4).alias("overlap"), F.round("shift", 3).alias("shift"))


@query()
def drift_correction(spark, sf_dir):
    """Paths whose attitude tilts more and more: levelled on the floor of each scan, then turned on its walls."""
    from prismfield.operators import drift as D

    scans, poses = revisited_rooms(spark, sf_dir)
    a, s, c = F.col("node") * 0.005, F.get("q", F.lit(2)), F.get("q", F.lit(3))
    tilted = A.stored(poses.select("graph", "node", "t", F.array(F.sin(a) * c, -F.sin(a) * s, F.cos(a) * s, F.cos(a) * c).alias("q")), "tilted")
    scans = scans.withColumn("id", F.concat_ws("/", *(F.round(x, 6) for x in ("x", "y", "z"))))
    levelled, tilts = D.level(tilted, A.stored(D.floors(scans, A.stored, fewest=(40, 20, 15)), "floors"), A.stored)
    levelled = A.stored(levelled, "levelled")
    out = D.straighten(levelled, A.stored(D.walls(scans, levelled, 1.0), "walls"), A.stored, 2, 3)
    return out.join(tilts, ["graph", "node"], "left").select("graph", "node", F.round("tilt", 3).alias("tilt"), *(F.round(F.get("t", F.lit(k)), 4).alias(x) for k, x in enumerate("xyz")))


_TURN = ("0.01 * sin(step)", "0.02 * cos(step)", "0.005 * (step % 7 - 3)")
_SHIFT = ("0.1 * (step % 5 - 2)", "0.05 * (step % 3 - 1)", "0.5 + 0.01 * (step % 11)")


def seen_points(spark, sf_dir):
    """Sightings between two frames of each supplier's whole cloud under a known motion; of a third the depth is known. No sighting is off: what rejection does is tested on small examples, where a plain solve can be held against it."""
    p = A.points(spark, sf_dir).select(F.lit(0).cast("long").alias("graph"), F.col("frame").cast("long").alias("step"), ((F.col("y") - 50) / 10).alias("px"), (F.col("z") - 5).alias("py"), (F.col("x") + 2).alias("pz"), (F.col("l_partkey") % 3 == 0).alias("known"))
    p = p.withColumns({f"w{i}": F.expr(e).cast("double") for i, e in enumerate(_TURN)} | {f"t{i}": F.expr(e).cast("double") for i, e in enumerate(_SHIFT)})
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    norm = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    w, t, at = ([F.col(c) for c in names] for names in (("w0", "w1", "w2"), ("t0", "t1", "t2"), ("px", "py", "pz")))
    once = cross(w, at)
    angle, twice = norm(w), cross(w, once)
    p = p.withColumns({f"y{i}": at[i] + F.sin(angle) / angle * once[i] + (1 - F.cos(angle)) / (angle * angle) * twice[i] + t[i] for i in range(3)})
    y = [F.col(f"y{i}") for i in range(3)]
    unit = F.when(F.col("known"), 1.0).otherwise(norm(at))
    return p.select("graph", "step", "known", *((c / unit).alias(n) for c, n in zip(at, ("px", "py", "pz"), strict=True)), *((y[i] / norm(y)).alias(n) for i, n in enumerate(("bx", "by", "bz"))))


@query(f"""SELECT l_suppkey AS step, {", ".join(f"round({e}, 4) + 0.0 AS {n}" for e, n in zip(_TURN + _SHIFT, ("rx", "ry", "rz", "tx", "ty", "tz"), strict=True))}, count(*) FILTER (l_partkey % 3 = 0) AS known, count(*) FILTER (l_partkey % 3 <> 0) AS unknown, true AS solved
FROM (SELECT *, l_suppkey AS step FROM lineitem) GROUP BY l_suppkey, step""")
def visual_odometry(spark, sf_dir):
    """Motions of all frames side by side from points of known and of unknown depth, in two passes; the SQL states the motion that the sightings were made by."""
    from prismfield.operators import odometry as O

    out = O.solve_motions(seen_points(spark, sf_dir), A.stored, rounds=6)
    return out.select("step", *((F.round(F.get("motion", F.lit(k)), 4) + 0.0).alias(n) for k, n in enumerate(("rx", "ry", "rz", "tx", "ty", "tz"))), "known", "unknown", "solved")
