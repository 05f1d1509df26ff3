"""Drift of a path against the building: roll, pitch and height by the floor that each scan sees, yaw by its walls.

Scans are (graph, node, id, x, y, z) in the sensor's frame, poses as in `posegraph`. Scans become a few numbers each by aggregates; what follows are rows of poses.
Values along a path are filled and summed in blocks of BLOCK nodes, so that no task orders a whole path; one row a block is ordered in one.

Edge cases: scans with too few points see no floor or wall; their corrections are interpolated between the nearest that have one, and held beyond the first
and the last. A path without any floor keeps its poses (its tilt is null). Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import planes as P
from .posegraph import _stack, axis_angle, quaternion, spin, turn

BLOCK = 1000
AXES = ("x", "y", "z")


def floors(scans: DataFrame, cut, below: float = 0.12, band: float = 0.3, tolerance: float = 0.05, fewest: tuple[int, int, int] = (80, 50, 40), least_share: float = 0.5, most_tilt: float = 15.0, trials: int = 30) -> DataFrame:
    """(graph, node, nx, ny, nz, distance): upward normal of the floor in the sensor's frame and the sensor's height over it, of scans that see one.

    The band of candidates starts at a low percentile of the heights, as one stray point below the floor would move a minimum.
    A plane with less than `least_share` of the band is a slice through walls, not a floor.
    """
    key = ["graph", "node"]
    low = scans.groupBy(*key).agg(F.percentile("z", 0.02).alias("low"), F.count("*").alias("points")).where(F.col("points") >= fewest[0])
    near = scans.join(low, key).where((F.col("z") > F.col("low") - below) & (F.col("z") < F.col("low") + band))
    enough = cut(near.groupBy(*key).agg(F.count("*").alias("band")).where(F.col("band") >= fewest[1]), "bands")
    held = cut(near.join(enough, key).select(*key, "id", *AXES), "floors")
    plane = P.best_planes(held, key, tolerance, trials, F.lit("floor"), "id", cut)
    up = F.signum("nz")
    tilted = F.degrees(F.acos(F.least(F.abs("nz"), F.lit(1.0))))
    plane = plane.join(enough, key).where(F.col("inliers") >= F.col("band") * least_share)
    return plane.where(F.col("nz").isNotNull() & (F.col("inliers") >= fewest[2]) & (tilted <= most_tilt)).select(*key, *((F.col(f"n{a}") * up).alias(f"n{a}") for a in AXES), (F.col("d") * up).alias("distance"))


def walls(scans: DataFrame, poses: DataFrame, cell: float = 0.5, most_nz: float = 0.2, fewest: int = 6, least: int = 3) -> DataFrame:
    """(graph, node, re, im): mean of exp(4 i azimuth) over the walls that a scan sees in the world's frame, weighed by points; null with fewer than `least` cells of wall.

    A cell's points give its normal by their moments. Four times the azimuth makes the four sides of a building one direction.
    """
    key = ["graph", "node"]
    cells = scans.select(*key, *AXES, *(F.floor(F.col(a) / cell).alias(f"c{i}") for i, a in enumerate(AXES)))
    fit = P.refit(cells, [*key, "c0", "c1", "c2"]).where((F.col("inliers") >= fewest) & F.col("nx").isNotNull() & (F.col("rms") < cell / 10))
    both = fit.join(poses.select(*key, "q"), key)
    x, y, z, w = (F.get("q", F.lit(k)) for k in range(4))
    nx, ny, nz = (F.col(f"n{a}") for a in AXES)
    cx, cy, cz = y * nz - z * ny, z * nx - x * nz, x * ny - y * nx
    world = both.withColumns({"wx": nx + 2 * (w * cx + y * cz - z * cy), "wy": ny + 2 * (w * cy + z * cx - x * cz), "wz": nz + 2 * (w * cz + x * cy - y * cx)}).where(F.abs("wz") < most_nz)
    at = 4 * F.atan2("wy", "wx")
    mean = lambda f: F.when(F.count("*") >= least, F.sum(f(at) * F.col("inliers")) / F.sum("inliers"))
    return world.groupBy(*key).agg(mean(F.cos).alias("re"), mean(F.sin).alias("im"))


def _block(c: str = "node") -> Column:
    return F.floor(F.col(c) / BLOCK)


def neighbours_with(rows: DataFrame, value: str) -> DataFrame:
    """Rows (graph, node, ..) with `before` and `after`: structs (node, value) of the nearest rows at or before and at or after that have one."""
    held = F.when(F.col(value).isNotNull(), F.struct("node", F.col(value).alias("v")))
    rows = rows.withColumn("__b", _block())
    inner = Window.partitionBy("graph", "__b").orderBy("node")
    rows = rows.withColumns({"__l": F.last(held, True).over(inner.rowsBetween(Window.unboundedPreceding, 0)), "__f": F.first(held, True).over(inner.rowsBetween(0, Window.unboundedFollowing))})
    ends = rows.groupBy("graph", "__b").agg(F.max_by("__l", "node").alias("last"), F.min_by("__f", "node").alias("first"))
    outer = Window.partitionBy("graph").orderBy("__b")
    ends = ends.select("graph", "__b", F.last("last", True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("__pl"), F.first("first", True).over(outer.rowsBetween(1, Window.unboundedFollowing)).alias("__nf"))
    return rows.join(ends, ["graph", "__b"]).withColumns({"before": F.coalesce("__l", "__pl"), "after": F.coalesce("__f", "__nf")}).drop("__b", "__l", "__f", "__pl", "__nf")


def reintegrate(poses: DataFrame, corrections: DataFrame, cut) -> DataFrame:
    """Poses with the attitude C R for corrections (graph, node, c: rotation vector), and positions from the path's own steps in the corrected attitudes."""

    def steps(batches):
        for p in batches:
            if len(p):
                r, c = turn(_stack(p["q"], 4)), spin(_stack(p["c"], 3))
                new = c @ r
                ahead = p["t_next"].notna().to_numpy()
                d = np.zeros((len(p), 3))
                if ahead.any():
                    move = _stack(p["t_next"][ahead], 3) - _stack(p["t"][ahead], 3)
                    d[ahead] = np.einsum("nab,nb->na", c[ahead], move)  # C R R' moves the step by C
                yield pd.DataFrame({"graph": p["graph"], "node": p["node"], "x": d[:, 0], "y": d[:, 1], "z": d[:, 2], "q": list(quaternion(new)), "t": p["t"]})

    after = poses.select("graph", (F.col("node") - 1).alias("node"), F.col("t").alias("t_next"))
    both = poses.join(corrections, ["graph", "node"]).join(after, ["graph", "node"], "left").select("graph", "node", "t", "q", "c", "t_next")
    made = cut(both.mapInPandas(steps, "graph long, node long, x double, y double, z double, q array<double>, t array<double>").withColumn("b", _block()), "steps")
    sums = made.groupBy("graph", "b").agg(*(F.sum(a).alias(f"s{a}") for a in AXES))
    outer = Window.partitionBy("graph").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("graph", "b", *(F.coalesce(F.sum(f"s{a}").over(outer), F.lit(0.0)).alias(f"s{a}") for a in AXES))
    inner = Window.partitionBy("graph", "b").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    start = made.groupBy("graph").agg(F.min_by("t", "node").alias("t0"))
    at = lambda k, a: F.get("t0", F.lit(k)) + F.col(f"s{a}") + F.coalesce(F.sum(a).over(inner), F.lit(0.0))
    return made.join(carried, ["graph", "b"]).join(start, "graph").select("graph", "node", F.array(*(at(k, a) for k, a in enumerate(AXES))).alias("t"), "q")


def level(poses: DataFrame, seen: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """Poses whose floors are level, and (graph, node, tilt): degrees by which each floor was off before.

    The correction turns the seen normal upright about the axis across both; between scans with a floor it is interpolated on the sphere.
    """

    def upright(batches):
        for p in batches:
            if len(p):
                n = np.einsum("nab,nb->na", turn(_stack(p["q"], 4)), p[["nx", "ny", "nz"]].to_numpy(float))
                n = n * np.where(n[:, 2:] < 0, -1.0, 1.0) / np.linalg.norm(n, axis=1, keepdims=True)
                axis = np.stack([n[:, 1], -n[:, 0], np.zeros(len(n))], 1)  # n x up
                size = np.linalg.norm(axis, axis=1, keepdims=True)
                angle = np.arctan2(size, n[:, 2:])
                yield pd.DataFrame({"graph": p["graph"], "node": p["node"], "c": list(np.where(size > 1e-8, axis / np.where(size > 1e-8, size, 1) * angle, 0.0)), "tilt": np.degrees(angle[:, 0])})

    got = cut(poses.join(seen, ["graph", "node"]).select("graph", "node", "q", "nx", "ny", "nz").mapInPandas(upright, "graph long, node long, c array<double>, tilt double"), "tilts")
    near = neighbours_with(poses.select("graph", "node").join(got, ["graph", "node"], "left"), "c")

    def between(batches):
        for p in batches:
            if len(p):
                a = np.array([x["v"] if x is not None else (y["v"] if y is not None else [0.0] * 3) for x, y in zip(p["before"], p["after"], strict=True)], float)
                b = np.array([y["v"] if y is not None else (x["v"] if x is not None else [0.0] * 3) for x, y in zip(p["before"], p["after"], strict=True)], float)
                i = np.array([x["node"] if x is not None else n for x, n in zip(p["before"], p["node"], strict=True)], float)
                j = np.array([y["node"] if y is not None else n for y, n in zip(p["after"], p["node"], strict=True)], float)
                part = np.where(j > i, (p["node"].to_numpy(float) - i) / np.where(j > i, j - i, 1), 0.0)
                ra = spin(a)
                c = ra @ spin(part[:, None] * axis_angle(ra.transpose(0, 2, 1) @ spin(b)))
                yield pd.DataFrame({"graph": p["graph"], "node": p["node"], "c": list(axis_angle(c))})

    filled = near.select("graph", "node", "before", "after").mapInPandas(between, "graph long, node long, c array<double>")
    return reintegrate(poses, filled, cut), got.select("graph", "node", "tilt")


def straighten(poses: DataFrame, seen: DataFrame, cut, reference: int = 10, smooth: int = 11) -> DataFrame:
    """Poses whose walls keep the direction of the first `reference` scans: yaw drift from the wall direction smoothed over `smooth` nodes, wrapped to 45 degrees either way.

    It assumes that the building's walls stand at right angles; a path that meets two building axes at other angles must not be straightened.
    """
    first = poses.groupBy("graph").agg(F.min("node").alias("from"))
    ref = seen.join(first, "graph").where(F.col("node") < F.col("from") + reference).groupBy("graph").agg(F.avg("re").alias("r_re"), F.avg("im").alias("r_im"))
    half = smooth // 2
    spread = seen.where("re IS NOT NULL").select("graph", F.explode(F.sequence(F.col("node") - half, F.col("node") + half)).alias("node"), "re", "im")
    mean = poses.select("graph", "node").join(spread, ["graph", "node"], "left").groupBy("graph", "node").agg(F.when(F.count("re") > 0, F.struct(F.avg("re").alias("re"), F.avg("im").alias("im"))).alias("m"))
    near = neighbours_with(mean, "m")
    closer = F.col("before").isNotNull() & (F.col("after").isNull() | (F.col("node") - F.col("before.node") <= F.col("after.node") - F.col("node")))
    m = F.when(closer, F.col("before.v")).otherwise(F.col("after.v"))
    off = near.join(ref, "graph", "left").select("graph", "node", F.degrees(F.atan2(m["im"] * F.col("r_re") - m["re"] * F.col("r_im"), m["re"] * F.col("r_re") + m["im"] * F.col("r_im")) / 4).alias("yaw"))
    wrapped = F.coalesce(F.col("yaw") - 90 * F.floor((F.col("yaw") + 45) / 90), F.lit(0.0))
    turned = off.select("graph", "node", F.array(F.lit(0.0), F.lit(0.0), -F.radians(wrapped)).alias("c"))
    return reintegrate(poses, turned, cut)
