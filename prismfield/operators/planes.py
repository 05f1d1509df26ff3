"""Planes of whole clouds: hypotheses as rows, distributed scoring and peeling, rectangles, closing to a box.

A cloud is a key; clouds of any size and number go through the same passes. One round of the peel draws
`trials` triples of points of each cloud by a hash, counts for every hypothesis the points within the threshold
(one partial aggregate over the points), refits the best one from summed moments, and the next round leaves its
inliers out. What is held besides the points are the models: a few numbers for each cloud and round. A round reads the points three
times and sorts or shuffles none of them: what is drawn is found below a bound of the hash, counts and moments are summed by the tasks.

Edge cases: clouds with fewer than three points, or whose draws all lie on lines, have no plane. Ties in the count go to
the first draw. Points with a null or a non-finite coordinate belong to no plane. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .rows import finite

AXES = ("x", "y", "z")
MOST_BROADCAST = 2000  # keys whose models (some 10 KB each) are broadcast; more are joined by salted keys
MOST_CELLS = 200_000  # cells of patches (some 100 bytes each) that are broadcast: they grow with the surfaces, not with the points
SALTS = 16


def beside(points: DataFrame, small: DataFrame, keys: list[str], few: bool | None = None) -> DataFrame:
    """Points with the row of `small` of their key, for a stored table with one row a key; `few` says whether there are at most MOST_BROADCAST, where that is known.

    Few keys are broadcast. Otherwise a hot key's points are dealt over SALTS partitions, each with a copy of its row.
    """
    if small.count() <= MOST_BROADCAST if few is None else few:
        return points.join(F.broadcast(small), keys)
    salted = points.withColumn("__salt", F.pmod(F.xxhash64(*AXES), F.lit(SALTS)))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "__salt"]).drop("__salt")


def _off(m: str) -> str:
    """SQL of a point's distance to the model `m`."""
    return f"abs({m}.hx * x + {m}.hy * y + {m}.hz * z + {m}.hd)"


PAST = "array<struct<hx: double, hy: double, hz: double, hd: double>>"


def _fresh(threshold: float) -> Column:
    """Whether a point is away from all models `past` that were taken out."""
    return ~F.expr(f"exists(past, p -> {_off('p')} < {threshold})")


def draw(points: DataFrame, state: DataFrame, keys: list[str], threshold: float, trials: int, salt: Column, id_col: str, few: bool, bounded: bool = True) -> DataFrame:
    """(keys, n, past, h, kept): planes (trial, hx, hy, hz, hd) through the points with the smallest hashes, three by three, in an array a key of `state`.

    With `bounded` only hashes below a bound are sorted: of `n` points a half more than are drawn, and 200, are expected there. If `kept` is less than
    what is drawn (as when ids repeat), the drawing is not the whole one.
    """
    hashed = F.md5(F.concat_ws(":", salt, F.col(id_col)))
    share = (4.5 * trials + 200) / F.col("n")
    bound = F.when(F.lit(bounded) & (share < 1), F.lpad(F.lower(F.hex(F.floor(share * float(1 << 32)).cast("long"))), 8, "0")).otherwise("g")  # digits end at f
    low = beside(points, state.select(*keys, "past", bound.alias("bound")), keys, few).where(hashed < F.col("bound")).where(_fresh(threshold))
    by = Window.partitionBy(*keys).orderBy(hashed, *AXES)
    first = low.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= 3 * trials)
    trial, corner = F.floor((F.col("__n") - 1) / 3), (F.col("__n") - 1) % 3
    p = lambda k, a: F.max(F.when(corner == k, F.col(a))).alias(f"{a}{k}")
    three = first.groupBy(*keys, trial.alias("trial")).agg(F.count("*").alias("kept"), *(p(k, a) for k in range(3) for a in AXES))
    out = three.selectExpr(*keys, "trial", "kept", "x0", "y0", "z0", *(f"{a}{k} - {a}0 AS {a}{k}" for k in (1, 2) for a in AXES))
    out = out.selectExpr(*keys, "trial", "kept", "x0", "y0", "z0", "y1 * z2 - z1 * y2 AS nx", "z1 * x2 - x1 * z2 AS ny", "x1 * y2 - y1 * x2 AS nz")
    out = out.selectExpr("*", "sqrt(nx * nx + ny * ny + nz * nz) AS size")
    out = out.selectExpr(*keys, "trial", "kept", "size", "x0", "y0", "z0", "nx / nullif(size, 0) AS hx", "ny / nullif(size, 0) AS hy", "nz / nullif(size, 0) AS hz")
    out = out.selectExpr(*keys, "kept", "size", "struct(trial, hx, hy, hz, -(hx * x0 + hy * y0 + hz * z0) AS hd) AS m")
    held = out.groupBy(*keys).agg(F.sum("kept").alias("kept"), F.collect_list(F.when(F.col("size") > 1e-12, F.col("m"))).alias("h"))
    return state.select(*keys, "n", "past").join(held, keys, "left").fillna(0, ["kept"])


#: Least-squares plane from second moments: the axis with the largest determinant is solved for.
_DET = {"x": "yy * zz - yz * yz", "y": "xx * zz - xz * xz", "z": "xx * yy - xy * xy"}
_XY, _XZ, _YZ = "xz * yz - xy * zz", "xy * yz - xz * yy", "xy * xz - yz * xx"
_SOLVED = {"x": (_DET["x"], _XY, _XZ), "y": (_XY, _DET["y"], _YZ), "z": (_XZ, _YZ, _DET["z"])}
_PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]


def _from_moments(p: pd.DataFrame) -> pd.DataFrame:
    """(nx, ny, nz, d, rms) of each row of means; nulls for points on a line."""
    c = {a: p[f"c{a}"].to_numpy(float) for a in AXES}
    m = {a + b: p[f"m{a}{b}"].to_numpy(float) - c[a] * c[b] for a, b in _PAIRS}
    table = pd.DataFrame(m)
    value = lambda e: table.eval(e, engine="python").to_numpy()
    det = np.stack([value(_DET[a]) for a in AXES])
    first = np.where((det[0] >= det[1]) & (det[0] >= det[2]), 0, np.where(det[1] >= det[2], 1, 2))
    raw = [np.choose(first, [value(_SOLVED[a][i]) for a in AXES]) for i in range(3)]
    size = np.where(det.max(0) > 1e-18, np.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2]), np.nan)
    nx, ny, nz = (r / size for r in raw)
    spread = nx * nx * m["xx"] + ny * ny * m["yy"] + nz * nz * m["zz"] + 2 * (nx * ny * m["xy"] + nx * nz * m["xz"] + ny * nz * m["yz"])
    return pd.DataFrame({"nx": nx, "ny": ny, "nz": nz, "d": -(nx * c["x"] + ny * c["y"] + nz * c["z"]), "rms": np.sqrt(np.maximum(spread, 0))}, index=p.index)


def refit(inliers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inliers, cx, cy, cz, nx, ny, nz, d, rms) of the least-squares plane of each key's points; the largest part of the normal is positive.

    Points on a line or a single one have a null normal. The points are summed up by columns; a row of sums a key is solved in whole arrays,
    as nested column formulas would be written out again and again by the optimiser.
    """
    sums = inliers.groupBy(*keys).agg(F.count("*").alias("inliers"), *(F.avg(a).alias(f"c{a}") for a in AXES), *(F.avg(F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in _PAIRS))
    kept = [*keys, "inliers", "cx", "cy", "cz"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in kept)

    def run(batches):
        for p in batches:
            if len(p):
                yield pd.concat([p[kept], _from_moments(p)], axis=1)

    return sums.mapInPandas(run, f"{kinds}, nx double, ny double, nz double, d double, rms double")


BLOCK = 1024  # points a block: its distances stay in the cache


def _hits(xyz: np.ndarray, h: np.ndarray, threshold: float) -> np.ndarray:
    """Points within the threshold of each model (hx, hy, hz, hd: the rows of `h`), by the rounding of the plain sum.

    Distances come from matrix products, which may round otherwise; those that rounding could turn are worked out plainly.
    """
    total, held = np.zeros(h.shape[1], np.int64), np.empty((BLOCK, h.shape[1]))
    rows = np.column_stack([xyz, np.ones(len(xyz))])
    slack = 64 * np.finfo(float).eps * (np.abs(xyz).max(initial=0.0) * 3 + np.abs(h[3]).max(initial=0.0) + threshold)
    for a in range(0, len(rows), BLOCK):
        p = rows[a : a + BLOCK]
        off = np.abs(np.dot(p, h, out=held[: len(p)]), out=held[: len(p)])
        sure, maybe = off < threshold - slack, off < threshold + slack
        total += np.add.reduce(sure.view(np.uint8), axis=0, dtype=np.uint16)
        if np.count_nonzero(sure) != np.count_nonzero(maybe):
            i, j = np.nonzero(maybe & ~sure)
            x, y, z, _ = p[i].T
            total += np.bincount(j[np.abs(h[0, j] * x + h[1, j] * y + h[2, j] * z + h[3, j]) < threshold], minlength=len(total))
    return total


def _counts(points: DataFrame, each: DataFrame, keys: list[str], threshold: float, few: bool) -> DataFrame:
    """(keys, trial, n): fresh points within the threshold of each hypothesis, added up by every task before the shuffle.

    Up to MOST_BROADCAST keys the hypotheses (a bounded number a key) go to all tasks as arrays; more of them are joined and unrolled.
    """
    if not few:
        met = beside(points, each.select(*keys, "past", "h"), keys, few).where(_fresh(threshold)).select(*keys, *AXES, F.explode("h").alias("h")).where(F.expr(_off("h")) < threshold)
        return met.groupBy(*keys, F.col("h.trial").alias("trial")).agg(F.count("*").alias("n"))
    table = lambda ms, at: np.array([tuple(m)[at:] for m in ms], float).reshape(-1, 4).T.copy()
    models = {tuple(r[k] for k in keys): (np.array([m["trial"] for m in r["h"]]), table(r["h"], 1), table(r["past"], 0)) for r in each.collect()}
    shared = points.sparkSession.sparkContext.broadcast(models)
    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        found = {}
        for p in batches:
            xyz = p[list(AXES)].to_numpy(float)
            for key, at in p.groupby(keys, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                if key not in shared.value:
                    continue
                _, h, past = shared.value[key]
                own = xyz[at]
                for hx, hy, hz, hd in past.T:
                    x, y, z = own.T
                    own = own[~(np.abs(hx * x + hy * y + hz * z + hd) < threshold)]
                found[key] = found.get(key, 0) + _hits(own, h, threshold)
        for key, total in found.items():
            yield pd.DataFrame({k: [v] * len(total) for k, v in zip(keys, key, strict=True)} | {"trial": shared.value[key][0], "n": total})

    sent = points.select(*keys, *AXES).mapInPandas(run, f"{kinds}, trial long, n long").where("n > 0")
    return sent.groupBy(*keys, "trial").agg(F.sum("n").alias("n"))


def unpeeled(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, past): number of points of each key, no model taken out."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return points.where(known).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("past", F.expr(f"cast(array() AS {PAST})"))


def best_planes(points: DataFrame, keys: list[str], threshold: float, trials: int, salt: Column, id_col: str, cut, state: DataFrame | None = None, few: bool | None = None) -> DataFrame:
    """One plane a key: the hypothesis (hx, hy, hz, hd) with most points within the threshold, refitted to them.

    `state` is a stored table (keys, n, past) of the models taken out before and the number of points that are left without theirs.
    """
    state = cut(unpeeled(points, keys), "state") if state is None else state
    few = state.count() <= MOST_BROADCAST if few is None else few
    each = cut(draw(points, state, keys, threshold, trials, salt, id_col, few), "models")
    if each.where(F.col("kept") < F.least("n", F.lit(3 * trials))).limit(1).count():
        each = cut(draw(points, state, keys, threshold, trials, salt, id_col, few, False), "models")
    each = each.where(F.size("h") > 0)
    counts = _counts(points, each, keys, threshold, few)
    top = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("trial")).alias("t"))).alias("b")).select(*keys, (-F.col("b.t")).alias("top"))
    best = cut(top.join(each, keys).select(*keys, "past", F.expr("filter(h, m -> m.trial = top)[0]").alias("m")).select(*keys, "past", "m.hx", "m.hy", "m.hz", "m.hd"), "best")
    near = beside(points, best.select(*keys, "past", F.struct("hx", "hy", "hz", "hd").alias("h")), keys, few).where(F.expr(_off("h")) < threshold).where(_fresh(threshold))
    return refit(near, keys).join(best.drop("past"), keys)


def tilt(nz: str = "nz") -> Column:
    """Degrees between a unit normal and the nearer of upright and level."""
    up = F.degrees(F.acos(F.least(F.abs(F.col(nz)), F.lit(1.0))))
    return F.least(up, F.abs(90 - up))


def peel(points: DataFrame, keys: list[str], cut, threshold: float = 0.02, trials: int = 300, least_share: float = 0.0, least: int = 500, max_planes: int = 20, max_attempts: int = 0, max_tilt: float = 15.0, snap: bool = False, id_col: str = "id") -> DataFrame:
    """Planes of each cloud, one (keys, attempt) a row, found one after another; `accepted` says which are planes and which are noise that was taken out.

    A cloud ends once its best plane has fewer inliers than `least` and `least_share` of its points, at `max_planes` planes or `max_attempts` tries.
    A plane tilted by more than `max_tilt` degrees (0: any) is noise. With `snap` the normal is the nearest axis and the plane goes through the centroid.
    """
    points = finite(points.select(*keys, id_col, *AXES), list(AXES))
    floor = F.greatest(F.lit(least), F.ceil(F.col("n") * least_share)).alias("floor")
    active = cut(unpeeled(points, keys).select(*keys, "n", "past", floor).withColumn("planes", F.lit(0)), "active")
    few = active.count() <= MOST_BROADCAST
    found = []
    for attempt in range(max_attempts or 5 * max_planes):
        one = best_planes(points, keys, threshold, trials, F.lit(attempt), id_col, cut, active, few)
        one = one.join(active, keys).where(F.col("inliers") >= F.col("floor")).where(F.col("nx").isNotNull())
        fine = (tilt() <= max_tilt) if max_tilt > 0 else F.lit(True)
        one = cut(one.withColumns({"attempt": F.lit(attempt), "tilt": tilt(), "accepted": fine, "orientation": F.when(F.abs("nz") > 0.5, "floor_ceiling").otherwise("wall")}), "planes")
        found.append(one.drop("n", "floor", "past", "planes"))
        active = cut(one.select(*keys, (F.col("n") - F.col("inliers")).alias("n"), "floor", F.concat("past", F.array(F.struct("hx", "hy", "hz", "hd"))).alias("past"), (F.col("planes") + F.col("accepted").cast("int")).alias("planes")).where((F.col("planes") < max_planes) & (F.col("n") >= F.col("floor"))), "active")
        if not active.limit(1).count():
            break
    out = reduce(DataFrame.unionByName, found)
    number = F.sum(F.col("accepted").cast("int")).over(Window.partitionBy(*keys).orderBy("attempt")) - 1
    out = out.withColumn("plane", F.when(F.col("accepted"), number))
    return snapped(out) if snap else out


def main_axis(prefix: str = "n") -> Column:
    """0, 1 or 2: the axis of the largest part of a vector, the first of equal ones."""
    x, y, z = (F.abs(F.col(f"{prefix}{a}")) for a in AXES)
    return F.when((x >= y) & (x >= z), 0).when(y >= z, 1).otherwise(2)


def snapped(planes: DataFrame) -> DataFrame:
    """Normals turned to the nearest axis, offsets through the centroid, tilt 0."""
    axis = main_axis()
    unit = {f"n{a}": F.when(axis == i, F.signum(f"n{a}")).otherwise(0.0) for i, a in enumerate(AXES)}
    return planes.withColumns(unit | {"tilt": F.lit(0.0)}).withColumn("d", F.expr("-(nx * cx + ny * cy + nz * cz)"))


def members(points: DataFrame, planes: DataFrame, keys: list[str], threshold: float, cut) -> DataFrame:
    """Points with the `attempt` that took them out: the first model of their cloud within the threshold."""
    models = cut(planes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("attempt", "hx", "hy", "hz", "hd"))).alias("models")), "models")
    first = F.get(F.expr(f"filter(models, m -> {_off('m')} < {threshold})"), 0)
    met = beside(points, models, keys).withColumn("__m", F.explode(F.array(first)))  # unrolled: it is worked out once a point
    return met.withColumn("attempt", F.col("__m.attempt")).drop("models", "__m").where(F.col("attempt").isNotNull())


def basis(planes: DataFrame) -> DataFrame:
    """Adds the axes u, v of a plane that follow the structure: x and y for floors, level and upright for walls."""
    flat = F.abs("nz") > 0.5
    raw = {"__ux": F.when(flat, 1 - F.col("nx") * F.col("nx")).otherwise(F.col("ny")), "__uy": F.when(flat, -F.col("nx") * F.col("ny")).otherwise(-F.col("nx")), "__uz": F.when(flat, -F.col("nx") * F.col("nz")).otherwise(0.0)}
    out = planes.withColumns(raw).withColumn("__u", F.expr("sqrt(__ux * __ux + __uy * __uy + __uz * __uz)"))
    out = out.withColumns({f"u{a}": F.col(f"__u{a}") / F.col("__u") for a in AXES})
    cross = {"vx": "ny * uz - nz * uy", "vy": "nz * ux - nx * uz", "vz": "nx * uy - ny * ux"}
    upright = {"vx": 0.0, "vy": 0.0, "vz": 1.0}
    return out.withColumns({c: F.when(flat, F.expr(e)).otherwise(upright[c]) for c, e in cross.items()}).drop("__u", *raw)


def on_plane(inliers: DataFrame, planes: DataFrame, keys: list[str], cut) -> DataFrame:
    """Inliers with their coordinates u, v in their plane, from its centroid."""
    axes = cut(basis(planes).select(*keys, *(f"{p}{a}" for p in "cuv" for a in AXES)), "axes")
    along = lambda p: F.expr(" + ".join(f"({a} - c{a}) * {p}{a}" for a in AXES))
    both = beside(inliers, axes, keys)
    return both.select(*keys, *AXES, along("u").alias("u"), along("v").alias("v"))


def largest_patches(flat: DataFrame, keys: list[str], gap: float, cut, fewest: int = 10) -> DataFrame:
    """Cells (keys, i, j) of edge `gap` of the largest patch of each plane, with extent and count: cells touch at edges and corners.

    Planes of `fewest` points or fewer keep all cells. Of equal patches the one with the smallest cell stays.
    """
    cell = {"i": F.floor(F.col("u") / gap), "j": F.floor(F.col("v") / gap)}
    cells = cut(flat.withColumns(cell).groupBy(*keys, "i", "j").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{f.__name__}") for c in "uv" for f in (F.min, F.max))), "cells")
    node = F.struct(*keys, "i", "j")
    ahead = [(0, 1), (1, -1), (1, 0), (1, 1)]
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in ahead))).alias("m")
    asked = cells.select(*keys, node.alias("src"), "i", "j", moves).select(*keys, "src", (F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"))
    edges = asked.join(cells.select(*keys, "i", "j", node.alias("dst")).hint("merge"), [*keys, "i", "j"]).select("src", "dst")
    label = connected_components(edges, cut, merge=True)
    named = cells.withColumn("node", node).join(label.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy(*keys, "component").agg(F.sum("n").alias("size"))
    whole = Window.partitionBy(*keys)
    chosen = sizes.withColumn("all", F.sum("size").over(whole)).withColumn("place", F.row_number().over(whole.orderBy(F.desc("size"), "component")))
    chosen = chosen.where((F.col("place") == 1) | (F.col("all") <= fewest)).select(*keys, "component")
    return named.join(chosen, [*keys, "component"]).drop("component", "node")


def in_patches(flat: DataFrame, keys: list[str], gap: float, cut) -> DataFrame:
    """Points (keys, u, v) of the largest patch of each plane. Up to MOST_CELLS cells go to the points; beyond that both sides are shuffled."""
    cell = {"i": F.floor(F.col("u") / gap), "j": F.floor(F.col("v") / gap)}
    patch = cut(largest_patches(flat, keys, gap, cut).select(*keys, "i", "j"), "patch")
    held = F.broadcast(patch) if patch.count() <= MOST_CELLS else patch.hint("merge")
    return flat.withColumns(cell).join(held, [*keys, "i", "j"]).drop("i", "j")


def rectangles(inliers: DataFrame, planes: DataFrame, keys: list[str], gap: float, cut) -> DataFrame:
    """(keys, u0, u1, v0, v1, width, height, area): structure-aligned rectangle of the largest patch of each plane's inliers."""
    flat = on_plane(inliers, planes, keys, cut)
    part = largest_patches(flat, keys, gap, cut) if gap > 0 else flat.selectExpr(*keys, "u AS u_min", "u AS u_max", "v AS v_min", "v AS v_max")
    box = part.groupBy(*keys).agg(F.min("u_min").alias("u0"), F.max("u_max").alias("u1"), F.min("v_min").alias("v0"), F.max("v_max").alias("v1"))
    return box.selectExpr("*", "u1 - u0 AS width", "v1 - v0 AS height", "(u1 - u0) * (v1 - v0) AS area")


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, without points on its edges."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(corners: np.ndarray) -> tuple[float, float, float, float, float]:
    """(centre u, centre v, width, height, degrees) of the rectangle of least area around a hull: one of its sides lies on the hull's."""
    if len(corners) < 3:
        low, high = corners.min(0), corners.max(0)
        side = high - low
        angle = float(np.degrees(np.arctan2(*(corners[-1] - corners[0])[::-1]))) % 90
        return (*((low + high) / 2), float(np.hypot(*side)), 0.0, angle)
    edges = np.roll(corners, -1, axis=0) - corners
    angles = np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 12))
    best = None
    for t in angles:
        c, s = np.cos(t), np.sin(t)
        turned = corners @ np.array([[c, -s], [s, c]])
        low, high = turned.min(0), turned.max(0)
        w, h = high - low
        if best is None or w * h < best[0] - 1e-12:
            mid = (low + high) / 2
            best = (w * h, mid[0] * c - mid[1] * s, mid[0] * s + mid[1] * c, w, h, np.degrees(t))
    return tuple(float(x) for x in best[1:])


def least_rectangles(flat: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centre_u, centre_v, width, height, angle): least-area rectangle of each plane's points (u, v).

    Every batch sends the corners of its points' hulls only; the hull of all is that of these.
    """
    kinds = ", ".join(f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in keys)

    def corners(batches):
        for pdf in batches:
            parts = [g[keys].iloc[[0] * len(h)].assign(u=h[:, 0], v=h[:, 1]) for _, g in pdf.groupby(keys, dropna=False) if len(h := hull(g[["u", "v"]].to_numpy(float)))]
            if parts:
                yield pd.concat(parts)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        r = least_rectangle(hull(g[["u", "v"]].to_numpy(float)))
        return g[keys].iloc[:1].assign(centre_u=r[0], centre_v=r[1], width=r[2], height=r[3], angle=r[4])

    held = flat.select(*keys, "u", "v").mapInPandas(corners, f"{kinds}, u double, v double")
    return held.groupBy(*keys).applyInPandas(fit, f"{kinds}, centre_u double, centre_v double, width double, height double, angle double")


def unlike(planes: DataFrame, keys: list[str], degrees: float = 10.0, offset: float = 0.15) -> DataFrame:
    """One plane of each physical surface: by falling inliers, a plane absorbs those within the angle and the offset. At most max_planes rows a cloud."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("plane", ignore_index=True)
        n = g[["nx", "ny", "nz"]].to_numpy(float)
        n = n / np.linalg.norm(n, axis=1, keepdims=True)
        sign = np.where(n[np.arange(len(n)), np.abs(n).argmax(1)] < 0, -1.0, 1.0)
        n, d = n * sign[:, None], g["d"].to_numpy(float) * sign
        kept: list[int] = []
        for i in np.argsort(-g["inliers"].to_numpy(), kind="stable"):
            if all(np.degrees(np.arccos(np.clip(n[i] @ n[k], -1, 1))) >= degrees or abs(d[i] - d[k]) >= offset for k in kept):
                kept.append(i)
        out = g.iloc[sorted(kept)].copy()
        out["plane"] = np.arange(len(out))
        return out

    return planes.groupBy(*keys).applyInPandas(run, planes.schema)


def _sides(planes: DataFrame, keys: list[str]) -> DataFrame:
    """Planes with axis and side ('-' below, '+' from the cloud's centre on), the largest of each side only."""
    whole = Window.partitionBy(*keys)
    weight = F.sum("inliers").over(whole)
    centre = {f"__m{a}": F.sum(F.col(f"c{a}") * F.col("inliers")).over(whole) / weight for a in AXES}
    out = planes.withColumns(centre | {"axis": main_axis()})
    at = lambda p: F.when(F.col("axis") == 0, F.col(f"{p}x")).when(F.col("axis") == 1, F.col(f"{p}y")).otherwise(F.col(f"{p}z"))
    out = out.withColumns({"fixed": at("c"), "side": F.when(at("c") < at("__m"), "-").otherwise("+")}).drop(*centre)
    place = F.row_number().over(Window.partitionBy(*keys, "axis", "side").orderBy(F.desc("inliers"), "plane"))
    return out.withColumn("__place", place).where("__place = 1").drop("__place")


FACE = ["plane", "axis", "side", "fixed", "inliers", "retried"]


def extents(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high): arrays of the smallest and the largest coordinate of each axis."""
    return points.groupBy(*keys).agg(F.array(*(F.min(a) for a in AXES)).alias("low"), F.array(*(F.max(a) for a in AXES)).alias("high"))


def closing_planes(kept: DataFrame, points: DataFrame, extent: DataFrame, keys: list[str], cut, threshold: float, trials: int, least: int, least_share: float, margin: float, least_density: float, gap: float, roi: tuple[float, ...] | None, id_col: str) -> DataFrame:
    """Planes for sides that have none though their axis has one: fitted in a slab at the cloud's end with a lower bound of inliers.

    A plane turned another way, or with less than `least_density` of the median points per area of the kept planes, closes nothing.
    A side that lies on the crop `roi` (x0, x1, y0, y1, z0, z1) stays open: there is no end of the data there.
    """
    both = F.explode(F.array(F.lit("-"), F.lit("+"))).alias("side")
    missing = kept.select(*keys, "axis").distinct().select(*keys, "axis", both).join(kept, [*keys, "axis", "side"], "left_anti")
    ends = missing.join(extent, keys).withColumn("edge", F.when(F.col("side") == "-", F.get("low", F.col("axis"))).otherwise(F.get("high", F.col("axis"))))
    if roi is not None:
        bound = F.get(F.array(*(F.lit(float(v)) for v in roi)), 2 * F.col("axis") + F.when(F.col("side") == "-", 0).otherwise(1))
        ends = ends.where(F.abs(F.col("edge") - bound) >= 0.05)
    ends = cut(ends.groupBy(*keys).agg(F.collect_list(F.struct("axis", "side", "edge")).alias("ends")), "ends")
    at = F.when(F.col("e.axis") == 0, F.col("x")).when(F.col("e.axis") == 1, F.col("y")).otherwise(F.col("z"))
    inside = F.when(F.col("e.side") == "-", at <= F.col("e.edge") + margin).otherwise(at >= F.col("e.edge") - margin)
    slab = beside(points, ends, keys).select(*keys, id_col, *AXES, F.explode("ends").alias("e")).where(inside).select(*keys, F.col("e.axis").alias("axis"), F.col("e.side").alias("side"), id_col, *AXES)
    sub = [*keys, "axis", "side"]
    floor = cut(points.groupBy(*keys).agg(F.greatest(F.lit(least), F.ceil(F.count("*") * least_share)).alias("floor")), "floors")
    fit = best_planes(slab, sub, threshold, trials, F.concat_ws("/", F.lit("slab"), "axis", "side"), id_col, cut)
    fit = cut(fit.join(floor, keys).where((F.col("inliers") >= F.col("floor")) & (main_axis() == F.col("axis"))).drop("floor"), "slab planes")
    near = beside(slab, fit.select(*sub, F.struct("hx", "hy", "hz", "hd").alias("h")), sub).where(F.expr(_off("h")) < threshold).drop("h")
    sized = fit.join(rectangles(near, fit, sub, gap, cut), sub)
    usual = kept.where("area > 0").groupBy(*keys).agg(F.percentile(F.col("inliers") / F.col("area"), 0.5).alias("usual"))
    dense = sized.join(usual, keys, "left").where(F.col("usual").isNull() | (F.col("inliers") >= F.col("usual") * least_density * F.col("area")))
    fixed = F.when(F.col("axis") == 0, F.col("cx")).when(F.col("axis") == 1, F.col("cy")).otherwise(F.col("cz"))
    return dense.select(*sub, fixed.alias("fixed"), "inliers")


def box_faces(kept: DataFrame, extent: DataFrame, keys: list[str], cap: bool = True) -> DataFrame:
    """Faces of the box of each cloud with three independent faces or more: every rectangle reaches to the same bounds, so edges meet exactly.

    `kept`: (keys, plane, axis, side, fixed, inliers, retried). An axis with one face ends at the extent of the data on the other side, one without at both;
    with `cap` such open sides get a synthetic face. Faces are numbered by plane, caps come last.
    """
    whole = Window.partitionBy(*keys)
    kept = kept.withColumn("__faces", F.count("*").over(whole)).where("__faces >= 3").drop("__faces")
    axes = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("axis")
    seen = kept.groupBy(*keys, "axis").agg(F.min("fixed").alias("least"), F.max("fixed").alias("most"))
    every = kept.select(*keys).distinct().select(*keys, axes).join(seen, [*keys, "axis"], "left").join(extent, keys)
    lo, hi = F.get("low", F.col("axis")), F.get("high", F.col("axis"))
    two = F.col("most") - F.col("least") > 1e-9
    upper = F.abs(F.col("least") - hi) < F.abs(F.col("least") - lo)  # the only face is the upper one
    start = F.when(two, F.col("least")).when(F.col("least").isNull() | upper, lo).otherwise(F.col("least"))
    stop = F.when(two, F.col("most")).when(F.col("least").isNull() | ~upper, hi).otherwise(F.col("least"))
    open_low, open_high = F.col("least").isNull() | (~two & upper), F.col("least").isNull() | (~two & ~upper)
    bounds = every.select(*keys, "axis", start.alias("start"), stop.alias("stop"), open_low.alias("open_low"), open_high.alias("open_high"))
    faces = kept.select(*keys, *FACE).withColumn("synthetic", F.lit(False))
    if cap:
        for flag, side, at in (("open_low", "-", "start"), ("open_high", "+", "stop")):
            cap_of = bounds.where(flag).select(*keys, F.lit(None).cast("int").alias("plane"), "axis", F.lit(side).alias("side"), F.col(at).alias("fixed"), F.lit(0).cast("long").alias("inliers"), F.lit(False).alias("retried"), F.lit(True).alias("synthetic"))
            faces = faces.unionByName(cap_of)
    wide = bounds.groupBy(*keys).agg(*(F.max(F.when(F.col("axis") == i, F.col(c))).alias(f"{c}{i}") for i in range(3) for c in ("start", "stop")))
    other = lambda c, first: F.when(F.col("axis") == 0, F.col(f"{c}{1 if first else 2}")).when(F.col("axis") == 1, F.col(f"{c}{0 if first else 2}")).otherwise(F.col(f"{c}{0 if first else 1}"))
    out = faces.join(wide, keys).select(*keys, *FACE, "synthetic", other("start", True).alias("a0"), other("stop", True).alias("a1"), other("start", False).alias("b0"), other("stop", False).alias("b1"))
    number = F.row_number().over(whole.orderBy(F.col("plane").asc_nulls_last(), "axis", "side")) - 1
    return out.withColumns({"face": number, "area": (F.col("a1") - F.col("a0")) * (F.col("b1") - F.col("b0"))})


def close_box(planes: DataFrame, points: DataFrame, keys: list[str], cut, threshold: float = 0.02, trials: int = 300, retry_least: int = 150, retry_share: float = 0.0, margin: float = 0.5, least_density: float = 0.4, gap: float = 0.3, roi: tuple[float, ...] | None = None, cap: bool = True, id_col: str = "id") -> DataFrame:
    """Box of each cloud from its planes (with inliers, centroid, normal, area): the largest plane of each side, missing sides fitted once more, caps, shared edges."""
    points = finite(points.select(*keys, id_col, *AXES), list(AXES))
    extent = cut(extents(points, keys), "extents")
    kept = cut(_sides(planes, keys), "sides")
    more = closing_planes(kept, points, extent, keys, cut, threshold, trials, retry_least, retry_share, margin, least_density, gap, roi, id_col)
    next_id = planes.groupBy(*keys).agg(F.max("plane").alias("last"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("axis", "side"))
    more = more.join(next_id, keys).select(*keys, (F.col("last") + place).alias("plane"), "axis", "side", "fixed", "inliers", F.lit(True).alias("retried"))
    faces = kept.select(*keys, "plane", "axis", "side", "fixed", "inliers", F.lit(False).alias("retried")).unionByName(more)
    return box_faces(cut(faces, "faces"), extent, keys, cap)


def reclose(planes: DataFrame, frames: DataFrame, keys: list[str], cut, cap: bool = True) -> DataFrame:
    """Box of planes turned into their building's frame: p -> R p + t, then sides, bounds and edges anew, without points.

    `planes` have normal, centroid and `corners` (array of struct x, y, z); `frames` (keys, r array of 9 by rows, t array of 3).
    """
    m = lambda p, i, move: " + ".join(f"r[{3 * i + j}] * {p}{a}" for j, a in enumerate(AXES)) + (f" + t[{i}]" if move else "")
    turned = planes.join(frames, keys)
    at = F.expr("transform(corners, q -> struct(" + ", ".join(f"{m('q.', i, True)} AS {a}" for i, a in enumerate(AXES)) + "))")
    turned = turned.select(*keys, "plane", "inliers", "area", *(F.expr(m("n", i, False)).alias(f"n{a}") for i, a in enumerate(AXES)), *(F.expr(m("c", i, True)).alias(f"c{a}") for i, a in enumerate(AXES)), at.alias("corners"))
    kept = cut(_sides(turned, keys), "sides")
    extent = extents(kept.select(*keys, F.explode("corners").alias("q")).select(*keys, "q.x", "q.y", "q.z"), keys)
    return box_faces(kept.withColumn("retried", F.lit(False)), extent, keys, cap)
