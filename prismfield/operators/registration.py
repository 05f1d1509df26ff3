"""Loop closure: revisit candidates from scan descriptors and from near places, and their registration by closest points.

Scans are (graph, node, x, y, z) in the sensor's frame, poses as in `posegraph`. Nothing compares all pairs of scans or of points:
descriptors meet in cells of two of their sums, places in cells of the radius, points in cells of the inlier distance. A cell holds the fixed points in and around
it, so scans must be thinned to cells first, as a keyframe's are.

Edge cases: scans without points have no descriptor and no candidate; a pair with fewer than `least` close points is 'no overlap'; equal
distances go to the smaller node. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .posegraph import _stack, axis_angle, quaternion, relative_poses, turn

AXES = ("x", "y", "z")


def descriptors(scans: DataFrame, rings: int = 20, sectors: int = 60, radius: float = 20.0) -> DataFrame:
    """(graph, node, key, cells): share of filled sectors of each ring, and the largest height of every filled (ring, sector), both around the sensor."""
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    ring = F.floor(far / radius * rings)
    sector = F.floor((F.atan2("y", "x") + np.pi) / (2 * np.pi) * sectors) % sectors
    cells = scans.select("graph", "node", ring.alias("ring"), sector.alias("sector"), "z").where(F.col("ring") < rings).groupBy("graph", "node", "ring", "sector").agg(F.max("z").alias("top"))
    by = cells.groupBy("graph", "node").agg(*(F.sum(F.when(F.col("ring") == r, 1 / sectors).otherwise(0.0)).alias(f"r{r}") for r in range(rings)), F.collect_list(F.struct((F.col("ring") * sectors + F.col("sector")).cast("int").alias("at"), "top")).alias("cells"))
    return by.select("graph", "node", F.array(*(f"r{r}" for r in range(rings))).alias("key"), "cells")


def _near_cells(rows: DataFrame, at: list[Column], width: float, reach: bool) -> DataFrame:
    """Rows with their cell c0, c1, ..; with `reach` once for each cell around it."""
    out = rows
    for k, c in enumerate(at):
        cell = F.floor(c / width).cast("long")
        out = out.withColumn(f"c{k}", F.explode(F.sequence(cell - 1, cell + 1)) if reach else cell)
    return out


def appearance_candidates(described: DataFrame, key_limit: float = 0.3, limit: float = 0.2, excluded: int = 10, most: int = 3, rings: int = 20, sectors: int = 60) -> DataFrame:
    """(graph, i, j, distance): for each node j up to `most` earlier nodes i, at least `excluded` before it, whose descriptors are alike at some turn.

    The distance is the mean over sectors filled in both of 1 minus the cosine of the columns, at the best turn.
    """
    half = rings // 2
    total = lambda a, b: F.aggregate(F.slice("key", a + 1, b - a), F.lit(0.0), lambda s, v: s + v)
    # Keys within the limit differ by at most limit * sqrt(n) in a sum over n rings.
    width = key_limit * float(np.sqrt(half))
    sums = [total(0, half), total(half, 2 * half)]
    late = _near_cells(described.select("graph", F.col("node").alias("j"), F.col("key").alias("kj"), "key"), sums, width, True).drop("key")
    early = _near_cells(described.select("graph", F.col("node").alias("i"), F.col("key").alias("ki"), "key"), sums, width, False).drop("key")
    off = F.sqrt(F.aggregate(F.zip_with("ki", "kj", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    pairs = late.join(early, ["graph", "c0", "c1"]).where(F.col("i") <= F.col("j") - excluded - 1).where(off <= key_limit).select("graph", "i", "j")
    at = lambda c: described.select("graph", F.col("node").alias(c), F.col("cells").alias(f"cells_{c}"))

    def run(batches):
        for p in batches:
            out = []
            for graph, i, j, a, b in zip(p["graph"], p["i"], p["j"], p["cells_i"], p["cells_j"], strict=True):
                out.append((graph, i, j, descriptor_distance(_grid(a, rings, sectors), _grid(b, rings, sectors))))
            yield pd.DataFrame(out, columns=["graph", "i", "j", "distance"])

    scored = pairs.join(at("i"), ["graph", "i"]).join(at("j"), ["graph", "j"]).select("graph", "i", "j", "cells_i", "cells_j").mapInPandas(run, "graph long, i long, j long, distance double")
    place = F.row_number().over(Window.partitionBy("graph", "j").orderBy("distance", "i"))
    return scored.where(F.col("distance") <= limit).withColumn("place", place).where(F.col("place") <= most).drop("place")


def _grid(cells, rings: int, sectors: int) -> np.ndarray:
    out = np.zeros(rings * sectors)
    for c in cells:
        out[c["at"]] = c["top"]
    return out.reshape(rings, sectors)


def descriptor_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Least mean column distance over all turns of one of them; 1 where no column is filled in both."""
    size_a, size_b = np.linalg.norm(a, axis=0), np.linalg.norm(b, axis=0)
    best = 1.0
    for s in range(a.shape[1]):
        turned, size = np.roll(b, s, 1), np.roll(size_b, s)
        both = (size_a > 0) & (size > 0)
        if both.any():
            best = min(best, float(1 - ((a * turned).sum(0)[both] / (size_a[both] * size[both])).mean()))
    return best


def place_candidates(poses: DataFrame, radius: float, gap: int) -> DataFrame:
    """(graph, i, j, distance): pairs at least `gap` nodes apart and within the radius in plan, by an equi-join on cells of the radius."""
    at = poses.select("graph", "node", F.get("t", F.lit(0)).alias("x"), F.get("t", F.lit(1)).alias("y"))
    both = [F.col("x"), F.col("y")]
    a = _near_cells(at, both, radius, True).select("graph", "c0", "c1", F.col("node").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = _near_cells(at, both, radius, False).select("graph", "c0", "c1", F.col("node").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    off = F.sqrt((F.col("xi") - F.col("xj")) * (F.col("xi") - F.col("xj")) + (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj")))
    return a.join(b, ["graph", "c0", "c1"]).where(F.col("j") - F.col("i") >= gap).select("graph", "i", "j", off.alias("distance")).where(F.col("distance") <= radius)


def surroundings(fixed: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """(keys, c0, c1, c2, near): for each cell of edge `distance` that has fixed points in it or beside it, those points. It serves all moving points of that cell."""
    axes = [F.col(a) for a in AXES]
    cells = _near_cells(fixed.select(*keys, *AXES), axes, distance, True)
    return cells.groupBy(*keys, "c0", "c1", "c2").agg(F.collect_list(F.struct(*(F.col(a).alias(f"f{a}") for a in AXES))).alias("near"))


def nearest_of(moving: DataFrame, around: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """Moving points with their nearest fixed point (fx, fy, fz, d2) within the distance, from the surroundings of their cell: one row a point is shuffled."""
    asked = _near_cells(moving, [F.col(a) for a in AXES], distance, False)
    d2 = lambda f: sum((F.col(a) - f[f"f{a}"]) * (F.col(a) - f[f"f{a}"]) for a in AXES).alias("d2")
    at = [*keys, "c0", "c1", "c2"]
    parts = int(moving.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the rows are few bytes but much work: they are not put together again
    met = asked.repartition(parts, *at).join(around.repartition(parts, *at).hint("merge"), at)
    best = F.array_min(F.transform("near", lambda f: F.struct(d2(f), *(f[f"f{a}"].alias(f"f{a}") for a in AXES))))
    near = met.select(*moving.columns, F.explode(F.array(best)).alias("__m"))  # unrolled: it is worked out once a point
    return near.select(*moving.columns, *(F.col(f"__m.{c}") for c in ("fx", "fy", "fz", "d2"))).where(F.col("d2") <= distance * distance)


def nearest_points(moving: DataFrame, fixed: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """(keys, id, x, y, z, fx, fy, fz, d2): each moving point with its nearest fixed point within the distance."""
    return nearest_of(moving.select(*keys, "id", *AXES), surroundings(fixed, keys, distance), keys, distance)


_SUMS = ["n", "d2", *(f"p{a}" for a in AXES), *(f"f{a}" for a in AXES), *(f"m{a}{b}" for a in AXES for b in AXES)]


def moments(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Means of matched points, of their fixed partners and of all products of their parts: all that a rigid alignment needs."""
    return matched.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("d2").alias("d2"), *(F.avg(a).alias(f"p{a}") for a in AXES), *(F.avg(f"f{a}").alias(f"f{a}") for a in AXES),
        *(F.avg(F.col(a) * F.col(f"f{b}")).alias(f"m{a}{b}") for a in AXES for b in AXES),
    )


def rigid(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and translations that bring the points nearest to their partners, from the moments."""
    s = lambda names: p[names].to_numpy(float)
    a, b = s([f"p{x}" for x in AXES]), s([f"f{x}" for x in AXES])
    h = s([f"m{x}{y}" for x in AXES for y in AXES]).reshape(-1, 3, 3) - a[:, :, None] * b[:, None, :]
    u, _, vt = np.linalg.svd(h)
    v, ut = vt.transpose(0, 2, 1), u.transpose(0, 2, 1)
    sign = np.ones((len(p), 3))
    sign[:, 2] = np.sign(np.linalg.det(v @ ut))
    r = v @ (sign[:, :, None] * ut)
    return r, b - np.einsum("nab,nb->na", r, a)


def _placed(points: DataFrame) -> DataFrame:
    """Points (x, y, z) by the pose (t, q) in their row, in whole columns."""
    x, y, z, w = (F.get("q", F.lit(k)) for k in range(4))
    px, py, pz = (F.col(a) for a in AXES)
    # p + 2 w (v x p) + 2 v x (v x p)
    cx, cy, cz = y * pz - z * py, z * px - x * pz, x * py - y * px
    moved = (px + 2 * (w * cx + y * cz - z * cy), py + 2 * (w * cy + z * cx - x * cz), pz + 2 * (w * cz + x * cy - y * cx))
    return points.withColumns({a: m + F.get("t", F.lit(k)) for k, (a, m) in enumerate(zip(AXES, moved, strict=True))})


def register(starts: DataFrame, scans: DataFrame, distance: float, steps: int, cut, least: int = 6) -> DataFrame:
    """(graph, i, j, guess, t, q, rmse, matched) after `steps` rounds of closest points, all pairs at once.

    The surroundings of every cell of the scans i are gathered once: they are the same in all rounds, pairs and guesses. A round moves the points of scan j by the pair's pose, finds their nearest points of scan i within `distance`, and turns the pose by the rigid
    motion that the summed moments of each pair give. Pairs with fewer than `least` matches keep their pose. rmse and matched are those after the last round.
    """
    keys = ["graph", "i", "j", "guess"]
    poses = cut(starts.select(*keys, "t", "q"), "starts")
    moving = scans.withColumnRenamed("node", "j")
    fixed = scans.withColumnRenamed("node", "i").join(poses.select("graph", "i").distinct(), ["graph", "i"], "left_semi")
    around = cut(surroundings(fixed, ["graph", "i"], distance), "surroundings")

    def update(batches):
        for p in batches:
            if len(p):
                r, t = rigid(p)
                r0, t0 = turn(_stack(p["q"], 4)), _stack(p["t"], 3)
                enough = (p["n"] >= least).to_numpy()
                new_r, new_t = r @ r0, np.einsum("nab,nb->na", r, t0) + t
                q = np.where(enough[:, None], quaternion(new_r), _stack(p["q"], 4))
                yield p[keys].assign(t=list(np.where(enough[:, None], new_t, t0)), q=list(q))

    for k in range(steps + 1):
        here = _placed(moving.join(poses, ["graph", "j"])).select(*keys, *AXES)
        found = moments(nearest_of(here, around, ["graph", "i"], distance), keys)
        if k == steps:
            return poses.join(found.select(*keys, F.sqrt("d2").alias("rmse"), F.col("n").alias("matched")), keys, "left")
        both = poses.join(found, keys, "left").select(*keys, "t", "q", *_SUMS).fillna(0, _SUMS)
        poses = cut(both.mapInPandas(update, "graph long, i long, j long, guess int, t array<double>, q array<double>"), "registered")
    return poses


def close_loops(candidates: DataFrame, poses: DataFrame, scans: DataFrame, cut, distance: float = 1.0, coarse: float | None = None, steps: tuple[int, int] = (8, 8), most_rmse: float = 0.35, most_shift: float = 5.0, most_turn: float = 45.0, least_overlap: float = 0.2) -> DataFrame:
    """(graph, i, j, t, q, rmse, overlap, shift, turned, reason): each candidate's relative pose, from the path's own guess and from a level one, whichever fits better.

    First with wide correspondences, then with tight ones. `reason` is null for an accepted loop, else the first that holds: 'no overlap', 'rmse',
    'contradicts' (moved or turned too far from the path's guess).
    """
    pairs = candidates.select("graph", "i", "j").distinct()
    guess = cut(relative_poses(pairs, poses), "guesses")
    level = F.array(F.get("t", F.lit(0)), F.get("t", F.lit(1)), F.lit(0.0))
    starts = guess.withColumn("guess", F.lit(0)).unionByName(guess.withColumns({"t": level, "guess": F.lit(1)}))
    wide = register(starts, scans, coarse or max(distance * 6, 6.0), steps[0], cut)
    tight = register(wide, scans, distance, steps[1], cut)
    best = tight.groupBy("graph", "i", "j").agg(F.min(F.struct(F.coalesce("rmse", F.lit(float("inf"))).alias("rmse"), "guess", "t", "q", "matched")).alias("b")).select("graph", "i", "j", "b.*")
    sizes = scans.groupBy("graph", F.col("node").alias("j")).agg(F.count("*").alias("points"))
    both = best.join(guess.select("graph", "i", "j", F.col("t").alias("t0"), F.col("q").alias("q0")), ["graph", "i", "j"]).join(sizes, ["graph", "j"], "left")

    def judge(batches):
        for p in batches:
            if len(p):
                r0, r = turn(_stack(p["q0"], 4)), turn(_stack(p["q"], 4))
                shift = np.linalg.norm(_stack(p["t"], 3) - _stack(p["t0"], 3), axis=1)
                yield p[["graph", "i", "j", "t", "q", "rmse", "matched", "points"]].assign(shift=shift, turned=np.degrees(np.linalg.norm(axis_angle(r0.transpose(0, 2, 1) @ r), axis=1)))

    kinds = "graph long, i long, j long, t array<double>, q array<double>, rmse double, matched double, points double, shift double, turned double"
    out = both.select("graph", "i", "j", "t", "q", "rmse", F.col("matched").cast("double").alias("matched"), F.col("points").cast("double").alias("points"), "t0", "q0").mapInPandas(judge, kinds)
    overlap = F.coalesce(F.col("matched") / F.col("points"), F.lit(0.0))
    reason = F.when(overlap < least_overlap, "no overlap").when(F.col("rmse") > most_rmse, "rmse").when((F.col("shift") > most_shift) | (F.col("turned") > most_turn), "contradicts")
    return out.select("graph", "i", "j", "t", "q", "rmse", overlap.alias("overlap"), "shift", "turned", reason.alias("reason"))
