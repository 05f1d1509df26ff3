"""Voxels, octrees, range, radius and neighbour joins over bucketed cells."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def cell(c: str | Column, size: float, origin: float = 0.0) -> Column:
    return F.floor(((F.col(c) if isinstance(c, str) else c) - origin) / size).cast("bigint")


def voxelize(points: DataFrame, size: float, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Points with cell numbers i, j, k of a uniform grid."""
    if size <= 0:
        raise ValueError("voxel size must be positive")
    return points.withColumns({n: cell(a, size, o) for n, a, o in zip("ijk", AXES, origin, strict=True)})


def centre(index: str, size: float, origin: float = 0.0) -> Column:
    return (F.col(index) + 0.5) * size + origin


def bounds(points: DataFrame) -> DataFrame:
    """One row: the corner and the largest extent of the cloud."""
    b = points.agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    return b.select("lo_x", "lo_y", "lo_z", F.greatest(*(F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES)).alias("extent"))


def octree_cells(points: DataFrame, depth: int) -> DataFrame:
    """Points with their cell of the cube lattice of 2**depth cells a side; the far face belongs to the last cell."""
    n = 1 << depth
    b = points.crossJoin(F.broadcast(bounds(points)))  # the bounds are one row
    at = lambda a: F.least(F.greatest(F.floor((F.col(a) - F.col(f"lo_{a}")) / F.col("extent") * n), F.lit(0)), F.lit(n - 1)).cast("bigint")
    return b.withColumns({i: at(a) for i, a in zip("ijk", AXES, strict=True)}).drop("lo_x", "lo_y", "lo_z", "extent")


def octree_levels(points: DataFrame, depth: int) -> DataFrame:
    """Occupied nodes of every level 0..depth, from the distinct leaves."""
    leaves = octree_cells(points, depth).select("i", "j", "k").distinct()
    level = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    shift = F.pow(F.lit(2.0), F.lit(depth) - F.col("level"))
    return level.select("level", *(F.floor(F.col(c) / shift).cast("bigint").alias(c) for c in "ijk")).distinct().groupBy("level").agg(F.count("*").alias("nodes"))


def majority(points: DataFrame, keys: list[str], label: str, weight: Column | None = None) -> DataFrame:
    """Label of largest weight per key (the smallest label of equals), its weight and the total."""
    votes = points.groupBy(*keys, label).agg(F.sum(weight if weight is not None else F.lit(1)).alias("w"))
    # Sums of doubles depend on their order: equal votes are equal to nine digits.
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.round("w", 9)).alias("n"), F.col(label))).alias("b"), F.max("w").alias("weight"), F.sum("w").alias("total"), F.count("*").alias("labels"))
    return best.select(*keys, F.col(f"b.{label}").alias(label), "weight", "total", "labels")


def range_join(left: DataFrame, boxes: DataFrame, axes: list[str], pads: list[float], sizes: list[float]) -> DataFrame:
    """Rows of `left` with every box (lo_<axis>, hi_<axis>) whose padded closed range holds them.

    Boxes are spread over the cells, of a size per axis, that they cover; an equi-join on the
    cell and a residual test replace the nested loop; it merges, as boxes of few bytes become many rows
    once they are spread. The result is not exclusive.
    """
    cells = [f"__{a}" for a in axes]
    spread = boxes
    for a, pad, size, c in zip(axes, pads, sizes, cells, strict=True):
        spread = spread.withColumn(c, F.explode(F.sequence(cell(F.col(f"lo_{a}") - pad, size), cell(F.col(f"hi_{a}") + pad, size))))
        left = left.withColumn(c, cell(a, size))
    near = left.join(spread.hint("merge"), cells).drop(*cells)
    for axis, p in zip(axes, pads, strict=True):
        near = near.where((F.col(axis) >= F.col(f"lo_{axis}") - p) & (F.col(axis) <= F.col(f"hi_{axis}") + p))
    return near


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, axes=AXES, copied: str | None = None) -> DataFrame:
    """Pairs (structs `a`, `b`, distance `d`) within the radius: cells of that size, rows of the smaller side (by count, or the one named by `copied`) copied to all neighbours.

    The cells are sorted and merged rather than broadcast: candidates of a cell are many, and a shuffle by
    cell spreads them over tasks however few files the other side has; it spills, and AQE splits hot cells.
    """
    names = [f"__{a}" for a in axes]
    copied = copied or ("b" if right.count() <= left.count() else "a")
    sides = {}
    for name, df in (("a", left), ("b", right)):
        side = df.select(F.struct("*").alias(name), *(cell(F.col(a), radius).alias(n) for a, n in zip(axes, names, strict=True)))
        for n in names if name == copied else ():
            side = side.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
        sides[name] = side.hint("merge") if name == copied else side
    d2 = sum(((F.col(f"a.{x}") - F.col(f"b.{x}")) * (F.col(f"a.{x}") - F.col(f"b.{x}")) for x in axes), F.lit(0.0))
    return sides["a"].join(sides["b"], names).select("a", "b", F.sqrt(d2).alias("d")).where(F.col("d") <= radius)


def radius_places(left: DataFrame, right: DataFrame, radius: float, axes=AXES) -> DataFrame:
    """Pairs (structs `a`, `b`, distance `d`) of distinct places within the radius; `a.n` and `b.n` count the rows at a place.

    Rows at one place have the same partners: what is counted or averaged over pairs comes from places, whose number repeated rows leave alone.
    """
    copied = "b" if right.count() <= left.count() else "a"
    at = lambda df: df.groupBy(*axes).agg(F.count("*").alias("n"))
    return radius_pairs(at(left), at(right), radius, axes, copied)


def neighbour_edges(cells: DataFrame, key: str = "id", axes=("i", "j"), reach: int = 1) -> DataFrame:
    """Edges between occupied cells within Chebyshev distance `reach`."""
    near = cells.select(F.col(key).alias("src"), *axes)
    for a in axes:
        near = near.withColumn(a, F.explode(F.sequence(F.col(a) - reach, F.col(a) + reach)))
    return near.join(cells.select(F.col(key).alias("dst"), *axes), list(axes)).where("src < dst").select("src", "dst")


def first_per_cell(points: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of smallest order in each cell, by one aggregation."""
    first = points.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("p"))
    return first.select(*keys, "p.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _fill(p: pd.DataFrame, most_rings: int | None) -> pd.DataFrame:
    """Rings of one block from its tiles (kind 0), its edges (1) and what tiles of other blocks told it (2)."""
    tile = p[p["kind"] == 0].sort_values("a").drop_duplicates("a")
    ids = tile["a"].to_numpy(np.int64)
    ring, value = tile["ring"].fillna(-1).to_numpy(np.int64), tile["value"].to_numpy(np.float64).copy()

    def place(x):
        at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
        return at, ids[at] == x

    edge = p[p["kind"] == 1].sort_values(["a", "b"])
    (src, known), (dst, also) = place(edge["a"].to_numpy(np.int64)), place(edge["b"].to_numpy(np.int64))
    src, dst = src[known & also], dst[known & also]
    first = np.searchsorted(src, np.arange(len(ids) + 1))
    told = p[p["kind"] == 2].sort_values(["ring", "b", "a"])
    to, known = place(told["b"].to_numpy(np.int64))
    to, told_ring, told_value = to[known], told["ring"].to_numpy(np.int64)[known], told["value"].to_numpy(np.float64)[known]
    last, r = np.flatnonzero(ring == 0), 0
    total, n = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    while not most_rings or r < most_rings:
        k = np.searchsorted(told_ring, r)
        if not len(last):  # nothing of its own goes on: to the next ring that was told
            if k == len(told_ring):
                break
            r = int(told_ring[k])
            if most_rings and r >= most_rings:
                break
        size = first[last + 1] - first[last]
        way = np.repeat(first[last + 1] - np.cumsum(size), size) + np.arange(size.sum())
        m = slice(k, np.searchsorted(told_ring, r, "right"))
        onto, what = np.concatenate([dst[way], to[m]]), np.concatenate([value[src[way]], told_value[m]])
        free = ring[onto] < 0
        onto, what = onto[free], what[free]
        np.add.at(total, onto, what)
        np.add.at(n, onto, 1)
        r, last = r + 1, np.unique(onto)
        ring[last], value[last] = r, total[last] / n[last]
    done = np.flatnonzero(ring >= 0)
    return pd.DataFrame({"block": p["block"].iloc[0], "id": ids[done], "value": value[done], "ring": ring[done]})


def ring_fill(tiles: DataFrame, edges: DataFrame, cut, most_rings: int | None = None, per_block: int = 200_000) -> DataFrame:
    """Values of tiles without one, ring by ring: the mean of the neighbours settled in earlier rings.

    `tiles` has id (whole numbers) and value (null: open), `edges` both directions. Ends when a ring settles none;
    with `most_rings` (None or 0: no limit) tiles beyond that ring stay open on purpose.

    Ids are cut in ranges of about `per_block` tiles. A task settles all rings of a range from its own tiles and from what
    other ranges told it; ranges that are told something new are settled again, until nothing is new. So the number of
    jobs goes by the ranges that a path of rings crosses, not by the rings.
    """
    tiles = cut(tiles.select("id", "value"), "tiles")
    span = tiles.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n")).first()
    width = max(1, -(-(span["hi"] - span["lo"] + 1) // max(1, -(-span["n"] // per_block)))) if span["n"] else 1
    block = lambda c: F.floor((F.col(c) - F.lit(span["lo"] or 0)) / F.lit(width)).cast("long")
    row = lambda b, kind, a, to, value, ring: [b.alias("block"), F.lit(kind).alias("kind"), a.cast("long").alias("a"), to.cast("long").alias("b"), value.cast("double").alias("value"), ring.cast("long").alias("ring")]
    none = F.lit(None)
    both = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", block("src").alias("from"), block("dst").alias("block"))
    own = tiles.where("id IS NOT NULL").select(*row(block("id"), 0, F.col("id"), none, F.col("value"), F.when(F.col("value").isNotNull(), 0)))
    inner = both.where(F.col("from") == F.col("block")).select(*row(F.col("block"), 1, F.col("src"), F.col("dst"), none, none))
    fixed = cut(own.unionByName(inner).repartition("block").sortWithinPartitions("block"), "blocks")
    cross = cut(both.where(F.col("from") != F.col("block")).select("src", "dst", "block"), "crossings")
    found, latest, told, active, turn = [], {}, None, None, 0
    while active is None or active:
        work = fixed if active is None else fixed.where(F.col("block").isin(active))
        if told is not None:
            now = told.where(F.col("block").isin(active)).groupBy("block", "src", "dst").agg(F.max_by(F.struct("value", "ring"), "turn").alias("m"))
            work = work.unionByName(now.select(*row(F.col("block"), 2, F.col("src"), F.col("dst"), F.col("m.value"), F.col("m.ring"))))
        out = cut(work.groupBy("block").applyInPandas(lambda p: _fill(p, most_rings), "block long, id long, value double, ring long"), "settled")
        found.append(out)
        latest |= dict.fromkeys([r[0] for r in out.select("block").distinct().collect()] if active is None else active, turn)
        said = cross.join(out.select(F.col("id").alias("src"), "value", "ring").hint("merge"), "src")
        if told is not None:
            said = said.join(told.select("src", "dst", "value", "ring").hint("merge"), ["src", "dst", "value", "ring"], "left_anti")
        turn += 1
        said = cut(said.select("block", "src", "dst", "value", "ring", F.lit(turn).alias("turn")), "told")
        active = [r[0] for r in said.select("block").distinct().collect()]
        told = said if told is None else told.unionByName(said)
        if turn % 16 == 0:
            told = cut(told, "told")
    parts = [f.where(F.col("block").isin(b)) for k, f in enumerate(found) if (b := [x for x, t in latest.items() if t == k])]
    done = functools.reduce(DataFrame.unionByName, parts or found)
    return tiles.select("id").join(done.select("id", "value", F.col("ring").cast("int").alias("ring")).hint("merge"), "id", "left").select("id", "value", "ring")
