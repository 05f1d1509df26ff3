"""Openings of image frames: fragments merged across gaps, windows and doors judged by where they stand, frames rewritten.

Pixels are (frame, row, col, segment), segments (frame, segment, class, zone, confidence). `shape` is (rows, columns) of all frames. Everything is joins
and aggregates keyed by the frame, and the regions of a frame, whose pixels its shape bounds, are labelled in one piece. All joins merge: stored pixels compress to few bytes, and a broadcast
of them would be millions of rows in the driver.

Edge cases: pixels of unknown segments belong to no class; segments without pixels vanish; a frame without floor has no gap (-1), so no door in it stands on
the floor; a column's gap is counted from the region's lowest pixel. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The limits that the rules were measured with, in pixels or as shares.
LIMITS = {"dilation": 3, "floor_gap": 120, "wall_height": 0.60, "edge_share": 0.40, "edge_band": 25, "door_width": 40, "area": 1500}
RULES = ("door_metric_dims", "door_window_edge_adjacent", "door_below_min_area", "door_below_min_width", "door_taller_than_glass_wall", "door_not_floor_standing")


@dataclass
class Judged:
    pixels: DataFrame  # frame, row, col, segment: rewritten
    segments: DataFrame  # frame, segment, class, rule, residual, confidence, n_merged, area, box and centre
    regions: DataFrame  # merged candidates with their measures and the rule that fired


def _labels(rows: np.ndarray, cols: np.ndarray, reach: int) -> np.ndarray:
    """Place, among the given pixels, of the first pixel of each one's region: pixels within `reach` whose squares share more than a corner are linked."""
    top, side = rows - rows.min(), cols - cols.min()
    wide = int(side.max()) + 2 * reach + 1  # no move leads into the next row
    cells, first, own = np.unique(top * wide + side, return_index=True, return_inverse=True)
    moves = [a * wide + b for a in range(reach + 1) for b in range(-reach, reach + 1) if (a, b) > (0, 0) and min(a, abs(b)) < reach]
    ends = []
    for m in moves:
        at = np.minimum(np.searchsorted(cells, cells + m), len(cells) - 1)
        hit = np.flatnonzero(cells[at] == cells + m)
        ends.append((hit, at[hit]))
    src, dst = (np.concatenate(e) for e in zip(*ends, strict=True))
    label = np.arange(len(cells))
    while True:
        least = label.copy()
        np.minimum.at(least, label[src], label[dst])
        np.minimum.at(least, label[dst], label[src])
        while (next_ := least[least]).tolist() != least.tolist():
            least = next_
        least = least[label]
        if (least == label).all():
            return first[label[own]]
        label = least


def regions_of(pixels: DataFrame, dilation: int, cut) -> DataFrame:
    """(frame, row, col, segment, region): pixels within a dilation of each other form a region, named by its first pixel; no other pixels are taken in.

    A frame is labelled in one piece: its pixels are bounded by its shape, whatever the number of frames.
    """
    reach = 2 * max(1, dilation) + 1
    known = pixels.select("frame", "row", "col", "segment").where("frame IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL")
    kinds = {f.name: f.dataType for f in known.schema.fields}
    schema = StructType([*known.schema.fields, StructField("__i", kinds["row"]), StructField("__j", kinds["col"])])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        at = _labels(p["row"].to_numpy(np.int64), p["col"].to_numpy(np.int64), reach)
        return p.assign(__i=p["row"].to_numpy()[at], __j=p["col"].to_numpy()[at])

    named = known.groupBy("frame").applyInPandas(run, schema)
    return cut(named.select("frame", "row", "col", "segment", F.struct(F.col("__i").alias("i"), F.col("__j").alias("j")).alias("region")), "regions")


def floor_gaps(regions: DataFrame, floor: DataFrame) -> DataFrame:
    """(frame, region, gap): median over columns of the rows between a region's lowest pixel and the first floor below it, cut to a whole number."""
    low = regions.groupBy("frame", "region", "col").agg(F.max("row").alias("low"))
    below = low.join(floor.select("frame", "col", F.col("row").alias("at")).hint("merge"), ["frame", "col"]).where(F.col("at") > F.col("low"))
    gap = below.groupBy("frame", "region", "col").agg((F.min("at") - F.first("low")).alias("gap"))
    return gap.groupBy("frame", "region").agg(F.floor(F.percentile("gap", 0.5)).cast("int").alias("gap"))


def edge_shares(regions: DataFrame, beside: DataFrame, band: int, columns: int) -> DataFrame:
    """(frame, region, left, right): share of pixels of `beside` in the bands along each row's ends, cut at the frame."""
    ends = regions.groupBy("frame", "region", "row").agg(F.min("col").alias("x0"), F.max("col").alias("x1"))
    room = ends.groupBy("frame", "region").agg(F.sum(F.least("x0", F.lit(band))).alias("room_left"), F.sum(F.least(F.lit(columns) - F.col("x1") - 1, F.lit(band))).alias("room_right"))
    near = ends.join(beside.select("frame", "row", F.col("col").alias("x")).distinct().hint("merge"), ["frame", "row"])
    left, right = (F.col("x") < F.col("x0")) & (F.col("x") >= F.col("x0") - band), (F.col("x") > F.col("x1")) & (F.col("x") <= F.col("x1") + band)
    held = near.groupBy("frame", "region").agg(F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"))
    share = lambda n, room: F.coalesce(F.col(n) / F.greatest(F.col(room), F.lit(1)), F.lit(0.0))
    return room.join(held.hint("merge"), ["frame", "region"], "left").select("frame", "region", share("n_left", "room_left").alias("left"), share("n_right", "room_right").alias("right"))


def measures(regions: DataFrame, floor: DataFrame, rows: int) -> DataFrame:
    """(frame, region, area, height share, width, gap) of each region."""
    by = regions.groupBy("frame", "region").agg(F.count("*").alias("area"), ((F.max("row") - F.min("row") + 1) / F.lit(float(rows))).alias("height"), (F.max("col") - F.min("col") + 1).alias("width"))
    return by.join(floor_gaps(regions, floor).hint("merge"), ["frame", "region"], "left").fillna(-1, ["gap"])


def door_rule(limits: dict) -> F.Column:
    """First rule that turns a door candidate down; a door-sized measurement ('ok') overrules the three that depend on the distance."""
    unless = F.col("verdict") != "ok"
    ladder = [
        (RULES[0], F.col("verdict") == "bad"), (RULES[1], F.greatest("left", "right") > limits["edge_share"]), (RULES[2], unless & (F.col("area") < limits["area"])),
        (RULES[3], unless & (F.col("width") < limits["door_width"])), (RULES[4], unless & (F.col("height") >= limits["wall_height"])), (RULES[5], ~F.col("gap").between(0, limits["floor_gap"])),
    ]
    out = F.lit(None)
    for name, rule in reversed(ladder):
        out = F.when(rule, name).otherwise(out)
    return out


def judge(pixels: DataFrame, segments: DataFrame, shape: tuple[int, int], cut, metric: Callable[[DataFrame], DataFrame] | None = None, filter_windows: bool = False, limits: dict | None = None) -> Judged:
    """Frames with windows merged, doors merged, judged and merged again, and every segment's record brought in line with the pixels.

    `metric` gives (frame, region, verdict 'ok', 'bad' or 'unknown') for door candidates (frame, row, col, region). Segments of a rejected region, and what no
    merged region took in of a segment that another one took in, become 'other'.
    """
    limits = LIMITS | (limits or {})
    known = pixels.join(segments.select("frame", "segment", "class", "zone").hint("merge"), ["frame", "segment"])
    floor = known.where("zone = 'floor'").select("frame", "row", "col")
    of = lambda c: known.where(F.col("class") == c).select("frame", "row", "col", "segment")
    windows = regions_of(of("window"), limits["dilation"], cut)
    judged_w = measures(windows, floor, shape[0]).where(F.col("area") >= limits["area"])
    short = F.lit(filter_windows) & F.col("gap").between(0, limits["floor_gap"]) & (F.col("height") < limits["wall_height"])
    judged_w = cut(judged_w.withColumns({"class": F.lit("window"), "rule": F.when(short, "window_floor_contact_not_glass_wall"), "verdict": F.lit("unknown"), "left": F.lit(0.0), "right": F.lit(0.0)}), "windows")
    # Glass beside a door is glass, whether or not its region was kept.
    glass = windows.join(judged_w.select("frame", "region").hint("merge"), ["frame", "region"], "left_semi")
    doors = regions_of(of("door"), limits["dilation"], cut)
    found = measures(doors, floor, shape[0]).join(edge_shares(doors, glass, limits["edge_band"], shape[1]).hint("merge"), ["frame", "region"])
    verdicts = metric(doors.select("frame", "row", "col", "region")) if metric else None
    found = found.join(verdicts.select("frame", "region", "verdict").hint("merge"), ["frame", "region"], "left").fillna("unknown", ["verdict"]) if verdicts is not None else found.withColumn("verdict", F.lit("unknown"))
    judged_d = cut(found.withColumns({"class": F.lit("door"), "rule": door_rule(limits)}), "doors")
    regions = judged_w.unionByName(judged_d)

    kept_w = windows.join(judged_w.where("rule IS NULL").select("frame", "region").hint("merge"), ["frame", "region"], "left_semi").withColumn("class", F.lit("window"))
    left = doors.join(judged_d.where("rule IS NULL").select("frame", "region").hint("merge"), ["frame", "region"], "left_semi").select("frame", "row", "col", "segment")
    kept_d = regions_of(left, limits["dilation"], cut).withColumn("class", F.lit("door"))
    merged = kept_w.unionByName(kept_d)
    last = segments.groupBy("frame").agg(F.max("segment").alias("last"))
    order = Window.partitionBy("frame").orderBy(F.desc("class"), "region")  # windows first
    names = merged.select("frame", "class", "region").distinct().join(last.hint("merge"), "frame").withColumn("new", F.col("last") + F.row_number().over(order)).drop("last")
    taken = cut(merged.join(names.hint("merge"), ["frame", "class", "region"]).select("frame", "row", "col", "segment", "class", "new"), "taken")
    rewritten = cut(pixels.join(taken.select("frame", "row", "col", "new").hint("merge"), ["frame", "row", "col"], "left").select("frame", "row", "col", F.coalesce("new", "segment").alias("segment"), F.col("segment").alias("was")), "rewritten")

    # Confidence of a merged region: mean over the segments it took in, by their areas.
    area = known.groupBy("frame", "segment").agg(F.count("*").alias("area"))
    parts = taken.select("frame", "class", "new", "segment").distinct().join(area.hint("merge"), ["frame", "segment"]).join(segments.select("frame", "segment", "confidence").hint("merge"), ["frame", "segment"])
    merged_records = parts.groupBy("frame", F.col("new").alias("segment"), "class").agg((F.sum(F.col("confidence") * F.col("area")) / F.sum("area")).alias("confidence"), F.count("*").alias("n_merged"))
    merged_records = merged_records.withColumns({"rule": F.lit(None).cast("string"), "residual": F.lit(False)})
    # The first rule that fired for a segment: windows before doors, then by the region's place.
    rejected = windows.withColumn("class", F.lit("window")).unionByName(doors.withColumn("class", F.lit("door"))).join(regions.where("rule IS NOT NULL").select("frame", "class", "region", "rule").hint("merge"), ["frame", "class", "region"])
    first = rejected.groupBy("frame", "segment").agg(F.min(F.struct((F.col("class") == "door").alias("late"), "region", "rule")).alias("r")).select("frame", "segment", "r.rule")
    absorbed = taken.select("frame", "segment").distinct().withColumn("absorbed", F.lit(True))
    own = segments.join(first.hint("merge"), ["frame", "segment"], "left").join(absorbed.hint("merge"), ["frame", "segment"], "left")
    residual = F.col("rule").isNull() & F.col("absorbed").isNotNull()
    own = own.select("frame", "segment", F.when(F.col("rule").isNotNull() | residual, "other").otherwise(F.col("class")).alias("class"), "confidence", F.lit(1).cast("long").alias("n_merged"), "rule", residual.alias("residual"))
    extent = rewritten.groupBy("frame", "segment").agg(F.count("*").alias("area"), F.min("col").alias("x0"), F.min("row").alias("y0"), (F.max("col") + 1).alias("x1"), (F.max("row") + 1).alias("y1"), F.avg("col").alias("cx"), F.avg("row").alias("cy"))
    records = merged_records.unionByName(own).join(extent.hint("merge"), ["frame", "segment"])
    return Judged(rewritten.drop("was"), records, regions)
