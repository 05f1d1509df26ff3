"""Dominance counting by CDQ divide and conquer on slot ranks.

A point (slot, level) is above another if its slot is not larger and its level is strictly larger.
Points are ordered by slot, those of one slot by falling level; then whatever is above a point stands
before it, and whatever stands before it and has a larger level is above it. The order is cut into leaves
of about equal size (range partitions), whose numbers are the ranks that the recursion halves:

- a leaf counts within itself, in one task of bounded size;
- each recursion level above pairs neighbouring nodes. Rows are shuffled by node, sorted by level, and a
  running sum over the left half's weights is added to the right half's rows. One shuffle a recursion level.

A node near the root holds all rows, so a node is cut once more into blocks of levels (quantiles of the
whole table, a fixed number of them): a task gets one block of one node, and the weight of the node's
higher blocks comes in as one row more. Equal points are one row from the start, whatever their number.

Defined edge cases
- null slot or level (also of a total that is infinite, not a number or beyond 9e16): above none, counts null.
- repeated rows, and rows that share a sale_id, count each; a null sale_id stands for one row.
- ties in level or in slot and level: not above each other. An empty table gives no rows.
- further columns are left alone, whatever their names. There are no texts here, so none can be long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffles_dropped

SCHEMA = "slot long, level long, n_sales long, n_rows long, leaf long, block long, above_sales long, above_rows long"


def slot_of(sales: DataFrame, col: str = "sold_at") -> Column:
    """Hours since 1970 in UTC, whatever the session's zone."""
    if dict(sales.dtypes)[col] == "timestamp":
        return F.floor(F.unix_micros(col) / F.lit(3_600_000_000))
    # A time stamp without a zone: its date and its hour depend on no zone.
    at = F.col(col).cast("timestamp_ntz")
    return F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(at)


def level_of(total: Column) -> Column:
    fits = ~F.isnan(total) & (F.abs(total) < F.lit(9e16))
    return F.when(fits, F.floor(F.floor(F.lit(100.0) * total + F.lit(0.5)).cast("double") / F.lit(100.0)))


def rows_of(sale_id: Column) -> Column:
    """1 + (crc32 of the decimal digits mod 2)."""
    return F.lit(1).cast("long") + F.coalesce(F.crc32(sale_id.cast("string").cast("binary")) % 2, F.lit(0).cast("long"))


def count_before(level: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each place the sum of every weight over the places before it with a larger level: halves are merged by level, bottom up."""
    n = len(level)
    out = [np.zeros(n, np.int64) for _ in weights]
    if n < 2:
        return out
    _, rank = np.unique(-level, return_inverse=True)  # 0: the largest level
    place, width = np.arange(n), 2 * (int(rank.max()) + 1)
    for half in range((n - 1).bit_length()):
        node, left = place >> (half + 1), (place >> half & 1) == 0
        order = np.argsort(node * width + 2 * rank + left)  # at the same level the right half comes first
        right = order[~left[order]]
        at = np.flatnonzero(~left[order])
        first = node[right] << (half + 1)  # rows before a node: as many as its first place
        for total, w in zip(out, weights, strict=True):
            run = np.concatenate([[0], np.cumsum(np.where(left[order], w[order], 0))])
            total[right] += run[at] - run[first]
    return out


def _leaves(bounds: np.ndarray):
    def run(batches):
        parts = [[b.column(i).to_numpy() for i in range(5)] for b in batches]
        if not parts:
            return
        slot, level, n_sales, n_rows, leaf = (np.concatenate(c) for c in zip(*parts, strict=True))
        above = count_before(level, [n_sales, n_rows])
        block = np.searchsorted(bounds, level, side="left")
        columns = [slot, level, n_sales, n_rows, leaf, block, *above]
        for a in range(0, len(slot), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 10_000].astype(np.int64)) for c in columns], ["slot", "level", "n_sales", "n_rows", "leaf", "block", "above_sales", "above_rows"])

    return run


def count_above(points: DataFrame, rows_per_leaf: int = 250_000, blocks: int = 512) -> DataFrame:
    """Adds above_sales and above_rows, sums of n_sales and n_rows over the points above, to points (slot, level, n_sales, n_rows) without repeats or nulls.

    `blocks` bounds what goes to the driver and what a node's sums are taken over, `rows_per_leaf` what a leaf holds.
    """
    spark = points.sparkSession
    points = materialize(points.select("slot", "level", "n_sales", "n_rows"), "points")
    n = points.count()
    bounds = points.agg(F.percentile_approx("level", [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []
    leaves = max(2 * spark.sparkContext.defaultParallelism, -(-n // rows_per_leaf))
    order = ["slot", F.desc("level")]
    ranged = points.repartitionByRange(leaves, *order).sortWithinPartitions(*order).withColumn("leaf", F.spark_partition_id().cast("long"))
    rows = materialize(ranged.mapInArrow(_leaves(np.unique(np.array(bounds, np.int64))), SCHEMA), "leaves")
    discard(points)
    # Sums of all nodes' blocks come from those of the leaves.
    cells = materialize(rows.groupBy("leaf", "block").agg(F.sum("n_sales").alias("n_sales"), F.sum("n_rows").alias("n_rows")), "cells")
    last = rows.agg(F.max("leaf")).first()[0] or 0
    for half in range(int(last).bit_length()):
        node, right = F.shiftright("leaf", half + 1), F.shiftright("leaf", half).bitwiseAND(F.lit(1)) == 1
        left_sum = lambda c, right=right: F.sum(F.when(~right, F.col(c)).otherwise(0))
        by_block = cells.groupBy(node.alias("node"), "block").agg(left_sum("n_sales").alias("n_sales"), left_sum("n_rows").alias("n_rows"))
        higher = Window.partitionBy("node").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        heads = by_block.select("node", "block", F.sum("n_sales").over(higher).alias("n_sales"), F.sum("n_rows").over(higher).alias("n_rows")).where("n_rows > 0")
        both = rows.withColumns({"node": node, "right": right}).unionByName(heads.withColumn("right", F.lit(False)), allowMissingColumns=True)
        # A row without a level, for the higher blocks, comes first; at the same level the right half does.
        falling = Window.partitionBy("node", "block").orderBy(F.desc_nulls_first("level"), F.desc("right")).rowsBetween(Window.unboundedPreceding, 0)
        run = {c: F.coalesce(F.sum(F.when(~F.col("right"), F.col(c))).over(falling), F.lit(0)) for c in ("n_sales", "n_rows")}
        added = both.select("*", run["n_sales"].alias("add_sales"), run["n_rows"].alias("add_rows")).where(F.col("level").isNotNull())
        gain = lambda c: (F.col(f"above_{c}") + F.when(F.col("right"), F.col(f"add_{c}")).otherwise(0)).alias(f"above_{c}")
        merged = materialize(added.select("slot", "level", "n_sales", "n_rows", "leaf", "block", gain("sales"), gain("rows")), f"merged{half}")
        discard(rows)
        rows = merged
    discard(cells)
    return rows.select("slot", "level", "n_sales", "n_rows", "above_sales", "above_rows")


def dominance(sales: DataFrame, heavy_share: int = 256, rows_per_leaf: int = 250_000, blocks: int = 512) -> DataFrame:
    """sale_id, slot, level, n_sales, n_rows of every row of sales (sale_id, sold_at, total).

    Pairs (slot, level) that hold more than one in `heavy_share` of all rows are less than so many: they are broadcast, and their
    rows stay where they are. All other rows meet their pair in a shuffle in which no key holds more than that share.
    """
    src = sales.select("sale_id", slot_of(sales).alias("slot"), level_of(F.col("total").cast("double")).alias("level"))
    whole = F.col("slot").isNotNull() & F.col("level").isNotNull()
    with shuffles_dropped(sales.sparkSession):
        pairs = src.where(whole).groupBy("slot", "level").agg(F.count("*").alias("n_sales"), F.sum(rows_of(F.col("sale_id"))).alias("n_rows"))
        found = count_above(pairs, rows_per_leaf, blocks)
        total = found.agg(F.sum("n_sales")).first()[0] or 0
    is_heavy = F.col("n_sales") * heavy_share > F.lit(total)
    part = lambda d: d.select(F.col("slot").alias("s"), F.col("level").alias("l"), "above_sales", "above_rows")
    met = (F.col("slot") == F.col("s")) & (F.col("level") == F.col("l"))
    tagged = src.join(F.broadcast(part(found.where(is_heavy))), met, "left")
    out = lambda d: d.select("sale_id", "slot", "level", F.col("above_sales").alias("n_sales"), F.col("above_rows").alias("n_rows"))
    stay = out(tagged.where(~whole | F.col("s").isNotNull()))
    move = tagged.where(whole & F.col("s").isNull()).select("sale_id", "slot", "level")
    return stay.unionByName(out(move.join(part(found.where(~is_heavy)), met)))
