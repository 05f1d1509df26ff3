"""Row filters and row rules of survey tables: masks, clips, samples, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose columns are neither null nor NaN nor infinite."""
    fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in cols]
    return df.where(reduce(Column.__and__, fine))


def in_box(p: tuple, box: tuple, margin: float = 0.0) -> Column:
    """Closed containment of a point in (x0, y0, z0, x1, y1, z1), widened by the margin."""
    return reduce(Column.__and__, [(F.col(c) >= box[i] - margin) & (F.col(c) <= box[i + 3] + margin) for i, c in enumerate(p)])


def box_label(p: tuple, boxes: list[tuple], margin: float = 0.0) -> Column:
    """Number of the last box that holds the point, -1 for none. `boxes` is a short list of the plan's own."""
    out = F.lit(-1)
    for i, box in enumerate(boxes):
        out = F.when(in_box(p, box, margin), i).otherwise(out)
    return out


def every_nth(df: DataFrame, keys: list[str], order: list[str], stride: int) -> DataFrame:
    """Every `stride`-th row of each key in order, from the first one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") - 1) % stride == 0).drop("__n")


def clip_by_percentiles(df: DataFrame, keys: list[str], axes: list[str], low: float) -> DataFrame:
    """Rows inside the [low, 1 - low] quantile of every axis of their key (closed)."""
    q = df.groupBy(*keys).agg(*(F.percentile(a, [low, 1 - low]).alias(f"__{a}") for a in axes))
    out = df.join(q, keys)
    for a in axes:
        out = out.where((F.col(a) >= F.col(f"__{a}")[0]) & (F.col(a) <= F.col(f"__{a}")[1]))
    return out.drop(*(f"__{a}" for a in axes))


def first_true(rules: list[tuple[str, str]], default: str) -> Column:
    """Name of the first rule (name, SQL condition) that holds: a priority chain of exclusive roles."""
    out = F.lit(default)
    for name, rule in reversed(rules):
        out = F.when(F.expr(rule), name).otherwise(out)
    return out
