"""Exact quantiles of large groups: no task holds the values of a group.

Equal values become counts first, counts become at most BINS bins a group, and only the bins that hold a wanted rank are looked into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def spread_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column for each of `shares`): quantiles interpolated between the two neighbours of the rank, as SQL's continuous percentile.

    Null and NaN values count as absent; a group of nothing else gives no row. Null keys make a group of their own. The values of a bin are one window's: sorted,
    with spilling, and never held.
    """
    kept = [f"__k{i}" for i in range(len(keys))]
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*(F.struct(F.col(k).alias("v")).alias(a) for k, a in zip(keys, kept, strict=True)), F.col(value).cast("double").alias("__v"))
    counts = d.groupBy(*kept, "__v").agg(F.count("*").alias("__n"))
    ends = counts.groupBy(*kept).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"))
    at = F.coalesce(F.floor(F.try_divide(F.col("__v") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * (BINS - 1)), F.lit(0).cast("long"))
    placed = (counts.join(ends, kept) if kept else counts.crossJoin(ends)).withColumn("__b", at)
    bins = placed.groupBy(*kept, "__b").agg(F.sum("__n").alias("__n"), F.first("__all").alias("__all"))
    before = F.sum("__n").over(Window.partitionBy(*kept).orderBy("__b")) - F.col("__n")
    bins = bins.withColumn("__before", before)
    ranks = [(name, end, (F.floor if end == 0 else F.ceil)(F.lit(share) * (F.col("__all") - 1)).cast("long")) for name, share in shares.items() for end in (0, 1)]
    holds = lambda r, a, n: (r >= a) & (r < a + n)
    wanted = None
    for _, _, r in ranks:
        one = holds(r, F.col("__before"), F.col("__n"))
        wanted = one if wanted is None else wanted | one
    chosen = bins.where(wanted).select(*kept, "__b", "__before")
    inside = placed.join(chosen, [*kept, "__b"])
    first = F.col("__before") + F.sum("__n").over(Window.partitionBy(*kept, "__b").orderBy("__v")) - F.col("__n")
    inside = inside.withColumn("__first", first)
    picked = inside.groupBy(*kept).agg(F.first("__all").alias("__all"), *(F.max(F.when(holds(r, F.col("__first"), F.col("__n")), F.col("__v"))).alias(f"__{name}_{end}") for name, end, r in ranks))
    out = []
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("__all") - 1)
        low, high = F.col(f"__{name}_0"), F.col(f"__{name}_1")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return picked.select(*(F.col(a)["v"].alias(k) for k, a in zip(keys, kept, strict=True)), *out)
