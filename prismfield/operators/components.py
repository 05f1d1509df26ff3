"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every step contracts the graph towards the smallest node id of each component; the number of
rounds is logarithmic in practice and never grows with a component's diameter one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], src: str = "src", dst: str = "dst", most_rounds: int = 60, drop: Callable[[DataFrame], None] | None = None, merge: bool = False) -> DataFrame:
    """(node, component) of every node that has an edge to another one; component is the smallest node.

    `cut(df, label)` materialises a table to end its lineage (a checkpoint or a shared table);
    `drop(df)` is told of each such table that nothing reads any more.
    Nulls and self-loops are ignored; repeated edges count once. With `merge` the
    joins broadcast nothing: stored edges compress so well that a table of few bytes may be millions of rows in the driver.
    """
    a, b = F.col(src), F.col(dst)
    now = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    met = (lambda df: df.hint("merge")) if merge else (lambda df: df)
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(met(least), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(met(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = linked.unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        old, now = now, cut(small, "edges")
        if drop:
            drop(old)
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
