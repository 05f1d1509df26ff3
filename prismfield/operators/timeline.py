"""Time alignment and ordered sequences: as-of joins, interpolation, gaps, sessions, runs.

Every window is partitioned: by the caller's keys, or by time buckets whose edges are joined
from the neighbouring buckets, so that no single task sees a whole stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edges(samples: DataFrame, width: float, fields: list[str]) -> DataFrame:
    """First and last sample of each bucket, of those at one time the one with the smallest fields: small, one row per bucket."""
    by = samples.withColumn("b", F.floor(F.col("t") / width)).groupBy("b").agg(F.min(F.struct("t", *fields)).alias("lo"), F.min(F.struct((-F.col("t")).alias("back"), *fields)).alias("hi"))
    return by.select("b", "lo", F.struct((-F.col("hi.back")).alias("t"), *(F.col("hi")[f].alias(f) for f in fields)).alias("hi"))


def bucket_width(samples: DataFrame, per_bucket: int = 100_000) -> float:
    """Seconds of a bucket that holds about `per_bucket` samples at the stream's mean rate."""
    r = samples.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("t").alias("n")).first()
    if not r["n"] or r["hi"] <= r["lo"]:
        return 1.0
    return (r["hi"] - r["lo"]) / max(1.0, r["n"] / per_bucket) * 1.000001


def bracket(targets: DataFrame, samples: DataFrame, fields: list[str], width: float | None = None) -> DataFrame:
    """Targets (any columns, `t`) with `prev` and `next`: the samples at or before, and after, each target. Of samples at one time it is the one with the smallest fields.

    Rows are bucketed by time (by the samples' rate where no width is given). Inside a bucket two
    running windows, one in each direction, find the neighbours; where a bucket has none on one
    side, the nearest edge of another bucket fills in. The table of edges has a row per bucket
    and is ordered in one task, which the width keeps small.
    """
    s = samples.where("t IS NOT NULL").select("t", *fields)
    width = width or bucket_width(s)
    tagged = s.select(F.floor(F.col("t") / width).alias("b"), "t", F.lit(0).alias("side"), F.struct("t", *fields).alias("s"), F.lit(None).alias("row"))
    t = targets.select(F.floor(F.col("t") / width).alias("b"), "t", F.lit(1).alias("side"), F.lit(None).cast(tagged.schema["s"].dataType).alias("s"), F.struct("*").alias("row"))
    both = tagged.withColumn("row", F.lit(None).cast(t.schema["row"].dataType)).unionByName(t)
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    back = F.last("s", True).over(so_far(Window.partitionBy("b").orderBy("t", "side", F.desc("s"))))
    ahead = F.last("s", True).over(so_far(Window.partitionBy("b").orderBy(F.desc("t"), F.desc("side"), F.desc("s"))))
    both = both.withColumn("prev", back).withColumn("next", ahead).where("side = 1")
    edges = _edges(s, width, fields)
    none = F.lit(None).cast(edges.schema["lo"].dataType)
    all_b = edges.unionByName(t.select("b").distinct().join(edges, "b", "left_anti").select("b", none.alias("lo"), none.alias("hi")))
    before = F.last("hi", True).over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("lo", True).over(Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1))
    found = both.join(all_b.select("b", before.alias("before"), after.alias("after")), "b", "left")
    return found.select("row.*", F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))


def asof_nearest(targets: DataFrame, samples: DataFrame, fields: list[str], tolerance: float | None = None, width: float | None = None) -> DataFrame:
    """Targets with `match`, the sample nearest in time; of equally near ones the earlier, of those at one time the one with the smallest fields. Null beyond the tolerance."""
    b = bracket(targets, samples, fields, width)
    back, ahead = F.col("t") - F.col("prev.t"), F.col("next.t") - F.col("t")
    match = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    out = b.withColumn("match", match).drop("prev", "next")
    if tolerance is not None:
        out = out.withColumn("match", F.when(F.abs(F.col("match.t") - F.col("t")) <= tolerance, F.col("match")))
    return out


def interpolate(targets: DataFrame, samples: DataFrame, field: str, width: float | None = None, ties: list[str] | None = None) -> DataFrame:
    """Targets with the linear interpolation of a field, held at both ends, and the gap to the nearest sample. Of samples at one time the one with the smallest `ties` counts, then the smallest field."""
    b = bracket(targets, samples, [*(ties or []), field], width)
    p, n = F.col("prev"), F.col("next")
    share = F.try_divide(F.col("t") - p["t"], n["t"] - p["t"])
    value = F.when(n.isNull(), p[field]).when(p.isNull(), n[field]).otherwise(p[field] + (n[field] - p[field]) * share)
    gap = F.least(F.abs(F.col("t") - p["t"]), F.abs(n["t"] - F.col("t")))
    return b.select("*", value.alias("interpolated"), gap.alias("gap")).drop("prev", "next")


def gaps(df: DataFrame, keys: list[str], multiple: float, least: float) -> DataFrame:
    """Gaps of each key's series: dt above max(multiple * median dt, least), with the number of missing samples."""
    dt = df.withColumn("dt", F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))).where("dt IS NOT NULL")
    stats = dt.groupBy(*keys).agg(F.median("dt").alias("med"))
    wide = dt.join(stats, keys).where(F.col("dt") > F.greatest(multiple * F.col("med"), F.lit(least)))
    return wide.select(*keys, (F.col("t") - F.col("dt")).alias("start_t"), F.col("t").alias("end_t"), F.col("dt").alias("dur"), (F.rint(F.col("dt") / F.col("med")) - 1).cast("long").alias("missing"))


def sessions(df: DataFrame, key: str, gap: float) -> DataFrame:
    """Rows with a session number per key: a new one when more than `gap` passed."""
    w = Window.partitionBy(key).orderBy("t")
    new = F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def runs(df: DataFrame, keys: list[str], order: str, flag: Column, least: int = 1) -> DataFrame:
    """Runs of consecutive rows with a true flag: first, last and length; shorter ones than `least` vanish."""
    w = Window.partitionBy(*keys).orderBy(order)
    f = df.withColumn("__f", flag).withColumn("__n", F.row_number().over(w))
    island = F.col("__n") - F.row_number().over(Window.partitionBy(*keys, "__f").orderBy(order))
    return f.withColumn("__i", island).where("__f").groupBy(*keys, "__i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("__i")
