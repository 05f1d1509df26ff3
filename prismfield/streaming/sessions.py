"""Structured Streaming forms of sessions, windows and debounced poses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream with an event-time column; the path may be one file or a folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder).withColumn("event_time", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read what it wrote."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="prismfield-stream-")
    base = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("event_time", late).groupBy("user_id", F.session_window("event_time", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def closed_sessions(spark: SparkSession, path: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that the final watermark has closed; those still open are not emitted."""
    out = run_to_table(session_counts(event_stream(spark, path), gap, late))
    return out.select("user_id", "start", "end", "n", F.round("total", 4).alias("total"))


def rolling_consensus(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour", spread: float = 50.0) -> DataFrame:
    """Sliding-window mean per event type, null where the values spread too far."""
    w = events.withWatermark("event_time", late).groupBy("event_type", F.window("event_time", width, step).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.max("value") - F.min("value")).alias("spread"))
    return w.select("event_type", F.col("w.start").alias("start"), "n", F.when(F.col("spread") <= spread, F.col("m")).alias("consensus"))


def nearest_in_range(spark: SparkSession, path: str, target: str, sample: str, reach: str, late: str = "1 hour") -> DataFrame:
    """Targets with the nearest sample of their user within `reach` on either side, by a stream-stream join.

    The watermarks and the range bound how long either side is held. A target's candidates arrive
    as they come; the nearest of them is taken over the table that the stream wrote.
    """
    one = event_stream(spark, path).where(F.col("event_type") == target).select("user_id", "event_id", F.col("event_time").alias("t")).withWatermark("t", late)
    two = event_stream(spark, path).where(F.col("event_type") == sample).select(F.col("user_id").alias("u"), F.col("event_id").alias("click_id"), F.col("event_time").alias("ct")).withWatermark("ct", late)
    met = one.join(two, F.expr(f"user_id = u AND ct BETWEEN t - INTERVAL {reach} AND t + INTERVAL {reach}"))
    out = run_to_table(met.select("event_id", "click_id", F.unix_micros("t").alias("t"), F.unix_micros("ct").alias("ct")))
    off = F.abs(F.col("ct") - F.col("t"))
    return out.groupBy("event_id").agg(F.min_by("click_id", F.struct(off, "ct")).alias("click_id"), F.min(off).alias("off_us"))


def stream_gaps(spark: SparkSession, path: str, least_us: int) -> DataFrame:
    """(user_id, start_us, end_us) of pauses beyond `least_us`; the state of a user is the last time seen, so rows older than it are passed over."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        times = sorted(int(t) for f in frames for t in f["us"])
        rows = []
        for t in times:
            if last is not None and t - last > least_us:
                rows.append((key[0], last, t))
            last = t if last is None else max(last, t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["user_id", "start_us", "end_us"])

    e = event_stream(spark, path).select("user_id", F.unix_micros("event_time").alias("us"))
    return run_to_table(e.groupBy("user_id").applyInPandasWithState(step, "user_id long, start_us long, end_us long", "last long", "append", GroupStateTimeout.NoTimeout))
