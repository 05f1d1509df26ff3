"""Time alignment over the event streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismfield.operators import timeline as T
from prismfield.sources import adapters as A

from .registry import query

_V, _C, _P = A.stream_sql("view", "v"), A.stream_sql("click", "c"), A.stream_sql("purchase", "p")
_NEAR = """b AS (SELECT v.id, v.t, max(c.t) AS pt FROM v LEFT JOIN c ON c.t <= v.t GROUP BY v.id, v.t),
n AS (SELECT v.id, min(c.t) AS nt FROM v LEFT JOIN c ON c.t > v.t GROUP BY v.id),
m AS (SELECT b.id, b.t, CASE WHEN nt IS NULL OR b.t - pt <= nt - b.t THEN pt ELSE nt END AS mt FROM b JOIN n USING (id))"""
# Of samples at one time the one with the smallest id counts.
_ASOF = """c1 AS (SELECT t, min(id) AS id, arg_min(value, id) AS value FROM c GROUP BY t),
b AS (SELECT v.id, v.t, c1.t AS pt, c1.id AS pid, c1.value AS pv FROM v ASOF LEFT JOIN c1 ON v.t >= c1.t),
n AS (SELECT v.id, c1.t AS nt, c1.id AS nid, c1.value AS nv FROM v ASOF LEFT JOIN c1 ON v.t < c1.t),
m AS (SELECT b.id, b.t, pt, nt, pv, nv, CASE WHEN nt IS NULL OR b.t - pt <= nt - b.t THEN pid ELSE nid END AS mid, CASE WHEN nt IS NULL OR b.t - pt <= nt - b.t THEN pt ELSE nt END AS mt FROM b JOIN n USING (id))"""


@query(f"WITH {_V}, {_C}, {_ASOF} SELECT id, mid AS match_id, round(mt - t, 3) AS delta_s FROM m")
def asof_nearest_events(spark, sf_dir):
    m = T.asof_nearest(A.stream(spark, sf_dir, "view"), A.stream(spark, sf_dir, "click"), ["id"])
    return m.select("id", F.col("match.id").alias("match_id"), F.round(F.col("match.t") - F.col("t"), 3).alias("delta_s"))


@query(f"WITH {_V}, {_C}, {_ASOF} SELECT id, CASE WHEN abs(mt - t) <= 600 THEN mid END AS match_id FROM m")
def asof_within_tolerance(spark, sf_dir):
    m = T.asof_nearest(A.stream(spark, sf_dir, "view"), A.stream(spark, sf_dir, "click"), ["id"], 600.0)
    return m.select("id", F.col("match.id").alias("match_id"))


@query(f"""WITH {_V}, {_C}, {_ASOF} SELECT id,
  round(CASE WHEN nt IS NULL THEN pv WHEN pt IS NULL THEN nv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)) END, 4) AS interpolated, round(least(abs(t - pt), abs(nt - t)), 3) AS gap FROM m""")
def pose_interpolation(spark, sf_dir):
    out = T.interpolate(A.stream(spark, sf_dir, "view").select("id", "t"), A.stream(spark, sf_dir, "click"), "value", ties=["id"])
    return out.select("id", F.round("interpolated", 4).alias("interpolated"), F.round("gap", 3).alias("gap"))


@query(f"""WITH {_V}, {_C}, {_P}, {_ASOF},
p1 AS (SELECT t, min(id) AS id FROM p GROUP BY t),
b2 AS (SELECT v.id, v.t, p1.t AS pt, p1.id AS pid FROM v ASOF LEFT JOIN p1 ON v.t >= p1.t), n2 AS (SELECT v.id, p1.t AS nt, p1.id AS nid FROM v ASOF LEFT JOIN p1 ON v.t < p1.t),
m2 AS (SELECT b2.id, CASE WHEN nt IS NULL OR b2.t - pt <= nt - b2.t THEN pid ELSE nid END AS mid, CASE WHEN nt IS NULL OR b2.t - pt <= nt - b2.t THEN pt ELSE nt END AS mt FROM b2 JOIN n2 USING (id))
SELECT m.id, m.mid AS image_id, m2.mid AS pose_id, round(m.mt - m.t, 3) AS d_image, round(m2.mt - m.t, 3) AS d_pose,
  concat_ws('+', CASE WHEN abs(m.mt - m.t) > 300 THEN 'image' END, CASE WHEN abs(m2.mt - m.t) > 300 THEN 'pose' END) AS exceeds,
  CASE WHEN abs(m.mt - m.t) > 300 OR abs(m2.mt - m.t) > 300 THEN 'exceeds_max_delta' ELSE 'ok' END AS match_status
FROM m JOIN m2 USING (id)""")
def sync_triplets(spark, sf_dir):
    """Reference frames with their nearest image and pose, deltas and a list of those beyond the limit."""
    v = A.stream(spark, sf_dir, "view").select("id", "t")
    one = T.asof_nearest(v, A.stream(spark, sf_dir, "click"), ["id"]).withColumnRenamed("match", "image")
    two = T.asof_nearest(one, A.stream(spark, sf_dir, "purchase"), ["id"]).withColumnRenamed("match", "pose")
    di, dp = F.col("image.t") - F.col("t"), F.col("pose.t") - F.col("t")
    exceeds = F.concat_ws("+", F.when(F.abs(di) > 300, "image"), F.when(F.abs(dp) > 300, "pose"))
    return two.select("id", F.col("image.id").alias("image_id"), F.col("pose.id").alias("pose_id"), F.round(di, 3).alias("d_image"), F.round(dp, 3).alias("d_pose"), exceeds.alias("exceeds"), F.when(exceeds == "", "ok").otherwise("exceeds_max_delta").alias("match_status"))


_E = "e AS (SELECT event_type, user_id, event_id, epoch_us(ts) / 1e6 AS t, value FROM events)"


def _events(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", (A.epoch_us("ts") / F.lit(1e6)).alias("t"), "value")


@query(f"""WITH {_E}, d AS (SELECT event_type, user_id, t, t - lag(t) OVER (PARTITION BY event_type, user_id ORDER BY t) AS dt FROM e),
s AS (SELECT event_type, user_id, median(dt) AS med FROM d WHERE dt IS NOT NULL GROUP BY event_type, user_id)
SELECT event_type, user_id, round(t - dt, 3) AS start_t, round(t, 3) AS end_t, round(dt, 3) AS dur, (round_even(dt / med, 0) - 1)::BIGINT AS missing
FROM d JOIN s USING (event_type, user_id) WHERE dt > greatest(5 * med, 60)""")
def gap_detection(spark, sf_dir):
    g = T.gaps(_events(spark, sf_dir), ["event_type", "user_id"], 5.0, 60.0)
    return g.select("event_type", "user_id", *(F.round(c, 3).alias(c) for c in ("start_t", "end_t", "dur")), "missing")


def _rate(steps, span):
    """Steps a second as doubles divide: infinite over no time, NaN for no step."""
    return F.when(span != 0, steps / F.nullif(span, F.lit(0.0))).when((span == 0) & (steps > 0), F.lit(float("inf"))).when(span == 0, F.lit(float("nan")))


@query(f"""WITH {_E}, d AS (SELECT event_type, user_id, t, t - lag(t) OVER (PARTITION BY event_type, user_id ORDER BY t) AS dt FROM e)
SELECT event_type, user_id, count(*) AS n, round((count(*) - 1) / (max(t) - min(t)), 9) AS mean_hz, round(median(dt), 6) AS median_dt, round(stddev_pop(dt), 4) AS jitter, round(max(dt), 4) AS max_dt FROM d GROUP BY event_type, user_id""")
def continuity_stats(spark, sf_dir):
    """Rate and steps of each series; samples at one time have an infinite rate, a single one has none (NaN)."""
    w = Window.partitionBy("event_type", "user_id").orderBy("t")
    d = _events(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(w))
    return d.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.round(_rate(F.count("*") - 1, F.max("t") - F.min("t")), 9).alias("mean_hz"), F.round(F.median("dt"), 6).alias("median_dt"), F.round(F.stddev_pop("dt"), 4).alias("jitter"), F.round(F.max("dt"), 4).alias("max_dt"))


@query(f"""WITH {_E}, n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 1800 THEN 1 ELSE 0 END AS nw FROM e),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t) AS session FROM n)
SELECT user_id, session::BIGINT AS session, count(*) AS n, round(max(t) - min(t), 3) AS dur FROM s GROUP BY user_id, session""")
def sessionisation(spark, sf_dir):
    s = T.sessions(_events(spark, sf_dir), "user_id", 1800.0)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("dur"))


@query(f"""WITH {_E}, f AS (SELECT event_type, user_id, event_id, value > 20 AS ok, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - row_number() OVER (PARTITION BY event_type, user_id, value > 20 ORDER BY event_id) AS isl FROM e)
SELECT event_type, user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM f WHERE ok GROUP BY event_type, user_id, isl HAVING count(*) >= 3""")
def runs_of_true(spark, sf_dir):
    return T.runs(_events(spark, sf_dir), ["event_type", "user_id"], "event_id", F.col("value") > 20, 3)


@query(f"""WITH {_E} SELECT event_id, round(quantile_cont(value, 0.9) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 4) AS local_level,
  round(median(value) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS rolling_median FROM e""")
def rolling_percentile(spark, sf_dir):
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    return _events(spark, sf_dir).select("event_id", F.round(F.percentile("value", 0.9).over(w.rowsBetween(-5, 5)), 4).alias("local_level"), F.round(F.percentile("value", 0.5).over(w.rowsBetween(-4, 0)), 4).alias("rolling_median"))


@query(f"""WITH {_E}, j AS (SELECT event_type, user_id, event_id, t, abs(value - lag(value) OVER (PARTITION BY event_type, user_id ORDER BY event_id)) AS jump FROM e),
c AS (SELECT event_type, user_id, min(CASE WHEN jump > 150 THEN event_id END) AS cut FROM j GROUP BY event_type, user_id)
SELECT j.event_type, user_id, count(*) AS kept, max(event_id) AS last_id FROM j JOIN c USING (event_type, user_id) WHERE cut IS NULL OR event_id < cut GROUP BY j.event_type, user_id""")
def divergence_truncation(spark, sf_dir):
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    j = _events(spark, sf_dir).withColumn("jump", F.abs(F.col("value") - F.lag("value").over(w)))
    c = j.groupBy("event_type", "user_id").agg(F.min(F.when(F.col("jump") > 150, F.col("event_id"))).alias("cut"))
    k = j.join(c, ["event_type", "user_id"]).where(F.col("cut").isNull() | (F.col("event_id") < F.col("cut")))
    return k.groupBy("event_type", "user_id").agg(F.count("*").alias("kept"), F.max("event_id").alias("last_id"))


@query(f"""WITH {_E} SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY t) - 1 AS seq, round(t - min(t) OVER (PARTITION BY event_type, user_id), 3) AS elapsed, round(sum(value) OVER (PARTITION BY event_type, user_id ORDER BY t ROWS UNBOUNDED PRECEDING), 4) AS travelled FROM e""")
def topic_sequence_numbers(spark, sf_dir):
    w = Window.partitionBy("event_type", "user_id").orderBy("t")
    return _events(spark, sf_dir).select("event_type", "user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.round(F.col("t") - F.min("t").over(Window.partitionBy("event_type", "user_id")), 3).alias("elapsed"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("travelled"))


@query(f"""WITH {_E}, m AS (SELECT event_type, user_id, median(value) AS med FROM e GROUP BY event_type, user_id), a AS (SELECT event_type, user_id, median(abs(value - med)) AS mad, any_value(med) AS med FROM e JOIN m USING (event_type, user_id) GROUP BY event_type, user_id)
SELECT event_type, user_id, round(med, 6) AS med, round(greatest(mad, 1.0), 6) AS mad, round(med + 4 * greatest(mad, 1.0), 6) AS threshold, (SELECT count(*) FROM e WHERE e.event_type = a.event_type AND e.user_id = a.user_id AND value > a.med + 4 * greatest(a.mad, 1.0)) AS above FROM a""")
def mad_threshold(spark, sf_dir):
    e = _events(spark, sf_dir)
    m = e.groupBy("event_type", "user_id").agg(F.median("value").alias("med"))
    d = e.join(m, ["event_type", "user_id"])
    a = d.groupBy("event_type", "user_id", "med").agg(F.greatest(F.median(F.abs(F.col("value") - F.col("med"))), F.lit(1.0)).alias("mad"))
    t = a.withColumn("threshold", F.col("med") + 4 * F.col("mad"))
    n = e.join(t.select("event_type", "user_id", "threshold"), ["event_type", "user_id"]).groupBy("event_type", "user_id").agg(F.count_if(F.col("value") > F.col("threshold")).alias("above"))
    return t.join(n, ["event_type", "user_id"]).select("event_type", "user_id", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), F.round("threshold", 6).alias("threshold"), "above")


@query(f"""WITH {_E}, s AS (SELECT event_type, user_id, avg(value) AS m, stddev_pop(value) AS d, count(*) AS n FROM e GROUP BY event_type, user_id)
SELECT event_type, user_id, round(avg(CASE WHEN n < 3 OR d < 1e-12 OR abs(value - m) <= 1.0 * d THEN value END), 6) AS trimmed, round(any_value(m), 6) AS plain FROM e JOIN s USING (event_type, user_id) GROUP BY event_type, user_id""")
def trimmed_mean(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = e.groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"), F.count("*").alias("n"))
    keep = (F.col("n") < 3) | (F.col("d") < 1e-12) | (F.abs(F.col("value") - F.col("m")) <= F.col("d"))
    return e.join(s, ["event_type", "user_id"]).groupBy("event_type", "user_id").agg(F.round(F.avg(F.when(keep, F.col("value"))), 6).alias("trimmed"), F.round(F.first("m"), 6).alias("plain"))
