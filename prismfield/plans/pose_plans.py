"""Ordered series and poses: runs, windows, interpolation, re-integration, clocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismfield.functions import geometry as G
from prismfield.operators import timeline as T
from prismfield.sources import adapters as A

from .registry import query

_E = "e AS (SELECT event_type, user_id, event_id, epoch_us(ts) / 1e6 AS t, value FROM events)"
_W = "(PARTITION BY user_id ORDER BY t, event_id)"


def _events(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", (A.epoch_us("ts") / F.lit(1e6)).alias("t"), "value")


def _path():
    return Window.partitionBy("user_id").orderBy("t", "event_id")


@query(f"""WITH {_E}, f AS (SELECT *, value > 40 AS moving, row_number() OVER {_W} AS n FROM e), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, moving ORDER BY t, event_id) AS isl FROM f),
r AS (SELECT user_id, moving, isl, count(*) AS len, min(n) AS a FROM g GROUP BY ALL), h AS (SELECT g.user_id, g.n, g.t, g.event_id, NOT (r.moving AND r.len >= 2) AS still FROM g JOIN r ON g.user_id = r.user_id AND g.moving = r.moving AND g.isl = r.isl),
k AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, still ORDER BY n) AS isl FROM h) SELECT user_id, min(n) AS first_n, max(n) AS last_n, count(*) AS length FROM k WHERE still GROUP BY user_id, isl HAVING count(*) >= 3""")
def debounced_poses(spark, sf_dir):
    """Moving runs that last are transitions, shorter ones are noise; what lies between is a pose if it lasts."""
    e = _events(spark, sf_dir).withColumn("n", F.row_number().over(_path())).withColumn("moving", F.col("value") > 40)
    e = e.withColumn("isl", F.col("n") - F.row_number().over(Window.partitionBy("user_id", "moving").orderBy("n")))
    e = e.withColumn("len", F.count("*").over(Window.partitionBy("user_id", "moving", "isl")))
    return T.runs(e, ["user_id"], "n", ~(F.col("moving") & (F.col("len") >= 2)), 3).select("user_id", F.col("first").cast("long").alias("first_n"), F.col("last").cast("long").alias("last_n"), "length")


@query(f"""WITH {_E}, j AS (SELECT *, abs(value - lag(value) OVER {_W}) AS jump, abs(value - lag(value) OVER {_W}) / nullif(t - lag(t) OVER {_W}, 0) AS speed, t - first_value(t) OVER {_W} AS elapsed FROM e), c AS (SELECT user_id, min(elapsed) FILTER (jump > 300 OR speed > 0.05) AS cut FROM j GROUP BY user_id)
SELECT user_id, count(*) AS kept, round(max(elapsed), 3) AS until, count(*) FILTER (elapsed BETWEEN 86400 AND 864000) AS window_rows FROM j JOIN c USING (user_id) WHERE cut IS NULL OR elapsed < cut GROUP BY user_id""")
def speed_and_jump_truncation(spark, sf_dir):
    """A path is kept up to its first impossible speed or jump; a window of elapsed time is cut out of it."""
    d = F.abs(F.col("value") - F.lag("value").over(_path()))
    j = _events(spark, sf_dir).withColumn("jump", d).withColumn("speed", F.try_divide(F.col("jump"), F.col("t") - F.lag("t").over(_path()))).withColumn("elapsed", F.col("t") - F.first("t").over(_path()))
    c = j.groupBy("user_id").agg(F.min(F.when((F.col("jump") > 300) | (F.col("speed") > 0.05), F.col("elapsed"))).alias("cut"))
    k = j.join(c, "user_id").where("cut IS NULL OR elapsed < cut")
    return k.groupBy("user_id").agg(F.count("*").alias("kept"), F.round(F.max("elapsed"), 3).alias("until"), F.expr("count_if(elapsed BETWEEN 86400 AND 864000)").alias("window_rows"))


@query(f"""WITH {_E}, h AS (SELECT user_id, least(29, floor((t - 1704067200) / 86400))::BIGINT AS bin, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT u.user_id, b.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM e) u CROSS JOIN generate_series(0, 29) b(bin) LEFT JOIN h ON h.user_id = u.user_id AND h.bin = b.bin),
p AS (SELECT f.user_id, f.bin, f.n, list(g.n ORDER BY d) AS near FROM f CROSS JOIN generate_series(-2, 2) w(d) JOIN f g ON g.user_id = f.user_id AND g.bin = least(29, greatest(0, f.bin + d)) GROUP BY f.user_id, f.bin, f.n)
SELECT user_id, bin, n::BIGINT AS n, round(list_aggregate(near, 'quantile_cont', 0.9), 6) AS level, greatest(0, n - list_aggregate(near, 'median'))::DOUBLE AS above FROM p""")
def rolling_percentile_padded(spark, sf_dir):
    """Percentile of a window over a histogram whose ends repeat their last bin."""
    h = _events(spark, sf_dir).groupBy("user_id", F.least(F.lit(29), F.floor((F.col("t") - 1704067200) / 86400)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    a = h.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    a = a.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda b: F.coalesce(F.col("m")[b], F.lit(0))).alias("v"))
    near = a.select("user_id", F.posexplode("v").alias("bin", "n"), "v").withColumn("near", F.expr("sort_array(transform(sequence(bin - 2, bin + 2), b -> v[least(29, greatest(0, b))]))"))
    level = F.expr("near[3] + 0.6D * (near[4] - near[3])")
    return near.select("user_id", F.col("bin").cast("long").alias("bin"), "n", F.round(level, 6).alias("level"), F.greatest(F.lit(0), F.col("n") - F.col("near")[2]).cast("double").alias("above"))


@query(f"""WITH {_E}, a AS (SELECT *, (value % 90) - 45 AS turn FROM e) SELECT event_id, round(abs(sum(turn) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 4) AS turned,
  CASE WHEN abs(sum(turn) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) > 60 THEN 'node' ELSE 'line' END AS kind FROM a""")
def rolling_turn_class(spark, sf_dir):
    """Angle accumulated over a window on both sides; nodes and lines of a path."""
    turned = F.abs(F.sum(F.col("value") % 90 - 45).over(_path().rowsBetween(-3, 3)))
    return _events(spark, sf_dir).select("event_id", F.round(turned, 4).alias("turned"), F.when(turned > 60, "node").otherwise("line").alias("kind"))


@query(f"""WITH {_E}, f AS (SELECT user_id, row_number() OVER {_W} AS n, value > 15 AS up FROM e), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, up ORDER BY n) AS isl FROM f), r AS (SELECT user_id, isl, count(*) AS len FROM g WHERE up GROUP BY ALL) SELECT user_id, coalesce(sum(len) FILTER (len >= 3), 0)::BIGINT AS opened, sum(len)::BIGINT AS before, coalesce(max(len), 0)::BIGINT AS longest FROM r GROUP BY user_id""")
def binary_opening(spark, sf_dir):
    """Runs shorter than k vanish, others keep their whole extent."""
    e = _events(spark, sf_dir).withColumn("n", F.row_number().over(_path()))
    r = T.runs(e, ["user_id"], "n", F.col("value") > 15)
    return r.groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("length") >= 3, F.col("length"))), F.lit(0)).alias("opened"), F.sum("length").alias("before"), F.coalesce(F.max("length"), F.lit(0)).alias("longest"))


@query(f"""WITH {_E}, p AS (SELECT user_id, event_id, row_number() OVER {_W} AS n, (event_id * 37) % 101 AS idx FROM e), m AS (SELECT *, max(idx) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p)
SELECT user_id, count(*) FILTER (last IS NULL OR idx > last) AS kept, max(idx) AS top, count(*) FILTER (idx <= last) AS dropped FROM m GROUP BY user_id""")
def monotone_anchors(spark, sf_dir):
    """An anchor goes if its index is not above the last one kept, which is the running maximum."""
    p = _events(spark, sf_dir).withColumn("idx", F.col("event_id") * 37 % 101)
    p = p.withColumn("last", F.max("idx").over(_path().rowsBetween(Window.unboundedPreceding, -1)))
    return p.groupBy("user_id").agg(F.expr("count_if(last IS NULL OR idx > last)").alias("kept"), F.max("idx").alias("top"), F.expr("count_if(idx <= last)").alias("dropped"))


@query(f"""WITH {_E}, s AS (SELECT *, value - lag(value, 1, value) OVER {_W} AS dz, radians((event_id * 11) % 360) AS h FROM e), c AS (SELECT *, coalesce(lag(h) OVER {_W}, 0) AS hp FROM s)
SELECT event_id, round(sum(dz * cos(hp)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 3) AS x, round(sum(dz * sin(hp)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 3) AS y, round(first_value(value) OVER {_W} + (value / 10 - first_value(value / 10) OVER {_W}), 4) AS z FROM c""")
def odometry_reintegration(spark, sf_dir):
    """Local steps turned by the corrected heading before them and summed; height taken from the floor distance."""
    w = _path()
    s = _events(spark, sf_dir).withColumn("dz", F.col("value") - F.coalesce(F.lag("value").over(w), "value")).withColumn("h", F.radians(F.col("event_id") * 11 % 360))
    s = s.withColumn("hp", F.coalesce(F.lag("h").over(w), F.lit(0.0)))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("value").over(so_far)
    return s.select("event_id", F.round(F.sum(F.col("dz") * F.cos("hp")).over(so_far) + 1e-9, 3).alias("x"), F.round(F.sum(F.col("dz") * F.sin("hp")).over(so_far) + 1e-9, 3).alias("y"), F.round(first + (F.col("value") / 10 - first / 10), 4).alias("z"))


@query("""WITH f AS (SELECT o_custkey % 50 AS house, o_orderstatus AS room, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT house, room, row_number() OVER (PARTITION BY house ORDER BY first) - 1 AS ordinal FROM f""")
def first_appearance_ordinal(spark, sf_dir):
    """Groups numbered by first appearance."""
    f = A.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("house"), F.col("o_orderstatus").alias("room")).agg(F.min("o_orderkey").alias("first"))
    return f.select("house", "room", (F.row_number().over(Window.partitionBy("house").orderBy("first")) - 1).cast("long").alias("ordinal"))


@query(f"""WITH {_E}, s AS (SELECT *, CASE WHEN event_type = 'view' THEN t END AS seen FROM e), a AS (SELECT *, t - max(seen) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS age FROM s) SELECT user_id, count(*) FILTER (age IS NULL) AS unknown, count(*) FILTER (age > 172800) AS forgotten, count(*) FILTER (age <= 172800) AS alive, round(avg(least(1.0, 50.0 / nullif(value, 0))), 6) AS mean_gate FROM a GROUP BY user_id""")
def state_expiry(spark, sf_dir):
    """State is forgotten when its last refresh is too old; steps beyond the gate are scaled to it."""
    seen = F.max(F.when(F.col("event_type") == "view", F.col("t"))).over(_path().rowsBetween(Window.unboundedPreceding, 0))
    a = _events(spark, sf_dir).withColumn("age", F.col("t") - seen)
    return a.groupBy("user_id").agg(F.expr("count_if(age IS NULL)").alias("unknown"), F.expr("count_if(age > 172800)").alias("forgotten"), F.expr("count_if(age <= 172800)").alias("alive"), F.round(F.avg(F.expr("least(1.0D, 50.0D / nullif(value, 0))")), 6).alias("mean_gate"))


_ARC = "radians(least(abs(ha - hb), 360 - abs(ha - hb)))"


@query(f"""WITH {_E}, v AS (SELECT user_id, event_id, t FROM e WHERE event_type = 'view'), c AS (SELECT t, any_value(value) AS value, any_value(event_id) AS event_id FROM e WHERE event_type = 'click' GROUP BY t),
b AS (SELECT v.*, c.t AS pt, c.value AS pv, c.event_id * 17 % 360 AS ha FROM v ASOF LEFT JOIN c ON v.t >= c.t), n AS (SELECT v.event_id, c.t AS nt, c.value AS nv, c.event_id * 17 % 360 AS hb FROM v ASOF LEFT JOIN c ON v.t < c.t),
m AS (SELECT b.event_id, b.t, pt, nt, pv, nv, coalesce(ha, hb) AS ha, coalesce(hb, ha) AS hb, CASE WHEN pt IS NULL OR nt IS NULL THEN 0 ELSE (b.t - pt) / (nt - pt) END AS f FROM b JOIN n USING (event_id)),
q AS (SELECT *, cos(radians(ha / 2)) * cos(radians(hb / 2)) + sin(radians(ha / 2)) * sin(radians(hb / 2)) AS dot FROM m), d AS (SELECT *, CASE WHEN dot < 0 THEN -1 ELSE 1 END AS sg, acos(least(abs(dot), 1.0)) AS th, abs(dot) > 0.9995 AS near FROM q),
w AS (SELECT *, CASE WHEN near THEN 1 - f ELSE sin((1 - f) * th) / CASE WHEN near THEN 1 ELSE sin(th) END END AS wa, sg * CASE WHEN near THEN f ELSE sin(f * th) / CASE WHEN near THEN 1 ELSE sin(th) END END AS wb FROM d),
z AS (SELECT *, wa * sin(radians(ha / 2)) + wb * sin(radians(hb / 2)) AS s, wa * cos(radians(ha / 2)) + wb * cos(radians(hb / 2)) AS c FROM w)
SELECT event_id, round(coalesce(pv + (nv - pv) * f, pv, nv), 4) AS x, round(abs(c / sqrt(s * s + c * c)), 5) AS qw, round(least(abs(t - pt), abs(nt - t)), 3) AS gap FROM z""")
def pose_slerp_interpolation(spark, sf_dir):
    """Position by linear, attitude by spherical interpolation between the samples around a time, held at both ends; the gap to the nearest real sample."""
    e = _events(spark, sf_dir)
    c = e.where("event_type = 'click'").groupBy("t").agg(F.min("value").alias("value"), F.min("event_id").alias("event_id"))
    b = T.bracket(e.where("event_type = 'view'").select("event_id", "t"), c, ["value", "event_id"])
    p, n = F.coalesce("prev", "next"), F.coalesce("next", "prev")
    f = F.when(F.col("prev").isNull() | F.col("next").isNull(), 0.0).otherwise((F.col("t") - F.col("prev.t")) / (F.col("next.t") - F.col("prev.t")))
    quat = lambda s: [F.lit(0.0), F.lit(0.0), F.sin(F.radians(s["event_id"] * 17 % 360 / 2)), F.cos(F.radians(s["event_id"] * 17 % 360 / 2))]
    q = G.slerp(quat(p), quat(n), f)
    gap = F.least(F.abs(F.col("t") - F.col("prev.t")), F.abs(F.col("next.t") - F.col("t")))
    return b.select("event_id", F.round(p["value"] + (n["value"] - p["value"]) * f, 4).alias("x"), F.round(F.abs(q[3]), 5).alias("qw"), F.round(gap, 3).alias("gap"))


@query(f"""WITH {_E}, s AS (SELECT user_id, min(t) AS t0, max(t) AS t1, count(*) AS n FROM e GROUP BY user_id), r AS (SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY e.t, event_id) - 1 AS i, e.t, t0, t1, n FROM e JOIN s USING (user_id))
SELECT event_id, round(i / ((n - 1) / (t1 - t0)), 3) AS uniform_t, round(t - t0, 3) AS rebased, abs(i / ((n - 1) / (t1 - t0)) - (t - t0)) <= 259200 AS sane, round(t0 + i / 5.0, 3) AS fps_epoch FROM r""")
def uniform_retiming(spark, sf_dir):
    """Uniform time stamps by the mean rate, times rebased to the first, epochs of constant frame rate, a sanity check."""
    e = _events(spark, sf_dir)
    s = e.groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"))
    r = e.withColumn("i", F.row_number().over(_path()) - 1).join(s, "user_id")
    u, b = F.col("i") / ((F.col("n") - 1) / (F.col("t1") - F.col("t0"))), F.col("t") - F.col("t0")
    return r.select("event_id", F.round(u, 3).alias("uniform_t"), F.round(b, 3).alias("rebased"), (F.abs(u - b) <= 259200).alias("sane"), F.round(F.col("t0") + F.col("i") / 5.0, 3).alias("fps_epoch"))


@query(f"""WITH {_E}, d AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-30 00:00:00', INTERVAL 3 DAY)) AS g FROM (SELECT DISTINCT user_id FROM e)), t AS (SELECT user_id, epoch_us(g) / 1e6 AS t FROM d), k AS (SELECT user_id, t, max(value) AS value FROM e GROUP BY ALL),
b AS (SELECT t.user_id, t.t, k.t AS pt, k.value AS pv FROM t ASOF LEFT JOIN k ON t.user_id = k.user_id AND t.t >= k.t), n AS (SELECT t.user_id, t.t, k.t AS nt, k.value AS nv FROM t ASOF LEFT JOIN k ON t.user_id = k.user_id AND t.t < k.t)
SELECT user_id, t, round(CASE WHEN pt IS NULL THEN NULL WHEN nt IS NULL THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END, 4) AS ghi FROM b JOIN n USING (user_id, t)""")
def irradiance_on_grid(spark, sf_dir):
    """Series brought to a grid of dates: unknown before the first sample, linear between samples, the last value after the end."""
    e = _events(spark, sf_dir).groupBy("user_id", "t").agg(F.max("value").alias("value"))
    g = e.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-30 00:00:00', INTERVAL 3 DAY)")).alias("g")).select("user_id", (A.epoch_us("g") / F.lit(1e6)).alias("t"))
    both = e.withColumn("s", F.struct("t", "value")).select("user_id", "t", "s").unionByName(g.withColumn("s", F.lit(None).cast("struct<t:double,value:double>")))
    back = F.last("s", True).over(Window.partitionBy("user_id").orderBy("t", F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("s", True).over(Window.partitionBy("user_id").orderBy(F.desc("t"), F.col("s").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    b = both.withColumn("p", back).withColumn("n", ahead).where("s IS NULL")
    value = F.when(F.col("p").isNotNull(), F.when(F.col("n").isNull(), F.col("p.value")).otherwise(F.col("p.value") + (F.col("n.value") - F.col("p.value")) * (F.col("t") - F.col("p.t")) / (F.col("n.t") - F.col("p.t"))))
    return b.select("user_id", "t", F.round(value, 4).alias("ghi"))


@query(f"""WITH {_E}, p AS (SELECT user_id, floor((t - 1704067200) / 86400)::BIGINT AS bin, count(*)::DOUBLE AS n FROM e GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY bin) AS cum FROM p), l AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY user_id ORDER BY bin), 0) AS was FROM c)
SELECT user_id, round(min(bin + (20 - was) / (cum - was)), 6) AS crossing FROM l WHERE was < 20 AND cum >= 20 GROUP BY user_id""")
def threshold_crossing(spark, sf_dir):
    """Place inside a bin where the running profile crosses a threshold."""
    p = _events(spark, sf_dir).groupBy("user_id", F.floor((F.col("t") - 1704067200) / 86400).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("bin")
    c = p.withColumn("cum", F.sum("n").over(w)).withColumn("was", F.coalesce(F.lag("cum").over(w), F.lit(0)))
    return c.where("was < 20 AND cum >= 20").groupBy("user_id").agg(F.round(F.min(F.expr("bin + (20 - was) / (cum - was)")), 6).alias("crossing"))


@query("""WITH f AS (SELECT user_id, strftime(ts, '%H%M') AS name, event_id FROM events WHERE event_type = 'signup'), d AS (SELECT *, abs((substr(name, 1, 2)::INT * 60 + substr(name, 3, 2)::INT) - 750) AS d FROM f) SELECT user_id, min(d)::BIGINT AS off_minutes, arg_min(name, (d, event_id)) AS name FROM d GROUP BY user_id""")
def nearest_clock_file(spark, sf_dir):
    """Files named by the clock; the one nearest to a time of day."""
    f = A.table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.date_format("ts", "HHmm").alias("name"), "event_id")
    f = f.withColumn("d", F.abs(F.substring("name", 1, 2).cast("int") * 60 + F.substring("name", 3, 2).cast("int") - 750))
    return f.groupBy("user_id").agg(F.min("d").cast("long").alias("off_minutes"), F.min_by("name", F.struct("d", "event_id")).alias("name"))


@query(f"""WITH {_E}, d AS (SELECT user_id, event_type, t, t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t) AS dt FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY dt DESC, t) AS k FROM d WHERE dt IS NOT NULL) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS place, round(dt, 3) AS dt FROM r WHERE k <= 3""")
def longest_gaps(spark, sf_dir):
    """The longest gaps of each topic, then again in order of time (the report's size)."""
    w = Window.partitionBy("user_id", "event_type")
    d = _events(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(w.orderBy("t"))).where("dt IS NOT NULL")
    top = d.withColumn("k", F.row_number().over(w.orderBy(F.desc("dt"), "t"))).where("k <= 3")
    return top.select("user_id", "event_type", F.row_number().over(w.orderBy("t")).cast("long").alias("place"), F.round("dt", 3).alias("dt"))


@query(f"""WITH {_E}, w AS (SELECT user_id, floor((t - 1704067200) / 259200)::BIGINT AS win, count(*) AS n, stddev_pop(value) AS score FROM e GROUP BY ALL), b AS (SELECT user_id, max(n) AS best FROM w GROUP BY user_id) SELECT user_id, arg_min(win, (round(score, 9), win)) AS win, round(min(score), 5) AS score, count(*) AS gated FROM w JOIN b USING (user_id) WHERE n >= 0.6 * best GROUP BY user_id""")
def best_window(spark, sf_dir):
    """The calmest window among those that are dense enough against the densest."""
    w = _events(spark, sf_dir).groupBy("user_id", F.floor((F.col("t") - 1704067200) / 259200).alias("win")).agg(F.count("*").alias("n"), F.stddev_pop("value").alias("score"))
    w = w.join(w.groupBy("user_id").agg(F.max("n").alias("best")), "user_id").where("n >= 0.6 * best")
    return w.groupBy("user_id").agg(F.min_by("win", F.struct(F.round("score", 9), "win")).alias("win"), F.round(F.min("score"), 5).alias("score"), F.count("*").alias("gated"))


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, radians(o_orderkey % 60) AS a, o_totalprice / 1000 AS x, (o_orderkey % 7)::DOUBLE AS y, 1.0::DOUBLE AS z FROM orders WHERE o_custkey % 5 = 0),
p(path, n, r00, r01, r02, r10, r11, r12, r20, r21, r22, x, y, z) AS (SELECT DISTINCT path, 0::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM s
UNION ALL SELECT q.path, s.n,
 CASE WHEN s.n % 2 = 0 THEN r00 * cos(a) - r01 * sin(a) ELSE r00 END, CASE WHEN s.n % 2 = 0 THEN r00 * sin(a) + r01 * cos(a) ELSE r01 * cos(a) - r02 * sin(a) END, CASE WHEN s.n % 2 = 0 THEN r02 ELSE r01 * sin(a) + r02 * cos(a) END,
 CASE WHEN s.n % 2 = 0 THEN r10 * cos(a) - r11 * sin(a) ELSE r10 END, CASE WHEN s.n % 2 = 0 THEN r10 * sin(a) + r11 * cos(a) ELSE r11 * cos(a) - r12 * sin(a) END, CASE WHEN s.n % 2 = 0 THEN r12 ELSE r11 * sin(a) + r12 * cos(a) END,
 CASE WHEN s.n % 2 = 0 THEN r20 * cos(a) - r21 * sin(a) ELSE r20 END, CASE WHEN s.n % 2 = 0 THEN r20 * sin(a) + r21 * cos(a) ELSE r21 * cos(a) - r22 * sin(a) END, CASE WHEN s.n % 2 = 0 THEN r22 ELSE r21 * sin(a) + r22 * cos(a) END,
 q.x - (r00 * s.x + r01 * s.y + r02 * s.z), q.y - (r10 * s.x + r11 * s.y + r12 * s.z), q.z - (r20 * s.x + r21 * s.y + r22 * s.z) FROM p q JOIN s ON s.path = q.path AND s.n = q.n + 1)
SELECT path, n, round(x + 1e-9, 4) AS x, round(y + 1e-9, 4) AS y, round(z + 1e-9, 4) AS z FROM p WHERE n > 0""")
def pose_chain_product(spark, sf_dir):
    """The non-commutative product of turns along a path (about z and x by turns); positions by the rotation before the step. A path is bounded by its customer."""
    import numpy as np

    from prismfield.operators import kernels as K

    o = A.table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").select(F.col("o_custkey").alias("path"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("x"))

    def run(key, pdf):
        pdf = pdf.sort_values("o_orderkey", ignore_index=True)
        a = np.radians(pdf["o_orderkey"].to_numpy() % 60)
        n = np.arange(1, len(pdf) + 1)
        steps = np.stack([pdf["x"].to_numpy(), (pdf["o_orderkey"].to_numpy() % 7).astype(float), np.ones(len(pdf))], 1)
        turns = np.where((n % 2 == 0)[:, None, None], K.about_z(a), K.about_x(a))
        places = K.chain(turns, steps)
        return pdf.assign(n=n, x=np.round(places[:, 0] + 1e-9, 4), y=np.round(places[:, 1] + 1e-9, 4), z=np.round(places[:, 2] + 1e-9, 4))[["path", "n", "x", "y", "z"]]

    return o.groupBy("path").applyInPandas(run, "path long, n long, x double, y double, z double")
