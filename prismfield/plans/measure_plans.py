"""Summaries, scores and statistics over points, frames, rooms and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismfield.operators import space as S
from prismfield.sources import adapters as A

from .registry import query

_P = A.POINTS_SQL


@query(f"WITH {_P}, v AS (SELECT frame, count(*) AS c FROM points GROUP BY frame, floor(x / 2), floor(y / 2), floor(z / 2)) SELECT frame, sum(c)::BIGINT AS points, count(*) AS voxels, min(c) >= 1 AS none_empty FROM v GROUP BY frame")
def voxel_invariant(spark, sf_dir):
    """No voxel is empty and the counts add up to the points."""
    v = S.voxelize(A.points(spark, sf_dir), 2.0).groupBy("frame", "i", "j", "k").agg(F.count("*").alias("c"))
    return v.groupBy("frame").agg(F.sum("c").alias("points"), F.count("*").alias("voxels"), (F.min("c") >= 1).alias("none_empty"))


@query("""WITH w AS (SELECT l_partkey AS voxel, l_returnflag AS cls, sum(1 - l_tax) AS w, count(*) AS n FROM lineitem WHERE l_quantity <= 12 GROUP BY ALL), f AS (SELECT l_partkey AS voxel, count(DISTINCT l_suppkey) AS frames FROM lineitem WHERE l_quantity <= 12 GROUP BY 1),
v AS (SELECT voxel, arg_min(cls, (-round(w, 9), cls)) AS cls, round(max(w) / sum(w), 6) AS agreement, sum(n)::BIGINT AS n FROM w GROUP BY voxel)
SELECT p_partkey AS voxel, coalesce(frames, 0) AS frames, coalesce(n, 0)::BIGINT AS n, agreement, CASE WHEN n IS NULL THEN 'no_lidar_sample' WHEN agreement < 0.5 THEN 'below_min_agreement' ELSE 'ok' END AS status, CASE WHEN agreement >= 0.5 THEN cls ELSE split_part(p_type, ' ', 1) END AS label FROM part LEFT JOIN v ON voxel = p_partkey LEFT JOIN f USING (voxel)""")
def consensus_rewrite(spark, sf_dir):
    """Regions take their voxel's consensus where it agrees enough; the status says why not; distinct observing frames."""
    li = A.table(spark, sf_dir, "lineitem").where("l_quantity <= 12").select(F.col("l_partkey").alias("voxel"), F.col("l_returnflag").alias("cls"), "l_tax", "l_suppkey")
    f = li.groupBy("voxel").agg(F.countDistinct("l_suppkey").alias("frames"))
    v = S.majority(li, ["voxel"], "cls", 1 - F.col("l_tax")).join(li.groupBy("voxel").agg(F.count("*").alias("n")), "voxel").withColumn("agreement", F.round(F.col("weight") / F.col("total"), 6))
    p = A.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "voxel").join(v, "voxel", "left").join(f, "voxel", "left")
    status = F.when(F.col("n").isNull(), "no_lidar_sample").when(F.col("agreement") < 0.5, "below_min_agreement").otherwise("ok")
    return p.select("voxel", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("n", F.lit(0)).alias("n"), "agreement", status.alias("status"), F.when(F.col("agreement") >= 0.5, F.col("cls")).otherwise(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("label"))


@query(f"""WITH {_P} SELECT frame, count(*) AS area, round(sum((1 - l_tax) * x) / sum(x), 6) AS confidence, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1, round(avg(y), 5) AS cy, count(DISTINCT l_partkey) AS merged FROM points GROUP BY frame""")
def merged_region_record(spark, sf_dir):
    """A merged region: area, area-weighted confidence, bounds, centroid, number of parts."""
    p = A.points(spark, sf_dir)
    return p.groupBy("frame").agg(F.count("*").alias("area"), F.round(F.sum((1 - F.col("l_tax")) * F.col("x")) / F.sum("x"), 6).alias("confidence"), *(f(c).alias(f"{c}{i}") for c in "xz" for i, f in enumerate((F.min, F.max))), F.round(F.avg("y"), 5).alias("cy"), F.countDistinct("l_partkey").alias("merged"))


@query(f"""WITH {_P}, f AS (SELECT l_partkey AS pixel, l_suppkey % 7 AS n, round(avg(l_discount) * 100, 9) AS t FROM points GROUP BY ALL) SELECT pixel, count(*) AS n, CASE WHEN round(max(t) - min(t), 9) <= 6 THEN round(median(t), 6) END AS t, round(max(t) - min(t), 6) AS spread FROM f WHERE n < 5 GROUP BY pixel""")
def temporal_consensus(spark, sf_dir):
    """Median of a pixel over its last frames, unknown where they spread too far. Means of doubles depend on their order: they count to nine digits."""
    f = A.points(spark, sf_dir).where("l_suppkey % 7 < 5").groupBy(F.col("l_partkey").alias("pixel"), (F.col("l_suppkey") % 7).alias("n")).agg(F.round(F.avg("l_discount") * 100, 9).alias("t"))
    spread = F.max("t") - F.min("t")
    return f.groupBy("pixel").agg(F.count("*").alias("n"), F.when(F.round(spread, 9) <= 6, F.round(F.median("t"), 6)).alias("t"), F.round(spread, 6).alias("spread"))


@query("""WITH v AS (SELECT user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events) SELECT user_id, min(value) AS min_v, max(value) AS max_v, round(avg(value), 6) AS mean_v, count(value) AS valid, count(*) - count(value) AS missing FROM v GROUP BY user_id""")
def session_summary(spark, sf_dir):
    """Range, mean, valid and missing values of a session."""
    v = A.table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return v.groupBy("user_id").agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.round(F.avg("v"), 6).alias("mean_v"), F.count("v").alias("valid"), (F.count("*") - F.count("v")).alias("missing"))


@query(f"""WITH {_P}, r AS (SELECT frame % 10 AS room, frame AS rect, count(*) AS n, quantile_cont(z, 0.05) AS lo, quantile_cont(z, 0.95) AS hi FROM points WHERE l_linenumber <= 3 GROUP BY ALL), w AS (SELECT frame % 10 AS room, quantile_cont(z, 0.05) AS lo, quantile_cont(z, 0.95) AS hi, count(*) AS n, count(DISTINCT frame) AS boxes FROM points WHERE l_linenumber <= 3 GROUP BY 1)
SELECT r.room, r.rect, w.boxes, w.n AS room_points, CASE WHEN r.n >= 300 THEN r.lo ELSE w.lo END AS floor_z, CASE WHEN r.n >= 300 THEN r.hi ELSE w.hi END AS ceiling_z, round(w.hi - w.lo, 6) AS room_height, w.hi <= w.lo AS inverted FROM r JOIN w USING (room)""")
def room_heights(spark, sf_dir):
    """Floor and ceiling percentiles of rectangles, of their room where they hold too few points; the room's summary and an inversion flag."""
    p = A.points(spark, sf_dir).where("l_linenumber <= 3").withColumn("room", F.col("frame") % 10)
    lo, hi = F.percentile("z", 0.05), F.percentile("z", 0.95)
    r = p.groupBy("room", F.col("frame").alias("rect")).agg(F.count("*").alias("rn"), lo.alias("rlo"), hi.alias("rhi"))
    w = p.groupBy("room").agg(lo.alias("lo"), hi.alias("hi"), F.count("*").alias("room_points"), F.countDistinct("frame").alias("boxes"))
    own = F.col("rn") >= 300
    return r.join(w, "room").select("room", "rect", "boxes", "room_points", F.when(own, F.col("rlo")).otherwise(F.col("lo")).alias("floor_z"), F.when(own, F.col("rhi")).otherwise(F.col("hi")).alias("ceiling_z"), F.round(F.col("hi") - F.col("lo"), 6).alias("room_height"), (F.col("hi") <= F.col("lo")).alias("inverted"))


@query(f"""WITH {_P}, c AS (SELECT frame, floor(x / 5)::BIGINT AS i, floor(y / 10)::BIGINT AS j, count(*) AS n FROM points GROUP BY ALL) SELECT frame, count(*) AS touched, count(*) FILTER (n >= 8) AS occupied, round(count(*) FILTER (n >= 8) / ((max(i) - min(i) + 1.0) * (max(j) - min(j) + 1.0)), 6) AS fill_ratio FROM c GROUP BY frame""")
def occupancy_and_fill(spark, sf_dir):
    """Cells with enough points; share of the bounding grid that they fill."""
    c = A.points(spark, sf_dir).groupBy("frame", S.cell("x", 5.0).alias("i"), S.cell("y", 10.0).alias("j")).agg(F.count("*").alias("n"))
    occupied = F.count_if(F.col("n") >= 8)
    return c.groupBy("frame").agg(F.count("*").alias("touched"), occupied.alias("occupied"), F.round(occupied / ((F.max("i") - F.min("i") + 1) * (F.max("j") - F.min("j") + 1)), 6).alias("fill_ratio"))


@query(f"""WITH {_P} SELECT frame, least(9, floor((x - 0) / 5))::BIGINT AS bin, count(*) AS n FROM points WHERE x >= 0 AND x <= 50 GROUP BY ALL""")
def histogram_fixed_edges(spark, sf_dir):
    """Fixed edges; the last bin is closed."""
    return A.points(spark, sf_dir).where("x >= 0 AND x <= 50").groupBy("frame", F.least(F.lit(9), F.floor(F.col("x") / 5)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {_P} SELECT frame, count(*) FILTER (d <= 6) AS inside, count(*) FILTER (d > 6 AND d <= 12) AS ring, round((count(*) FILTER (d <= 6) / 36.0::DOUBLE) / nullif(count(*) FILTER (d > 6 AND d <= 12) / 108.0::DOUBLE, 0) + 1e-9, 6) AS density_ratio FROM (SELECT frame, sqrt((x - 25) * (x - 25) + (y - 40) * (y - 40)) AS d FROM points) GROUP BY frame""")
def void_statistics(spark, sf_dir):
    """Density inside a disc against the ring about it."""
    d = A.points(spark, sf_dir).select("frame", F.expr("sqrt((x - 25) * (x - 25) + (y - 40) * (y - 40))").alias("d"))
    g = d.groupBy("frame").agg(F.expr("count_if(d <= 6)").alias("inside"), F.expr("count_if(d > 6 AND d <= 12)").alias("ring"))
    return g.select("*", F.round((F.col("inside") / 36.0) / F.expr("nullif(ring / 108.0D, 0)") + 1e-9, 6).alias("density_ratio"))


@query(f"""WITH {_P}, r AS (SELECT l_partkey AS region, quantile_cont(x, 0.05) AS p05, median(x) AS p50, quantile_cont(x, 0.95) AS p95, count(*) AS n, max(y) - min(y) AS px FROM points GROUP BY 1) SELECT region, round(p05, 5) AS p05, p50, round(p95, 5) AS p95, CASE WHEN n >= 10 AND p95 / p05 <= 20 THEN round(px * p50 / 300 + 1e-9, 6) END AS width_m FROM r""")
def region_depth_metric(spark, sf_dir):
    """Depth percentiles of a region, its pinhole size where the depths agree well enough."""
    r = A.points(spark, sf_dir).groupBy(F.col("l_partkey").alias("region")).agg(F.percentile("x", 0.05).alias("a"), F.median("x").alias("p50"), F.percentile("x", 0.95).alias("b"), F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("px"))
    return r.select("region", F.round("a", 5).alias("p05"), "p50", F.round("b", 5).alias("p95"), F.expr("CASE WHEN n >= 10 AND b / a <= 20 THEN round(px * p50 / 300 + 1e-9, 6) END").alias("width_m"))


_L = "l AS (SELECT lang, quality AS truth, CASE WHEN n_chars > 400 AND lang <> 'es' THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL)"


@query(f"""WITH {_L}, k AS (SELECT lang, cls, count(*) FILTER (truth = cls AND pred = cls) AS tp, count(*) FILTER (truth = cls) AS support, count(*) FILTER (pred = cls) AS said FROM l, (VALUES (0), (1)) c(cls) GROUP BY ALL)
SELECT lang, round(avg(coalesce(tp / nullif(said, 0), 0)) FILTER (support > 0), 6) AS macro_p, round(avg(tp / nullif(support, 0)) FILTER (support > 0), 6) AS macro_r, round(avg(coalesce(2.0 * tp / nullif(support + said, 0), 0)) FILTER (support > 0), 6) AS macro_f1, round(sum(tp) / sum(support), 6) AS accuracy FROM k GROUP BY lang""")
def macro_scores(spark, sf_dir):
    """Precision, recall and F1 averaged over the classes that the truth holds; a class never predicted counts 0."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").where("lang IS NOT NULL")
    l = A.table(spark, sf_dir, "labels").join(d, "doc_id").selectExpr("lang", "quality AS truth", "CASE WHEN n_chars > 400 AND lang <> 'es' THEN 1 ELSE 0 END AS pred", "explode(array(0, 1)) AS cls")
    k = l.groupBy("lang", "cls").agg(F.expr("count_if(truth = cls AND pred = cls)").alias("tp"), F.expr("count_if(truth = cls)").alias("support"), F.expr("count_if(pred = cls)").alias("said"))
    held = F.col("support") > 0
    mean = lambda e: F.round(F.avg(F.when(held, F.expr(e))), 6)
    return k.groupBy("lang").agg(mean("coalesce(try_divide(tp, said), 0)").alias("macro_p"), mean("try_divide(tp, support)").alias("macro_r"), mean("coalesce(try_divide(2.0D * tp, support + said), 0)").alias("macro_f1"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"))


_EPS = "e AS (SELECT l_suppkey AS frame, l_quantity AS area, a.emissivity AS truth, b.emissivity AS pred FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN material_dim a ON a.material = split_part(p.p_type, ' ', 1) JOIN part q ON q.p_partkey = l_suppkey JOIN material_dim b ON b.material = split_part(q.p_type, ' ', 1))"


@query(f"""WITH {A.MATERIALS_SQL}, {_EPS} SELECT frame, round(avg(abs(pred - truth)), 6) AS mean_error, round(sum(area * abs(pred - truth)) / sum(area), 6) AS area_error, count(*) FILTER (abs(pred - truth) > 0.10 + 1e-9) AS beyond, round(max(abs(293.15 * pow(truth / pred, 0.25) - 293.15)), 4) AS worst_dt FROM e GROUP BY frame""")
def emissivity_error(spark, sf_dir):
    """Emissivity error of frames, weighted by area, and the temperature error that it causes."""
    part = A.table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("material"))
    eps = part.join(F.broadcast(A.materials(spark)), "material").select("p_partkey", "emissivity")
    e = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame"), F.col("l_quantity").alias("area"), "l_partkey")
    e = e.join(eps.select(F.col("p_partkey").alias("l_partkey"), F.col("emissivity").alias("truth")), "l_partkey").join(eps.select(F.col("p_partkey").alias("frame"), F.col("emissivity").alias("pred")), "frame")
    d = F.abs(F.col("pred") - F.col("truth"))
    return e.groupBy("frame").agg(F.round(F.avg(d), 6).alias("mean_error"), F.round(F.sum(F.col("area") * d) / F.sum("area"), 6).alias("area_error"), F.count_if(d > 0.10 + 1e-9).alias("beyond"), F.round(F.max(F.abs(293.15 * F.pow(F.col("truth") / F.col("pred"), 0.25) - 293.15)), 4).alias("worst_dt"))


@query("""SELECT p_brand, 'before' AS state, round(max(p_retailprice), 1) AS max_v, round(avg(p_retailprice) + 1e-9, 1) AS mean_v, round(min(p_retailprice), 1) AS min_v, 0.0::DOUBLE AS delta FROM part GROUP BY 1
UNION ALL SELECT p_brand, 'after', round(max(p_retailprice - p_size), 1), round(avg(p_retailprice - p_size) + 1e-9, 1), round(min(p_retailprice - p_size), 1), round(avg(-p_size) + 1e-9, 2) FROM part GROUP BY 1""")
def before_after_table(spark, sf_dir):
    """The summary table before and after a correction, with the difference from the reference."""
    p = A.table(spark, sf_dir, "part").withColumn("r", F.explode(F.array(F.struct(F.lit("before").alias("state"), F.col("p_retailprice").alias("v"), F.lit(0.0).alias("d")), F.struct(F.lit("after").alias("state"), (F.col("p_retailprice") - F.col("p_size")).alias("v"), (-F.col("p_size")).cast("double").alias("d")))))
    g = p.groupBy("p_brand", "r.state").agg(F.round(F.max("r.v"), 1).alias("max_v"), F.round(F.avg("r.v") + 1e-9, 1).alias("mean_v"), F.round(F.min("r.v"), 1).alias("min_v"), F.avg("r.d").alias("d"))
    return g.select("p_brand", "state", "max_v", "mean_v", "min_v", F.when(F.col("state") == "before", 0.0).otherwise(F.round(F.col("d") + 1e-9, 2)).alias("delta"))


_E = "e AS (SELECT event_type, user_id, event_id, epoch_us(ts) / 1e6 AS t, value FROM events)"


def _events(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", (A.epoch_us("ts") / F.lit(1e6)).alias("t"), "value")


@query(f"""WITH {_E}, b AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM e GROUP BY user_id), s AS (SELECT user_id, event_type, min(t) AS a, max(t) AS z, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, event_type, n, round(a - t0, 3) AS lead, round(t1 - z, 3) AS tail, (CASE WHEN a - t0 > 86400 THEN 1 ELSE 0 END + CASE WHEN t1 - z > 86400 THEN 1 ELSE 0 END)::BIGINT AS edge_gaps FROM s JOIN b USING (user_id)""")
def lead_and_tail_gaps(spark, sf_dir):
    """What a topic misses at the start and the end of its recording."""
    s = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count("*").alias("n"))
    b = s.groupBy("user_id").agg(F.min("a").alias("t0"), F.max("z").alias("t1"))
    lead, tail = F.col("a") - F.col("t0"), F.col("t1") - F.col("z")
    return s.join(b, "user_id").select("user_id", "event_type", "n", F.round(lead, 3).alias("lead"), F.round(tail, 3).alias("tail"), ((lead > 86400).cast("long") + (tail > 86400).cast("long")).alias("edge_gaps"))


@query(f"""WITH {_P}, f AS (SELECT frame, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM points GROUP BY frame) SELECT frame, round(any_value(a), 6) AS slope, round(any_value(b), 5) AS intercept, round(sqrt(avg((y - a * x - b) * (y - a * x - b))), 5) AS rms, round(max(abs(y - a * x - b)), 5) AS worst FROM points JOIN f USING (frame) GROUP BY frame""")
def linear_fit_residuals(spark, sf_dir):
    """Line of least squares and the statistics of its residuals."""
    p = A.points(spark, sf_dir)
    f = p.groupBy("frame").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"))
    r = F.col("y") - F.col("a") * F.col("x") - F.col("b")
    return p.join(f, "frame").groupBy("frame").agg(F.round(F.first("a"), 6).alias("slope"), F.round(F.first("b"), 5).alias("intercept"), F.round(F.sqrt(F.avg(r * r)), 5).alias("rms"), F.round(F.max(F.abs(r)), 5).alias("worst"))


@query(f"""WITH {_P}, a AS (SELECT frame, degrees(atan2(y, x)) AS az, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS el, sqrt(x * x + y * y + z * z) AS r FROM points) SELECT frame, round(min(az), 5) AS az0, round(max(az), 5) AS az1, round(min(el), 5) AS el0, round(max(el), 5) AS el1, round(min(r), 5) AS r0, round(max(r), 5) AS r1 FROM a GROUP BY frame""")
def angular_extent(spark, sf_dir):
    """Range of azimuth, elevation and distance."""
    a = A.points(spark, sf_dir).selectExpr("frame", "degrees(atan2(y, x)) AS az", "degrees(asin(z / sqrt(x * x + y * y + z * z))) AS el", "sqrt(x * x + y * y + z * z) AS r")
    return a.groupBy("frame").agg(*(F.round(f(c), 5).alias(f"{c}{i}") for c in ("az", "el", "r") for i, f in enumerate((F.min, F.max))))


@query("""WITH i AS (SELECT l_orderkey AS image, l_suppkey % 6 AS camera, avg(CASE WHEN l_linenumber <= 4 THEN l_tax END) AS err, count(*) AS corners FROM lineitem GROUP BY ALL), s AS (SELECT camera, avg(err) AS m, stddev_samp(err) AS d FROM i GROUP BY camera)
SELECT camera, count(*) AS images, round(any_value(m), 6) AS mean_error, round(count(*) FILTER (corners < 2) / count(*), 6) AS partial, count(*) FILTER (err > m + d) AS outliers FROM i JOIN s USING (camera) GROUP BY camera""")
def image_error_stats(spark, sf_dir):
    """Error of calibration images without missing corners, share of partial boards, outliers beyond one sample deviation."""
    i = A.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 6).alias("camera")).agg(F.avg(F.when(F.col("l_linenumber") <= 4, F.col("l_tax"))).alias("err"), F.count("*").alias("corners"))
    s = i.groupBy("camera").agg(F.avg("err").alias("m"), F.stddev_samp("err").alias("d"))
    return i.join(F.broadcast(s), "camera").groupBy("camera").agg(F.count("*").alias("images"), F.round(F.first("m"), 6).alias("mean_error"), F.round(F.count_if(F.col("corners") < 2) / F.count("*"), 6).alias("partial"), F.count_if(F.col("err") > F.col("m") + F.col("d")).alias("outliers"))


@query(f"""WITH {_P}, d AS (SELECT frame, l_orderkey, CASE WHEN x < 4 THEN 'left' WHEN x > 47 THEN 'right' WHEN z < 1 THEN 'bottom' WHEN z > 9 THEN 'top' ELSE 'inside' END AS side FROM points WHERE l_linenumber <= 2),
c AS (SELECT frame, side, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT frame, sum(n) AS n, sum(n) FILTER (side = 'inside') AS ok, string_agg(CASE WHEN side <> 'inside' THEN side END, ',' ORDER BY n DESC, side) AS sides FROM c GROUP BY frame)
SELECT frame, n::BIGINT AS detections, CASE WHEN n < 150 THEN 'INCONCLUSIVE' WHEN ok / n >= 0.8 THEN 'INSIDE' ELSE 'CLIPPED[' || sides || ']' END AS verdict FROM t""")
def pose_verdict(spark, sf_dir):
    """Verdict on a board's pose by the share of detections inside the image; clipped sides by falling count."""
    side = F.expr("CASE WHEN x < 4 THEN 'left' WHEN x > 47 THEN 'right' WHEN z < 1 THEN 'bottom' WHEN z > 9 THEN 'top' ELSE 'inside' END")
    c = A.points(spark, sf_dir).where("l_linenumber <= 2").groupBy("frame", side.alias("side")).agg(F.count("*").alias("n"))
    t = c.groupBy("frame").agg(F.sum("n").alias("detections"), F.sum(F.when(F.col("side") == "inside", F.col("n"))).alias("ok"), F.array_sort(F.collect_list(F.when(F.col("side") != "inside", F.struct((-F.col("n")).alias("k"), "side")))).alias("s"))
    verdict = F.when(F.col("detections") < 150, "INCONCLUSIVE").when(F.col("ok") / F.col("detections") >= 0.8, "INSIDE").otherwise(F.concat(F.lit("CLIPPED["), F.array_join(F.col("s.side"), ","), F.lit("]")))
    return t.select("frame", "detections", verdict.alias("verdict"))


@query("""WITH r AS (SELECT o_custkey % 25 AS session, o_orderkey, CASE WHEN o_totalprice < 500 THEN 'too_small' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority LIKE '5%' THEN 'low' END AS cause, o_totalprice > 3500 AS strong FROM orders)
SELECT session, coalesce(cause, 'kept') AS cause, count(*) AS n, count(*) FILTER (cause IS NOT NULL AND strong) AS rescued FROM r GROUP BY ALL""")
def funnel_counts(spark, sf_dir):
    """What each rule rejects, keeps and rescues, by cause."""
    r = A.table(spark, sf_dir, "orders").selectExpr("o_custkey % 25 AS session", "CASE WHEN o_totalprice < 500 THEN 'too_small' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority LIKE '5%' THEN 'low' END AS cause", "o_totalprice > 3500 AS strong")
    return r.groupBy("session", F.coalesce("cause", F.lit("kept")).alias("cause")).agg(F.count("*").alias("n"), F.expr("count_if(cause IS NOT NULL AND strong)").alias("rescued"))


@query(f"""WITH {_E}, s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS step FROM e) SELECT user_id, count(step) AS steps, round(avg(CASE WHEN step < 5 THEN 1.0 ELSE 0.0 END) FILTER (step IS NOT NULL), 6) AS degenerate, avg(CASE WHEN step < 5 THEN 1.0 ELSE 0.0 END) FILTER (step IS NOT NULL) > 0.25 AS alarm FROM s GROUP BY user_id""")
def degenerate_steps(spark, sf_dir):
    """Share of steps of a path that hardly move, and the alarm."""
    s = _events(spark, sf_dir).select("user_id", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("t", "event_id"))).alias("step"))
    share = F.avg(F.when(F.col("step").isNotNull(), (F.col("step") < 5).cast("double")))
    return s.groupBy("user_id").agg(F.count("step").alias("steps"), F.round(share, 6).alias("degenerate"), (share > 0.25).alias("alarm"))


@query(f"""WITH {_P}, m AS (SELECT frame, median(y) AS med FROM points GROUP BY frame), d AS (SELECT frame, median(abs(y - med)) AS mad, any_value(med) AS med FROM points JOIN m USING (frame) GROUP BY frame) SELECT frame, round(any_value(mad), 6) AS mad, count(*) FILTER (abs(y - med) <= 3 * 1.4826 * mad) AS weighted FROM points JOIN d USING (frame) GROUP BY frame""")
def mad_weights(spark, sf_dir):
    """Hard weights by the median absolute deviation."""
    p = A.points(spark, sf_dir)
    q = p.join(p.groupBy("frame").agg(F.median("y").alias("med")), "frame")
    d = q.groupBy("frame").agg(F.median(F.abs(F.col("y") - F.col("med"))).alias("mad"))
    return q.join(d, "frame").groupBy("frame").agg(F.round(F.first("mad"), 6).alias("mad"), F.expr("count_if(abs(y - med) <= 3 * 1.4826 * mad)").alias("weighted"))


@query(f"""WITH {_P}, q AS (SELECT frame, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM points GROUP BY frame) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, frame, round(least(1.0, greatest(0.0, (y - lo) / (hi - lo))) * 255 + 1e-7)::BIGINT AS red FROM points JOIN q USING (frame) WHERE l_linenumber = 1""")
def percentile_colours(spark, sf_dir):
    """Values between two percentiles of their frame, clipped to 0..1, as colours."""
    p = A.points(spark, sf_dir)
    q = p.groupBy("frame").agg(F.percentile("y", 0.05).alias("lo"), F.percentile("y", 0.95).alias("hi"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.expr("(y - lo) / (hi - lo)")))
    return p.where("l_linenumber = 1").join(q, "frame").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "frame", F.round(share * 255 + 1e-7).cast("long").alias("red"))


@query(f"""WITH {_P}, b AS (SELECT frame % 40 AS g, frame, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, (frame % 13) * 9.0 AS sh FROM points WHERE l_linenumber = 5 GROUP BY frame) SELECT a.frame AS i, c.frame AS j, round(sqrt(pow(greatest(0, a.x0 + a.sh - c.x1 - c.sh, c.x0 + c.sh - a.x1 - a.sh), 2) + pow(greatest(0, a.y0 - c.y1, c.y0 - a.y1), 2)), 5) AS gap, round((90 - degrees(atan2(c.y0 - a.y0, c.x0 - a.x0 + 0.5)) + 360) % 360, 5) AS bearing FROM b a JOIN b c ON a.g = c.g AND a.frame < c.frame""")
def box_gaps_and_bearings(spark, sf_dir):
    """Distance between boxes (0 where they overlap) and the bearing from one to the other."""
    b = A.points(spark, sf_dir).where("l_linenumber = 5").groupBy("frame").agg(*(f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))))
    b = b.withColumn("g", F.col("frame") % 40).withColumn("sh", F.col("frame") % 13 * 9.0)
    p = b.alias("a").join(b.alias("c"), F.expr("a.g = c.g AND a.frame < c.frame"))
    gap = F.expr("sqrt(pow(greatest(0, a.x0 + a.sh - c.x1 - c.sh, c.x0 + c.sh - a.x1 - a.sh), 2) + pow(greatest(0, a.y0 - c.y1, c.y0 - a.y1), 2))")
    return p.select(F.col("a.frame").alias("i"), F.col("c.frame").alias("j"), F.round(gap, 5).alias("gap"), F.round(F.expr("(90 - degrees(atan2(c.y0 - a.y0, c.x0 - a.x0 + 0.5)) + 360) % 360"), 5).alias("bearing"))
