"""Geometry on rasters and lines, openings and walls, sun and heat formulas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from prismfield.functions import radiometry as M
from prismfield.operators import rasters as RS
from prismfield.operators import space as S
from prismfield.sources import adapters as A

from .registry import query

_P = A.POINTS_SQL
_CELLS = "c AS (SELECT frame, least(11, floor(x / 4.2))::BIGINT AS i, least(11, floor(y / 8.5))::BIGINT AS j, count(*) AS n FROM points GROUP BY ALL HAVING count(*) >= 6)"
_REACH = "r(frame, i, j, a, b) AS (SELECT frame, i, j, i, j FROM c UNION SELECT r.frame, r.i, r.j, c.i, c.j FROM r JOIN c ON c.frame = r.frame AND abs(c.i - r.a) <= 1 AND abs(c.j - r.b) <= 1)"
_LABEL = "l AS (SELECT frame, i, j, min(a * 100 + b) AS root, count(*) AS size FROM r GROUP BY ALL)"


def _cells(spark, sf_dir):
    return A.points(spark, sf_dir).groupBy("frame", F.least(F.lit(11), F.floor(F.col("x") / 4.2)).cast("long").alias("i"), F.least(F.lit(11), F.floor(F.col("y") / 8.5)).cast("long").alias("j")).agg(F.count("*").alias("n")).where("n >= 6")


def _mask(pdf) -> np.ndarray:
    m = np.zeros((12, 12), bool)
    m[pdf["i"], pdf["j"]] = True
    return m


@query(f"""WITH RECURSIVE {_P}, {_CELLS}, {_REACH}, {_LABEL}, s AS (SELECT DISTINCT frame, root, size FROM l), m AS (SELECT frame, arg_min(root, (-size, root)) AS main FROM s GROUP BY frame),
d AS (SELECT x.frame, x.root, min(sqrt((x.i - y.i) * (x.i - y.i) + (x.j - y.j) * (x.j - y.j))) AS d FROM l x JOIN m USING (frame) JOIN l y ON y.frame = x.frame AND y.root = m.main GROUP BY ALL)
SELECT s.frame, count(*) AS clusters, max(size) AS largest, count(*) FILTER (size >= 4) AS halls, (sum(size) FILTER (size >= 4 OR d <= 2.5))::BIGINT AS kept FROM s JOIN d USING (frame, root) GROUP BY s.frame""")
def declutter_clusters(spark, sf_dir):
    """Clusters of a frame; the largest, those of a least size (halls) and those near the main one stay."""
    def run(k, pdf):
        label = RS.components(_mask(pdf))
        size = np.bincount(label.ravel())[1:]
        main = np.argwhere(label == int(size.argmax()) + 1)
        near = [np.sqrt(((np.argwhere(label == c + 1)[:, None] - main[None]) ** 2).sum(2)).min() for c in range(len(size))]
        keep = (size >= 4) | (np.array(near) <= 2.5)
        return pd.DataFrame([(k[0], len(size), int(size.max()), int((size >= 4).sum()), int(size[keep].sum()))], columns=["frame", "clusters", "largest", "halls", "kept"])

    return _cells(spark, sf_dir).groupBy("frame").applyInPandas(run, "frame long, clusters long, largest long, halls long, kept long")


@query(f"""WITH RECURSIVE {_P}, {_CELLS}, {_REACH}, {_LABEL}, k AS (SELECT frame, i, j FROM l WHERE size >= 3), f AS (SELECT DISTINCT frame FROM c), e AS (SELECT f.frame, a.i, b.j FROM f, generate_series(0, 11) a(i), generate_series(0, 11) b(j) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.frame = f.frame AND k.i = a.i AND k.j = b.j)),
o(frame, i, j) AS (SELECT frame, i, j FROM e WHERE i IN (0, 11) OR j IN (0, 11) UNION SELECT e.frame, e.i, e.j FROM o JOIN e ON e.frame = o.frame AND abs(e.i - o.i) + abs(e.j - o.j) = 1), v AS (SELECT frame, count(*) AS enclosed, round(sqrt(4 * count(*) / pi()), 6) AS eq_diameter FROM (SELECT frame, i, j FROM e EXCEPT SELECT frame, i, j FROM o) GROUP BY frame)
SELECT frame, n AS cleaned, coalesce(enclosed, 0) AS enclosed, n + coalesce(enclosed, 0) AS filled, coalesce(eq_diameter, 0.0) AS eq_diameter FROM (SELECT frame, count(*) AS n FROM k GROUP BY frame) LEFT JOIN v USING (frame)""")
def grid_cleanup_and_voids(spark, sf_dir):
    """Small blobs go, empty cells that the outside does not reach are voids and are filled."""
    def run(k, pdf):
        m = RS.without_small(_mask(pdf), 3)
        v = int((RS.voids(m) > 0).sum())
        rows = [(k[0], int(m.sum()), v, int(m.sum()) + v, round(float(np.sqrt(4 * v / np.pi)), 6))] if m.any() else []
        return pd.DataFrame(rows, columns=["frame", "cleaned", "enclosed", "filled", "eq_diameter"])

    return _cells(spark, sf_dir).groupBy("frame").applyInPandas(run, "frame long, cleaned long, enclosed long, filled long, eq_diameter double")


@query(f"""WITH RECURSIVE {_P}, c0 AS (SELECT frame, least(11, floor(x / 4.2))::BIGINT AS i, least(11, floor(y / 8.5))::BIGINT AS j, count(*) AS n FROM points GROUP BY ALL), c AS (SELECT frame, i, j, n % 3 AS cls, n FROM c0), r(frame, cls, i, j, a, b) AS (SELECT frame, cls, i, j, i, j FROM c UNION SELECT r.frame, r.cls, r.i, r.j, c.i, c.j FROM r JOIN c ON c.frame = r.frame AND c.cls = r.cls AND abs(c.i - r.a) <= 1 AND abs(c.j - r.b) <= 1),
l AS (SELECT frame, cls, i, j, min(a * 100 + b) AS root FROM r GROUP BY ALL), g AS (SELECT l.frame, l.cls, root, count(*) AS area, min(l.i) AS i0, max(l.i) AS i1, round(avg(n), 5) AS confidence FROM l JOIN c USING (frame, i, j) GROUP BY ALL HAVING count(*) >= 4)
SELECT frame, cls, row_number() OVER (PARTITION BY frame, cls ORDER BY root) AS region, area, i0, i1, confidence FROM g""")
def class_raster_regions(spark, sf_dir):
    """Connected regions of each class of a raster; small ones go; numbers in row order, bounds, mean confidence."""
    c = A.points(spark, sf_dir).groupBy("frame", F.least(F.lit(11), F.floor(F.col("x") / 4.2)).cast("long").alias("i"), F.least(F.lit(11), F.floor(F.col("y") / 8.5)).cast("long").alias("j")).agg(F.count("*").alias("n"))

    def run(k, pdf):
        rows = []
        for cls in range(3):
            own = pdf[pdf["n"] % 3 == cls]
            label = RS.components(_mask(own))
            at = label[own["i"], own["j"]]
            kept = [g for g in range(1, label.max() + 1) if (at == g).sum() >= 4]
            for region, g in enumerate(kept, 1):
                part = own[at == g]
                rows.append((k[0], cls, region, len(part), int(part["i"].min()), int(part["i"].max()), round(float(part["n"].mean()), 5)))
        return pd.DataFrame(rows, columns=["frame", "cls", "region", "area", "i0", "i1", "confidence"])

    return c.groupBy("frame").applyInPandas(run, "frame long, cls long, region long, area long, i0 long, i1 long, confidence double")


@query("""WITH v AS (SELECT o_custkey AS wall, o_totalprice AS v FROM orders), d AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY wall ORDER BY v) <= 200 THEN 0 ELSE 1 END AS new FROM v), g AS (SELECT *, sum(new) OVER (PARTITION BY wall ORDER BY v ROWS UNBOUNDED PRECEDING) AS g FROM d)
SELECT wall, g::BIGINT AS cluster, count(*) AS n, round(avg(v), 4) AS snapped FROM g GROUP BY ALL""")
def chained_clusters(spark, sf_dir):
    """Sorted values chain into a cluster while the gap to the last member is small; they snap to its mean."""
    w = Window.partitionBy("wall").orderBy("v")
    v = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("wall"), F.col("o_totalprice").alias("v"))
    g = v.withColumn("new", F.when(F.col("v") - F.lag("v").over(w) <= 200, 0).otherwise(1)).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("wall", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("snapped"))


@query(f"""WITH c AS (SELECT l_suppkey AS face, l_extendedprice / 1000 AS a, l_extendedprice / 1000 + l_quantity / 40 AS b FROM lineitem WHERE l_linenumber = 1), m AS (SELECT face, a, b, max(b) OVER (PARTITION BY face ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
s AS (SELECT face, greatest(0, coalesce(reach, 0)) AS a, least(100, a) AS b FROM m UNION ALL SELECT face, max(b), 100.0 FROM c GROUP BY face) SELECT face, count(*) AS segments, round(sum(b - a), 5) AS free, round(max(b - a), 5) AS longest FROM s WHERE b - a > 0.05 GROUP BY face""")
def wall_segments(spark, sf_dir):
    """What the covers of a face leave free, as segments."""
    w = Window.partitionBy("face").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    c = A.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("face"), (F.col("l_extendedprice") / 1000).alias("a"), (F.col("l_extendedprice") / 1000 + F.col("l_quantity") / 40).alias("b"))
    inner = c.select("face", F.greatest(F.lit(0.0), F.coalesce(F.max("b").over(w), F.lit(0.0))).alias("p"), F.least(F.lit(100.0), "a").alias("q"))
    last = c.groupBy("face").agg(F.max("b").alias("p")).select("face", "p", F.lit(100.0).alias("q"))
    return inner.unionByName(last).where("q - p > 0.05").groupBy("face").agg(F.count("*").alias("segments"), F.round(F.sum(F.col("q") - F.col("p")), 5).alias("free"), F.round(F.max(F.col("q") - F.col("p")), 5).alias("longest"))


LINES = 1_000_000  # rows of lines for one task


@query("""WITH g AS (SELECT c_custkey AS wall, unnest(generate_series(0, 10)) * 1.0 AS v, 0 AS forced FROM customer UNION ALL SELECT o_custkey, round((o_totalprice % 1000) / 100, 4), 1 FROM orders), d AS (SELECT *, row_number() OVER (PARTITION BY wall, round(v * 10)::BIGINT ORDER BY forced DESC, v) AS k FROM g) SELECT wall, count(*) AS lines, sum(forced)::BIGINT AS forced, round(sum(v), 4) AS total FROM d WHERE k = 1 GROUP BY wall""")
def snapped_grid_lines(spark, sf_dir):
    """Regular lines and forced edges together, one line per spacing cell, forced ones first."""
    g = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("wall"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: k.cast("double"))).alias("v"), F.lit(0).alias("forced"))
    e = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("wall"), F.round(F.col("o_totalprice") % 1000 / 100, 4).alias("v"), F.lit(1).alias("forced"))
    # Numbers only, no struct: a cell's buffer has a fixed width and is updated in place, not sorted for. Tasks by wall, as many as keep a task's cells to some LINES.
    v = lambda forced: F.min(F.when(F.col("forced") == forced, F.col("v")))
    tasks = 1 + (11 * A.table(spark, sf_dir, "customer").count() + e.count()) // LINES
    d = g.unionByName(e).repartition(tasks, "wall").groupBy("wall", F.round(F.col("v") * 10).cast("long").alias("at")).agg(F.max("forced").alias("f"), F.coalesce(v(1), v(0)).alias("l"))
    return d.groupBy("wall").agg(F.count("*").alias("lines"), F.sum("f").cast("long").alias("forced"), F.round(F.sum("l"), 4).alias("total"))


@query("""SELECT p_partkey, CASE WHEN p_size < 3 THEN 'too_narrow' WHEN p_size > 45 THEN 'too_wide' WHEN p_retailprice < 950 THEN 'too_low' WHEN p_brand LIKE '%5' THEN 'sparse' END AS reason, (p_size BETWEEN 3 AND 45) AND p_retailprice >= 950 AND p_brand NOT LIKE '%5' AS accepted FROM part""")
def window_gates(spark, sf_dir):
    """Quality gates in order, the first that fails is the reason."""
    p = A.table(spark, sf_dir, "part")
    reason = F.when(F.col("p_size") < 3, "too_narrow").when(F.col("p_size") > 45, "too_wide").when(F.col("p_retailprice") < 950, "too_low").when(F.col("p_brand").endswith("5"), "sparse")
    return p.select("p_partkey", reason.alias("reason"), reason.isNull().alias("accepted"))


@query(f"""WITH {_P}, c AS (SELECT frame, floor(x / 2)::BIGINT AS col, median(z) FILTER (z <= 3) AS low, count(*) AS n FROM points GROUP BY ALL), g AS (SELECT frame, col, col - row_number() OVER (PARTITION BY frame ORDER BY col) AS isl FROM c WHERE low <= 1.5) SELECT frame, count(*) AS columns, round((SELECT avg(low) FROM c WHERE c.frame = g.frame), 5) AS floor_gap, max(cnt)::BIGINT AS longest FROM (SELECT *, count(*) OVER (PARTITION BY frame, isl) AS cnt FROM g) g GROUP BY frame""")
def floor_gap_and_grow(spark, sf_dir):
    """The median gap to the floor per column; the longest contiguous run of columns near the plane."""
    c = A.points(spark, sf_dir).groupBy("frame", S.cell("x", 2.0).alias("col")).agg(F.median(F.when(F.col("z") <= 3, F.col("z"))).alias("low"))
    mean = c.groupBy("frame").agg(F.round(F.avg("low"), 5).alias("floor_gap"))
    g = c.where("low <= 1.5").withColumn("isl", F.col("col") - F.row_number().over(Window.partitionBy("frame").orderBy("col"))).groupBy("frame", "isl").agg(F.count("*").alias("k"))
    return g.groupBy("frame").agg(F.sum("k").alias("columns"), F.max("k").alias("longest")).join(mean, "frame").select("frame", "columns", "floor_gap", "longest")


@query("""WITH b AS (SELECT o_custkey AS wall, o_totalprice % 1000 AS a, o_totalprice % 1000 + 60 + o_orderkey % 90 AS z, CASE WHEN o_orderstatus = 'F' THEN 'door' ELSE 'window' END AS cls FROM orders), g AS (SELECT wall, generate_series * 100.0 AS lo, generate_series * 100.0 + 80 AS hi FROM (SELECT DISTINCT wall FROM b), generate_series(0, 9)),
v AS (SELECT g.wall, lo, cls, sum(least(hi, z) - greatest(lo, a)) AS w FROM g JOIN b ON b.wall = g.wall AND least(hi, z) - greatest(lo, a) > 0 GROUP BY ALL) SELECT wall, (lo / 100)::BIGINT AS bay, arg_min(cls, (-round(w, 6), cls)) AS cls, round(sum(w), 4) AS overlap FROM v GROUP BY wall, lo""")
def bay_class_votes(spark, sf_dir):
    """Bays of a wall take the class of the openings that overlap them most; a door wins ties."""
    b = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("wall"), (F.col("o_totalprice") % 1000).alias("a"), (F.col("o_totalprice") % 1000 + 60 + F.col("o_orderkey") % 90).alias("z"), F.when(F.col("o_orderstatus") == "F", "door").otherwise("window").alias("cls"))
    g = b.withColumn("bay", F.explode(F.sequence(F.floor(F.col("a") / 100), F.least(F.lit(9), F.floor(F.col("z") / 100)))))
    g = g.withColumn("w", F.least(F.col("bay") * 100 + 80, "z") - F.greatest(F.col("bay") * 100, "a")).where("w > 0").groupBy("wall", "bay", "cls").agg(F.sum("w").alias("w"))
    return g.groupBy("wall", "bay").agg(F.min_by("cls", F.struct((-F.round("w", 6)).alias("k"), "cls")).alias("cls"), F.round(F.sum("w"), 4).alias("overlap"))


_SUN = """WITH h AS (SELECT s_suppkey, 45.0 + s_nationkey / 10.0 AS lat, (s_suppkey * 30) % 360 AS az, k::DOUBLE AS hour, 100 + (s_suppkey % 60) AS doy, 120.0 * k * (24 - k) / 24.0 * (0.5 + (s_suppkey % 5) / 10.0) AS ghi FROM supplier, generate_series(6, 18) g(k)),
p AS (SELECT *, radians(23.45 * sin(radians(360.0 * (284 + doy) / 365.0))) AS d, radians(15.0 * (hour - 12)) AS w, radians(lat) AS f FROM h), z AS (SELECT *, greatest(0.0, sin(f) * sin(d) + cos(f) * cos(d) * cos(w)) AS cz, cos(d) * sin(w) AS west, sin(f) * cos(d) * cos(w) - cos(f) * sin(d) AS south FROM p),
k AS (SELECT *, CASE WHEN cz > 0.05 THEN least(1.0, ghi / (1361.0 * (1 + 0.033 * cos(radians(360.0 * doy / 365.0))) * cz)) ELSE 0 END AS kt FROM z),
e AS (SELECT *, CASE WHEN kt <= 0.22 THEN 1 - 0.09 * kt WHEN kt <= 0.8 THEN 0.9511 - 0.1604 * kt + 4.388 * kt * kt - 16.638 * kt * kt * kt + 12.336 * kt * kt * kt * kt ELSE 0.165 END AS fd FROM k),
b AS (SELECT *, CASE WHEN cz > 0.05 THEN least(950.0, ghi * (1 - fd) / cz) ELSE 0 END AS dni, greatest(0.0, south * cos(radians(az)) + west * sin(radians(az))) AS ci FROM e), q AS (SELECT *, CASE WHEN ci > 0.05 THEN greatest(0.0, 1 - 0.05 * (1 / ci - 1)) ELSE 0 END AS iam, ghi - dni * cz AS dhi FROM b),
t AS (SELECT *, dni * ci * iam + dhi * 0.5 + ghi * 0.2 * 0.5 AS poa FROM q) SELECT s_suppkey, round(max(poa) + 1e-7, 3) AS peak, round(sum(poa) / 1000 + 1e-7, 4) AS insolation_kwh, round(max(dni) + 1e-7, 3) AS max_dni FROM t GROUP BY s_suppkey"""


@query(_SUN)
def plane_of_array_irradiance(spark, sf_dir):
    """Sun position, diffuse split, capped direct beam, transposition to a wall with incidence losses; the day's insolation."""
    s = A.table(spark, sf_dir, "supplier").select("s_suppkey", (45.0 + F.col("s_nationkey") / 10).alias("lat"), (F.col("s_suppkey") * 30 % 360).alias("az"), F.explode(F.transform(F.sequence(F.lit(6), F.lit(18)), lambda k: k.cast("double"))).alias("hour"), (100 + F.col("s_suppkey") % 60).alias("doy"))
    s = s.withColumn("ghi", 120.0 * F.col("hour") * (24 - F.col("hour")) / 24.0 * (0.5 + F.col("s_suppkey") % 5 / 10))
    poa, dni = M.wall_irradiance(F.col("ghi"), F.col("lat"), F.col("az"), F.col("hour"), F.col("doy"))
    return s.select("s_suppkey", poa.alias("poa"), dni.alias("dni")).groupBy("s_suppkey").agg(F.round(F.max("poa") + 1e-7, 3).alias("peak"), F.round(F.sum("poa") / 1000 + 1e-7, 4).alias("insolation_kwh"), F.round(F.max("dni") + 1e-7, 3).alias("max_dni"))


@query(f"""WITH {A.THERMAL_SQL}, u AS (SELECT frame, material, t_c, CASE WHEN abs(21 - t_c) < 1e-6 THEN NULL ELSE 7.7 * (21 - t_c) / (21 - 15) END AS plain, CASE WHEN abs(21 - (15 + 0.6 * 1.0 * 400 / 25 - 0.9 * 4 / 25)) < 1e-6 THEN NULL ELSE 7.7 * (21 - t_c) / (21 - (15 + 0.6 * 400 / 25 - 0.9 * 4 / 25)) END AS solar FROM (SELECT frame, material, t_c - 1.25 AS t_c FROM thermal_obs))
SELECT frame, count(*) AS n, round(avg(plain) + 1e-9, 5) AS plain_u, round(avg(solar) + 1e-9, 5) AS sol_air_u, round(avg(t_c) + 1e-9, 5) AS corrected_t, count(*) FILTER (abs(plain - solar) > 1e-3) AS differ FROM u GROUP BY frame""")
def sol_air_full_form(spark, sf_dir):
    """Sensor offset applied; U-values plain and against the full sol-air temperature; rows in which they differ."""
    o = A.thermal_obs(spark, sf_dir).withColumn("t_c", F.col("t_c") - 1.25)
    t_sa = 15 + 0.6 * 1.0 * 400 / 25 - 0.9 * 4 / 25
    u = o.select("frame", "t_c", (7.7 * (21 - F.col("t_c")) / (21 - 15)).alias("p"), (7.7 * (21 - F.col("t_c")) / (21 - t_sa)).alias("s")).select("frame", "t_c", F.when(F.abs(21 - F.col("t_c")) >= 1e-6, F.col("p")).alias("p"), "s")
    return u.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.avg("p") + 1e-9, 5).alias("plain_u"), F.round(F.avg("s") + 1e-9, 5).alias("sol_air_u"), F.round(F.avg("t_c") + 1e-9, 5).alias("corrected_t"), F.count_if(F.abs(F.col("p") - F.col("s")) > 1e-3).alias("differ"))


@query("""SELECT s_suppkey, round((((s_suppkey * 37) % 360) - degrees(atan2((s_nationkey + 1)::DOUBLE, (s_suppkey % 7 - 3.5)::DOUBLE)) + 720) % 360, 6) AS north_offset, CASE WHEN s_nationkey % 2 = 0 THEN 0.95 ELSE 0.8 + (s_suppkey % 10) / 100.0::DOUBLE END AS emissivity FROM supplier""")
def north_offset_and_broadcast(spark, sf_dir):
    """The turn that takes a local bearing to the known one; an argument given once or per row."""
    s = A.table(spark, sf_dir, "supplier")
    local = F.degrees(F.atan2(F.col("s_nationkey") + 1.0, F.col("s_suppkey") % 7 - 3.5))
    return s.select("s_suppkey", F.round((F.col("s_suppkey") * 37 % 360 - local + 720) % 360, 6).alias("north_offset"), F.when(F.col("s_nationkey") % 2 == 0, 0.95).otherwise(0.8 + F.col("s_suppkey") % 10 / 100).alias("emissivity"))


@query("""SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M') AS local_time, dayofyear(ts)::BIGINT AS doy, coalesce(json_extract_string(props, '$.k'), 'none') AS k, md5(event_type || '|' || user_id) AS digest, CASE event_type WHEN 'view' THEN 'camera' WHEN 'click' THEN 'lidar' ELSE 'other' END AS sensor FROM events""")
def dates_maps_and_json(spark, sf_dir):
    """2.12, M21: dates shifted and formatted, nested JSON read with a default, digests, a map looked up with a default."""
    sensors = F.create_map(F.lit("view"), F.lit("camera"), F.lit("click"), F.lit("lidar"))
    e = A.table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.date_format(F.expr("ts + INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm").alias("local_time"), F.dayofyear("ts").cast("long").alias("doy"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none")).alias("k"),
        F.md5(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).cast("binary")).alias("digest"), F.coalesce(F.try_element_at(sensors, "event_type"), F.lit("other")).alias("sensor"),
    )


@query("""WITH c AS (SELECT o_custkey AS w, o_orderkey AS id, o_totalprice % 100 AS x0, o_totalprice % 100 + 8 AS x1, (o_orderkey * 7) % 50 AS y0, (o_orderkey * 7) % 50 + 6 AS y1 FROM orders), r AS (SELECT *, greatest(0, least(x1, 60) - greatest(x0, 20)) * greatest(0, least(y1, 30) - greatest(y0, 10)) AS cut FROM c) SELECT w, count(*) AS n, round(sum(48 - cut), 4) AS area FROM r GROUP BY w""")
def rectangle_subtraction(spark, sf_dir):
    """A rectangle less a cut leaves at most four pieces, by columns; their areas are summed."""
    c = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("w"), (F.col("o_totalprice") % 100).alias("x0"), (F.col("o_orderkey") * 7 % 50).cast("double").alias("y0"))
    c = c.select("w", "x0", "y0", (F.col("x0") + 8).alias("x1"), (F.col("y0") + 6).alias("y1"))
    a, b = F.greatest("x0", F.least("x1", F.lit(20.0))), F.least("x1", F.greatest("x0", F.lit(60.0)))
    low, high = F.greatest("y0", F.least("y1", F.lit(10.0))), F.least("y1", F.greatest("y0", F.lit(30.0)))
    piece = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    x0, x1, y0, y1 = (F.col(n) for n in ("x0", "x1", "y0", "y1"))
    met = (b > a) & (high > low)
    pieces = F.when(met, F.array(piece(x0, y0, a, y1), piece(b, y0, x1, y1), piece(a, y0, b, low), piece(a, high, b, y1))).otherwise(F.array(piece(x0, y0, x1, y1)))
    area = F.aggregate(pieces, F.lit(0.0), lambda s, p: s + (p["x1"] - p["x0"]) * (p["y1"] - p["y0"]))
    return c.select("w", area.alias("area")).groupBy("w").agg(F.count("*").alias("n"), F.round(F.sum("area"), 4).alias("area"))


def lattice_positions(spark, sf_dir):
    """Positions on each supplier's wall: multiples of a pitch with a small deterministic error."""
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("wall"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    return s.where("(k * 7 + wall) % 4 <> 0").select("wall", (F.col("k") * (2.0 + F.col("wall") % 5 / 10) + F.col("wall") % 3 + (F.col("k") * 37 % 11 - 5) / 1000).alias("v"))


@query()
def lattice_fit(spark, sf_dir):
    """Pitch, phase and residual of the lattice that the openings of a wall lie on."""
    def run(k, pdf):
        p, c, rms = RS.lattice(np.sort(pdf["v"].to_numpy()))
        return pd.DataFrame([(k[0], round(p, 4), round(c, 4), round(rms, 6))], columns=["wall", "pitch", "phase", "rms"])

    return lattice_positions(spark, sf_dir).groupBy("wall").applyInPandas(run, "wall long, pitch double, phase double, rms double")


@query()
def plane_dedupe_and_orientations(spark, sf_dir):
    """Planes of a room in order of their inliers join the first plane that agrees in angle and offset; orientations group alike."""
    p = A.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 40).alias("room"), F.col("p_partkey").alias("id"), (F.col("p_size") * 7 % 180).alias("deg"), (F.col("p_retailprice") / 100).alias("d"), F.col("p_size").alias("inliers"))

    def run(k, pdf):
        pdf = pdf.sort_values(["inliers", "id"], ascending=[False, True], ignore_index=True)
        a = pdf["deg"].to_numpy(float)
        apart = np.abs(a[:, None] - a[None])
        apart = np.minimum(apart, 180 - apart)
        same = (apart < 10) & (np.abs(pdf["d"].to_numpy()[:, None] - pdf["d"].to_numpy()[None]) < 0.15)
        groups = RS.greedy_groups(apart < 10)
        heads = a[[int(np.flatnonzero(groups == g)[0]) for g in range(groups.max() + 1)]]
        wide = np.abs(heads[:, None] - heads[None])
        return pd.DataFrame([(k[0], len(pdf), int(RS.greedy_groups(same).max()) + 1, len(heads), float(np.minimum(wide, 180 - wide).max()))], columns=["room", "planes", "kept", "orientations", "widest"])

    return p.groupBy("room").applyInPandas(run, "room long, planes long, kept long, orientations long, widest double")
