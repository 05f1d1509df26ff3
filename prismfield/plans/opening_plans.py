"""Openings of walls: masks thrown on walls, rectangles from points, merged views, pitches and bays, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismfield.operators import frames as FR
from prismfield.operators import openings as O
from prismfield.sources import adapters as A

from .registry import query

_CENTS = "cast(floor(l_extendedprice * 100 + 0.5e0) AS bigint)"
# Two boxes side by side in each of eight buildings; a camera for each supplier; masks of 7 by 9 pixels, one a supplier and line number, from all of lineitem.
_BOXES = """SELECT building, box, CASE box WHEN 0 THEN 0.0e0 ELSE 6.0e0 END AS x0, CASE box WHEN 0 THEN 6.0e0 ELSE 10.0e0 END AS x1, 0.0e0 AS y0, 4.0e0 AS y1, 0.0e0 AS z0, 3.0e0 AS z1
FROM (SELECT DISTINCT s_suppkey % 8 AS building FROM supplier) CROSS JOIN (SELECT 0 AS box UNION ALL SELECT 1 AS box)"""
_CAMERAS = """SELECT s_suppkey AS frame, s_suppkey % 8 AS building, 40.0e0 AS fx, 40.0e0 AS fy, 32.0e0 AS cx, 24.0e0 AS cy, 3 + 1.5e0 * cos(s_suppkey) AS ox, 2 + sin(s_suppkey) AS oy, 1.5e0 AS oz,
  sin(0.7e0 * s_suppkey) AS s, cos(0.7e0 * s_suppkey) AS c FROM supplier"""
_PIXELS = f"""SELECT DISTINCT l_suppkey AS frame, l_linenumber AS segment, 8 + (l_suppkey * 7 + l_linenumber * 13) % 30 + l_partkey % 7 - 3 AS row, 8 + (l_suppkey * 11 + l_linenumber * 17) % 46 + {_CENTS} % 9 - 4 AS col FROM lineitem"""

_OUTLINE_SQL = f"""pixels AS ({_PIXELS}),
outline AS (SELECT frame, segment, row, min(col) AS col FROM pixels GROUP BY ALL UNION SELECT frame, segment, row, max(col) FROM pixels GROUP BY ALL
  UNION SELECT frame, segment, min(row), col FROM pixels GROUP BY ALL UNION SELECT frame, segment, max(row), col FROM pixels GROUP BY ALL)"""


def _scene(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    boxes = spark.sql(_BOXES.replace("FROM supplier", "FROM {s}"), s=t("supplier"))
    cameras = spark.sql(_CAMERAS.replace("FROM supplier", "FROM {s}"), s=t("supplier"))
    o = F.lit(0.0)
    cameras = cameras.withColumn("r", F.array("s", o, "c", -F.col("c"), o, "s", o, F.lit(-1.0), o)).drop("s", "c")
    return spark.sql(_PIXELS.replace("FROM lineitem", "FROM {li}"), li=t("lineitem")), cameras, boxes


@query(f"WITH {_OUTLINE_SQL} SELECT frame, segment, count(*) AS n, min(row) AS top, max(row) AS bottom, sum(row * 100 + col) AS mark FROM outline GROUP BY frame, segment")
def mask_boundaries(spark, sf_dir):
    """Outermost pixels of each row and column of a mask."""
    out = O.boundaries(_scene(spark, sf_dir)[0])
    return out.groupBy("frame", "segment").agg(F.count("*").alias("n"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.sum(F.col("row") * 100 + F.col("col")).alias("mark"))


_HIT = "t > 0 AND along BETWEEN lo - {m} AND hi + {m} AND up BETWEEN z0 - {m} AND z1 + {m}"
_MEET = """SELECT *, abs(d) AS cosine, CASE WHEN across = 0 THEN oy + t * dy ELSE ox + t * dx END AS along, oz + t * dz AS up
  FROM (SELECT *, CASE WHEN d <> 0 THEN (fixed - o) / d END AS t FROM (SELECT *, CASE WHEN across = 0 THEN dx ELSE dy END AS d, CASE WHEN across = 0 THEN ox ELSE oy END AS o FROM ({rows})))"""
_RAY = """SELECT * EXCLUDE (u, v, m), (s * u + c) / m AS dx, (-c * u + s) / m AS dy, -v / m AS dz FROM (SELECT *, sqrt(u * u + v * v + 1) AS m FROM (SELECT p.*, k.* EXCLUDE (frame), (p.col - k.cx) / k.fx AS u, (p.row - k.cy) / k.fy AS v FROM {pixels} p JOIN cameras k ON p.frame = k.frame))"""
_CHOSEN_SQL = f"""{_OUTLINE_SQL}, boxes AS ({_BOXES}), cameras AS ({_CAMERAS}),
walls AS (SELECT building, box, box * 4 + k AS face, ['left', 'right', 'bottom', 'top'][k + 1] AS side, CASE WHEN k < 2 THEN 0 ELSE 1 END AS across, [x0, x1, y0, y1][k + 1] AS fixed, CASE WHEN k < 2 THEN y0 ELSE x0 END AS lo, CASE WHEN k < 2 THEN y1 ELSE x1 END AS hi, z0, z1 FROM boxes, range(4) r(k)),
centre AS (SELECT frame, segment, avg(row) AS row, avg(col) AS col, count(*) AS n_rays FROM outline GROUP BY frame, segment),
cast_centre AS ({_RAY.format(pixels='centre')}), cast_all AS MATERIALIZED ({_RAY.format(pixels='outline')}),
met AS (SELECT *, CASE WHEN side IN ('left', 'bottom') THEN fixed - 0.1e0 ELSE fixed + 0.1e0 END AS beyond FROM ({_MEET.format(rows='SELECT * FROM cast_centre JOIN walls USING (building)')}) WHERE {_HIT.format(m='0.1e0')} AND cosine >= 0.2),
free AS (SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.building = m.building AND b.box <> m.box AND (CASE WHEN across = 0 THEN beyond ELSE along END) BETWEEN b.x0 AND b.x1 AND (CASE WHEN across = 0 THEN along ELSE beyond END) BETWEEN b.y0 AND b.y1 AND up BETWEEN b.z0 AND b.z1)),
votes AS (SELECT frame, segment, face, tc, count(*) FILTER ({_HIT.format(m='0.1e0')} AND cosine >= 0.2) / max(n_rays) AS share FROM ({_MEET.format(rows='SELECT a.*, f.face, f.t AS tc, f.n_rays, f.across, f.fixed, f.lo, f.hi, f.z0, f.z1 FROM cast_all a JOIN free f ON a.frame = f.frame AND a.segment = f.segment')}) GROUP BY frame, segment, face, tc HAVING share >= 0.6),
chosen AS MATERIALIZED (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY frame, segment ORDER BY tc, face) = 1)"""


@query(f"WITH {_CHOSEN_SQL} SELECT frame, segment, face, round(tc, 6) AS t, round(share, 6) AS share FROM chosen")
def faces_by_ray(spark, sf_dir):
    """The nearest wall that holds most of a mask's outline rays; walls that another box covers are passed by."""
    pixels, cameras, boxes = _scene(spark, sf_dir)
    out = O.faces_by_ray(O.boundaries(pixels), cameras, O.walls_of(boxes), boxes)
    return out.select("frame", "segment", "face", F.round("t", 6).alias("t"), F.round("share", 6).alias("share"))


@query(f"""WITH {_CHOSEN_SQL},
thrown AS ({_MEET.format(rows='SELECT a.*, w.face, w.across, w.fixed, w.lo, w.hi, w.z0, w.z1 FROM cast_all a JOIN chosen h ON a.frame = h.frame AND a.segment = h.segment JOIN walls w ON w.building = a.building AND w.face = h.face')}),
cut AS (SELECT frame, segment, face, greatest(min(along) FILTER (used), min(lo)) AS u0, least(max(along) FILTER (used), max(hi)) AS u1, greatest(min(up) FILTER (used), min(z0)) AS v0, least(max(up) FILTER (used), max(z1)) AS v1, count(*) FILTER (cosine < 0.2) AS grazing, count(*) FILTER (used) AS used
  FROM (SELECT *, cosine >= 0.2 AND t > 0 AND t <= 25 AS used FROM thrown) GROUP BY frame, segment, face HAVING count(*) FILTER (used) >= 4)
SELECT frame, segment, face, grazing, used, round(u0, 5) AS u0, round(u1, 5) AS u1, round(v0, 5) AS v0, round(v1, 5) AS v1 FROM cut WHERE u1 > u0 AND v1 > v0""")
def mask_rectangles(spark, sf_dir):
    """The outline of each mask on the plane of its wall, and its extent within the wall."""
    pixels, cameras, boxes = _scene(spark, sf_dir)
    outline, walls = O.boundaries(pixels), O.walls_of(boxes)
    out = O.mask_rectangles(outline, cameras, O.faces_by_ray(outline, cameras, walls, boxes), walls)
    return out.select("frame", "segment", "face", "grazing", "used", *(F.round(c, 5).alias(c) for c in ("u0", "u1", "v0", "v1")))


# Painted points near the walls of the first box: clusters by brand of part, spread by price, a little off the wall.
_PAINTED = f"""SELECT building, id, class, CASE WHEN w = 0 THEN off WHEN w = 1 THEN 6.0e0 + off ELSE u * 1.5e0 END AS x, CASE WHEN w < 2 THEN u ELSE 4.0e0 - off END AS y, z FROM (
  SELECT l_suppkey % 8 AS building, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CENTS}) AS id, CASE WHEN l_partkey % 3 = 0 THEN 'door' ELSE 'window' END AS class, l_partkey % 3 AS w,
    (l_partkey % 4) * 1.0e0 + ({_CENTS} % 100) * 0.006e0 AS u, 0.2e0 + (l_partkey * 31 % 5) * 0.5e0 + ({_CENTS} % 37) * 0.004e0 AS z, (l_tax - 0.04e0) * 4 AS off FROM lineitem)"""
_POINT_RECT_SQL = f"""WITH RECURSIVE boxes AS ({_BOXES}),
walls AS (SELECT building, box * 4 + k AS face, CASE WHEN k < 2 THEN 0 ELSE 1 END AS across, [x0, x1, y0, y1][k + 1] AS fixed, CASE WHEN k < 2 THEN y0 ELSE x0 END AS lo, CASE WHEN k < 2 THEN y1 ELSE x1 END AS hi, z0, z1 FROM boxes, range(4) r(k)),
painted AS ({_PAINTED}),
near AS (SELECT p.*, face, lo, hi, z0, z1, CASE WHEN across = 0 THEN y ELSE x END AS u, abs(CASE WHEN across = 0 THEN x ELSE y END - fixed) AS off FROM painted p JOIN walls USING (building)),
best AS (SELECT * FROM near WHERE off <= 0.35 AND u BETWEEN lo - 0.1e0 AND hi + 0.1e0 AND z BETWEEN z0 - 0.1e0 AND z1 + 0.1e0 QUALIFY row_number() OVER (PARTITION BY building, id ORDER BY off, face) = 1),
placed AS MATERIALIZED (SELECT *, floor(u / 0.25e0)::BIGINT AS i, floor(z / 0.25e0)::BIGINT AS j FROM best),
cells AS MATERIALIZED (SELECT DISTINCT building, face, class, i, j FROM placed),
links AS MATERIALIZED (SELECT a.*, b.i AS bi, b.j AS bj FROM cells a JOIN cells b ON a.building = b.building AND a.face = b.face AND a.class = b.class AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1),
reach(building, face, class, i, j, ri, rj) AS (SELECT building, face, class, i, j, i, j FROM cells UNION SELECT r.building, r.face, r.class, l.bi, l.bj, r.ri, r.rj FROM reach r JOIN links l USING (building, face, class, i, j)),
named AS (SELECT building, face, class, i, j, min((ri, rj)) AS component FROM reach GROUP BY ALL)
SELECT building, face, class, round(greatest(min(u), min(lo)), 5) AS u0, round(least(max(u), max(hi)), 5) AS u1, round(greatest(min(z), min(z0)), 5) AS v0, round(least(max(z), max(z1)), 5) AS v1, count(*) AS n_points, round(median(off), 5) AS off_median, round(max(off), 5) AS off_most
FROM placed JOIN named USING (building, face, class, i, j) GROUP BY building, face, class, component"""


@query(_POINT_RECT_SQL)
def point_rectangles(spark, sf_dir):
    """Painted points on their nearest walls, one rectangle for each patch of touching cells."""
    boxes = _scene(spark, sf_dir)[2]
    points = spark.sql(_PAINTED.replace("FROM lineitem", "FROM {li}"), li=A.table(spark, sf_dir, "lineitem"))
    out = O.point_rectangles(points, O.walls_of(boxes), 0.25, A.stored)
    return out.select("building", "face", "class", "n_points", *(F.round(c, 5).alias(c) for c in ("u0", "u1", "v0", "v1", "off_median", "off_most")))


_VIEWS = """SELECT o_custkey % 40 AS face, o_orderkey AS view, o_orderkey * 31 % 500 AS n_points, (o_orderkey * 37 % 5000) / 100.0e0 AS u0, (o_orderkey * 37 % 5000) / 100.0e0 + 0.3e0 + o_custkey % 7 * 0.1e0 AS u1,
  o_orderkey % 11 * 0.1e0 AS v0, o_orderkey % 11 * 0.1e0 + 0.8e0 + o_custkey % 5 * 0.2e0 AS v1 FROM orders"""
_OVERLAP = "greatest(least(a.u1, s.u1) - greatest(a.u0, s.u0), 0) * greatest(least(a.v1, s.v1) - greatest(a.v0, s.v0), 0) / least((a.u1 - a.u0) * (a.v1 - a.v0), (s.u1 - s.u0) * (s.v1 - s.v0)) >= 0.5"


@query(f"""WITH RECURSIVE views AS MATERIALIZED ({_VIEWS}), fits AS MATERIALIZED (SELECT s.face, s.view AS seed, list(a.view) AS near FROM views s JOIN views a ON s.face = a.face AND {_OVERLAP} GROUP BY s.face, s.view),
listed AS (SELECT v.face, list({{'v': v.view, 'near': f.near}} ORDER BY n_points DESC, v.view) AS l FROM views v JOIN fits f ON f.face = v.face AND f.seed = v.view GROUP BY v.face),
w(face, n, left_, seed, mine) AS (SELECT face, 0, l, NULL::BIGINT, []::BIGINT[] FROM listed UNION ALL
  SELECT face, n + 1, list_filter(left_, lambda x: NOT list_contains(list_append(left_[1].near, left_[1].v), x.v)), left_[1].v, list_transform(list_filter(left_, lambda x: list_contains(list_append(left_[1].near, left_[1].v), x.v)), lambda x: x.v) FROM w WHERE len(left_) > 0),
g AS (SELECT face, seed AS view, unnest(mine) AS m FROM w WHERE n > 0)
SELECT g.face, g.view, count(*) AS n_views, sum(n_points)::BIGINT AS n_points, round(median(u0), 5) AS u0, round(median(u1), 5) AS u1, round(median(v0), 5) AS v0, round(median(v1), 5) AS v1 FROM g JOIN views v ON v.face = g.face AND v.view = g.m GROUP BY g.face, g.view""")
def merged_views(spark, sf_dir):
    """Views of one opening gathered around the one with most points, edges by the median."""
    views = spark.sql(_VIEWS.replace("FROM orders", "FROM {o}"), o=A.table(spark, sf_dir, "orders"))
    out = O.merge_views(views, ["face"])
    return out.select("face", "view", "n_views", "n_points", *(F.round(c, 5).alias(c) for c in ("u0", "u1", "v0", "v1")))


# Six walls of 24 by 3 metres with bays of 1.6 metres; what falls on glass lies two metres behind the wall.
_WALLS = f"""SELECT wall, u, z, CASE WHEN glass AND n <> 1 THEN 2.0e0 ELSE (l_tax - 0.04e0) END AS off, 0.0e0 AS lo, 24.0e0 AS hi, 0.0e0 AS z0, 3.0e0 AS z1 FROM (
  SELECT *, (u - 0.4e0 - 0.07e0 * wall) - pitch * floor((u - 0.4e0 - 0.07e0 * wall) / pitch) < 1.6e0 AND z > 0.8e0 AND z < 2.4e0 AS glass FROM (
    SELECT l_suppkey % 6 AS wall, 3.0e0 + 0.1e0 * (l_suppkey % 6) AS pitch, l_linenumber AS n, l_tax, ({_CENTS} * 7 + l_partkey * 13) % 2400 / 100.0e0 + 0.005e0 AS u, (l_partkey * 31 + {_CENTS}) % 300 / 100.0e0 + 0.002e0 AS z FROM lineitem))"""


def _walls(spark, sf_dir):
    return spark.sql(_WALLS.replace("FROM lineitem", "FROM {li}"), li=A.table(spark, sf_dir, "lineitem")).where("abs(off) <= 0.35")


@query(f"""WITH p AS (SELECT *, floor(u / 0.1e0)::INT AS bin FROM ({_WALLS}) WHERE abs(off) <= 0.35), counted AS (SELECT wall, b AS band, bin, count(*) AS n FROM p, range(29) r(b) WHERE z >= b * 0.1e0 AND z < b * 0.1e0 + 0.2e0 GROUP BY ALL),
thick AS (SELECT wall, band, sum(n) / 240 AS mean FROM counted GROUP BY wall, band HAVING sum(n) >= 30), f AS MATERIALIZED (SELECT t.wall, t.band, i AS bin, coalesce(n, 0) - mean AS f FROM thick t CROSS JOIN range(240) r(i) LEFT JOIN counted c ON c.wall = t.wall AND c.band = t.band AND c.bin = i),
ac AS (SELECT a.wall, a.band, b.bin - a.bin AS lag, sum(a.f * b.f) AS s FROM f a JOIN f b ON a.wall = b.wall AND a.band = b.band AND b.bin - a.bin BETWEEN 0 AND 61 GROUP BY ALL),
mean AS (SELECT a.wall, a.lag, avg(a.s / z.s) AS r, count(*) AS n_bands FROM ac a JOIN ac z ON a.wall = z.wall AND a.band = z.band AND z.lag = 0 WHERE z.s > 1e-9 GROUP BY a.wall, a.lag),
top AS (SELECT wall, arg_max(lag, r) AS k, max(n_bands) AS n_bands FROM mean WHERE lag >= 12 AND lag < 60 GROUP BY wall)
SELECT top.wall, top.n_bands, round(m1.r, 6) AS correlation, round((k + CASE WHEN m0.r - 2 * m1.r + m2.r <> 0 THEN least(0.5, greatest(-0.5, 0.5 * (m0.r - m2.r) / (m0.r - 2 * m1.r + m2.r))) ELSE 0 END) * 0.1, 5) AS pitch
FROM top JOIN mean m0 ON m0.wall = top.wall AND m0.lag = k - 1 JOIN mean m1 ON m1.wall = top.wall AND m1.lag = k JOIN mean m2 ON m2.wall = top.wall AND m2.lag = k + 1""")
def stacked_pitches(spark, sf_dir):
    """The pitch of each wall's bays from the mean autocorrelation of all its height bands."""
    out = O.pitches(_walls(spark, sf_dir), ["wall", "lo", "hi", "z0", "z1"], least_points=30)
    return out.select("wall", "n_bands", F.round("correlation", 6).alias("correlation"), F.round("pitch", 5).alias("pitch"))


@query()
def wall_bays(spark, sf_dir):
    """Bays of each wall: phase, walked-out widths, sills and heads by contrast runs of the height bands."""
    out = O.bays(_walls(spark, sf_dir), ["wall"], 0.2, 0.4, 0.2, least_points=30, least_correlation=0.1)
    return out.selectExpr("wall", "slot", "width_outlier", "n_runs", "reaches_floor", *(f"round({c}, 5) AS {c}" for c in ("u_slot", "u0", "u1", "sill", "head", "pitch")))


@query("""WITH c AS (SELECT l_suppkey, floor(l_extendedprice / 1000)::INT AS bin, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT DISTINCT l_suppkey FROM c), f AS MATERIALIZED (SELECT w.l_suppkey, i AS bin, coalesce(n, 0) AS n FROM w CROSS JOIN range(120) r(i) LEFT JOIN c ON c.l_suppkey = w.l_suppkey AND c.bin = i),
p AS (SELECT l_suppkey, arg_max(bin, (n, -bin)) AS peak, max(n) AS top FROM f GROUP BY l_suppkey),
low AS (SELECT p.l_suppkey, peak, top, coalesce(max(CASE WHEN bin < peak AND n < 0.5 * top THEN bin END), -1) + 1 AS first, coalesce(min(CASE WHEN bin > peak AND n < 0.5 * top THEN bin END), 120) - 1 AS last FROM p JOIN f USING (l_suppkey) GROUP BY p.l_suppkey, peak, top)
SELECT l_suppkey, peak, first, last FROM low""")
def histogram_peak_runs(spark, sf_dir):
    """The tallest peaks of a histogram with the runs that hold half their height; here the first of three for each supplier."""
    from pyspark.sql.types import StructType
    import numpy as np
    import pandas as pd

    li = A.table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("bin")).groupBy("l_suppkey", "bin").agg(F.count("*").alias("n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(120)
        counts[g["bin"].to_numpy()] = g["n"]
        found = O.tallest_runs(counts, 3)[:1]
        return pd.DataFrame([(g["l_suppkey"].iloc[0], p, a, b) for a, b, p in found], columns=["l_suppkey", "peak", "first", "last"])

    return li.groupBy("l_suppkey").applyInPandas(run, StructType.fromDDL("l_suppkey long, peak long, first long, last long"))


# Frames of 60 by 100 pixels, one a supplier, from all of lineitem: each line number is a segment at its own place; a strip of floor lies at the bottom.
_FRAME_LIMITS = {"dilation": 1, "floor_gap": 6, "edge_band": 5, "edge_share": 0.2, "door_width": 5, "area": 20, "wall_height": 0.5}
_FRAME_CLASSES = "CASE WHEN l_linenumber IN (1, 2) THEN 'window' WHEN l_linenumber = 7 THEN 'other' ELSE 'door' END"
_FRAME_PIXELS = f"""SELECT frame, row, col, min(segment) AS segment FROM (SELECT l_suppkey AS frame, l_linenumber AS segment,
    CASE WHEN l_linenumber = 7 THEN 57 + l_partkey % 3 ELSE 30 + l_linenumber * 5 % 17 + l_suppkey % 5 + l_partkey % (7 + l_linenumber * 2) - l_linenumber * 2 END AS row,
    CASE WHEN l_linenumber = 7 THEN {_CENTS} % 100 ELSE 6 + l_linenumber * 9 + l_suppkey * l_linenumber % 7 + {_CENTS} % (4 + l_linenumber) END AS col FROM lineitem) GROUP BY frame, row, col"""


def _regions_sql(name: str, kind: str) -> str:
    reach = 2 * _FRAME_LIMITS["dilation"] + 1
    return f"""{name}_px AS MATERIALIZED (SELECT p.frame, row, col FROM px p JOIN segs s ON s.frame = p.frame AND s.segment = p.segment WHERE class = '{kind}'),
{name}_links AS MATERIALIZED (SELECT a.frame, a.row, a.col, b.row AS r2, b.col AS c2 FROM {name}_px a JOIN {name}_px b ON a.frame = b.frame AND abs(a.row - b.row) <= {reach} AND abs(a.col - b.col) <= {reach} AND least(abs(a.row - b.row), abs(a.col - b.col)) < {reach}),
{name}_reach(frame, row, col, r0, c0) AS (SELECT frame, row, col, row, col FROM {name}_px UNION SELECT r.frame, l.r2, l.c2, r.r0, r.c0 FROM {name}_reach r JOIN {name}_links l ON l.frame = r.frame AND l.row = r.row AND l.col = r.col),
{name} AS MATERIALIZED (SELECT frame, row, col, min((r0, c0)) AS region FROM {name}_reach GROUP BY frame, row, col)"""


_L = _FRAME_LIMITS
_FRAMES_SQL = f"""WITH RECURSIVE px AS MATERIALIZED ({_FRAME_PIXELS}), segs AS (SELECT DISTINCT l_suppkey AS frame, l_linenumber AS segment, {_FRAME_CLASSES} AS class FROM lineitem),
{_regions_sql('win', 'window')}, {_regions_sql('door', 'door')},
glass AS (SELECT w.frame, row, col FROM win w JOIN (SELECT frame, region FROM win GROUP BY frame, region HAVING count(*) >= {_L['area']}) k ON k.frame = w.frame AND k.region = w.region),
floors AS (SELECT p.frame, row, col FROM px p WHERE p.segment = 7),
sized AS (SELECT frame, region, count(*) AS area, (max(row) - min(row) + 1) / 60.0e0 AS height, max(col) - min(col) + 1 AS width FROM door GROUP BY frame, region),
low AS (SELECT frame, region, col, max(row) AS low FROM door GROUP BY frame, region, col),
gaps AS (SELECT frame, region, floor(median(gap))::INT AS gap FROM (SELECT l.frame, l.region, l.col, min(f.row) - l.low AS gap FROM low l JOIN floors f ON f.frame = l.frame AND f.col = l.col AND f.row > l.low GROUP BY l.frame, l.region, l.col, l.low) GROUP BY frame, region),
ends AS (SELECT frame, region, row, min(col) AS x0, max(col) AS x1 FROM door GROUP BY frame, region, row),
room AS (SELECT frame, region, sum(least(x0, {_L['edge_band']})) AS rl, sum(least(99 - x1, {_L['edge_band']})) AS rr FROM ends GROUP BY frame, region),
held AS (SELECT e.frame, e.region, count(*) FILTER (g.col < x0 AND g.col >= x0 - {_L['edge_band']}) AS nl, count(*) FILTER (g.col > x1 AND g.col <= x1 + {_L['edge_band']}) AS nr FROM ends e JOIN glass g ON g.frame = e.frame AND g.row = e.row GROUP BY e.frame, e.region),
m AS (SELECT s.*, coalesce(gap, -1) AS gap, coalesce(nl / greatest(rl, 1), 0) AS l, coalesce(nr / greatest(rr, 1), 0) AS r FROM sized s JOIN room USING (frame, region) LEFT JOIN gaps USING (frame, region) LEFT JOIN held USING (frame, region))
SELECT frame, region[1] AS top, region[2] AS side, area, width, gap, round(height, 6) AS height, round(l, 6) AS at_left, round(r, 6) AS at_right,
  CASE WHEN greatest(l, r) > {_L['edge_share']} THEN '{FR.RULES[1]}' WHEN area < {_L['area']} THEN '{FR.RULES[2]}' WHEN width < {_L['door_width']} THEN '{FR.RULES[3]}' WHEN height >= {_L['wall_height']} THEN '{FR.RULES[4]}' WHEN gap NOT BETWEEN 0 AND {_L['floor_gap']} THEN '{FR.RULES[5]}' END AS rule FROM m"""


def _frames(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    pixels = spark.sql(_FRAME_PIXELS.replace("FROM lineitem", "FROM {li}"), li=li)
    segments = li.selectExpr("l_suppkey AS frame", "l_linenumber AS segment", f"{_FRAME_CLASSES} AS class", "CASE WHEN l_linenumber = 7 THEN 'floor' ELSE 'wall' END AS zone", "0.1e0 * l_linenumber AS confidence").distinct()
    return FR.judge(A.stored(pixels, "pixels"), A.stored(segments, "segments"), (60, 100), A.stored, limits=_FRAME_LIMITS)


@query(_FRAMES_SQL)
def frame_door_rules(spark, sf_dir):
    """Door candidates merged across gaps, their floor gaps, the glass beside them, and the first rule that turns them down."""
    out = _frames(spark, sf_dir).regions.where("class = 'door'")
    return out.select("frame", F.col("region.i").alias("top"), F.col("region.j").alias("side"), "area", "width", "gap", F.round("height", 6).alias("height"), F.round("left", 6).alias("at_left"), F.round("right", 6).alias("at_right"), "rule")


@query()
def frame_records(spark, sf_dir):
    """Records of all segments after windows and doors were merged and judged, in line with the rewritten pixels."""
    return _frames(spark, sf_dir).segments.selectExpr("frame", "segment", "class", "rule", "residual", "n_merged", "area", "round(confidence, 6) AS confidence", "x0", "y0", "x1", "y1")
