"""Planes of whole clouds by peeling, their rectangles, and closed boxes, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismfield.operators import planes as P
from prismfield.sources import adapters as A

from .registry import query

THRESHOLD, TRIALS, SHARE, ATTEMPTS, GAP = 0.02, 300, 0.1, 9, 0.5

# Halls of 6 by 4 by 3 metres: points of lineitem on their six faces, a seventh of them clutter. One hall in four has a thin wall, one in four lacks a wall.
_POINT = {
    "hall": "l_suppkey % 8",
    "id": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents)",
    "face": "CASE WHEN l_suppkey % 4 = 1 AND face = 1 AND l_partkey % 10 < 4 THEN 6 WHEN l_suppkey % 4 = 2 AND face = 3 THEN 6 ELSE face END",
    "u": "(cents % 997) / 997.0e0",
    "v": "((l_partkey * 31 + cents) % 991) / 991.0e0",
    "w": "l_quantity / 50.0e0",
    "e": "(l_tax - 0.04e0) * 0.1e0",
}
_XYZ = {
    "x": "CASE WHEN face = 0 THEN e WHEN face = 1 THEN 6.0e0 + e ELSE 6.0e0 * u END",
    "y": "CASE WHEN face < 2 THEN 4.0e0 * u WHEN face = 2 THEN e WHEN face = 3 THEN 4.0e0 + e ELSE 4.0e0 * v END",
    "z": "CASE WHEN face < 4 THEN 3.0e0 * v WHEN face = 4 THEN e WHEN face = 5 THEN 3.0e0 + e ELSE 3.0e0 * w END",
}
_ROOMS = f"""SELECT hall, id, {', '.join(f'{e} AS {c}' for c, e in _XYZ.items())} FROM (
  SELECT {', '.join(f'{e} AS {c}' for c, e in _POINT.items())} FROM (
    SELECT *, cast(floor(l_extendedprice * 100 + 0.5e0) AS bigint) AS cents, (l_orderkey + l_linenumber * 3 + l_partkey) % 7 AS face FROM lineitem))"""


def room_points(spark, sf_dir):
    """Clouds of halls, from all of lineitem."""
    return spark.sql(_ROOMS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=A.table(spark, sf_dir, "lineitem"))


def rooms(spark, sf_dir):
    """The clouds, made once and stored, as every round of a peel reads them again."""
    return A.stored(room_points(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism), "rooms")


def _peeled(cloud):
    return P.peel(cloud, ["hall"], A.stored, THRESHOLD, TRIALS, SHARE, 3, 20, ATTEMPTS)


def _peel_sql() -> str:
    """The peel's rounds one after another, as far as ATTEMPTS: the same draws, distances and refits."""
    off = lambda h: f"abs({h}.hx * x + {h}.hy * y + {h}.hz * z + {h}.hd)"
    det = ", ".join(f"{v} AS det_{a}" for a, v in P._DET.items())
    pick = lambda i: f"CASE WHEN det_x >= det_y AND det_x >= det_z THEN {P._SOLVED['x'][i]} WHEN det_y >= det_z THEN {P._SOLVED['y'][i]} ELSE {P._SOLVED['z'][i]} END"
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    spread = "nx * nx * xx + ny * ny * yy + nz * nz * zz + 2 * (nx * ny * xy + nx * nz * xz + ny * nz * yz)"
    parts = [f"rest0 AS MATERIALIZED ({_ROOMS})", f"floors AS MATERIALIZED (SELECT hall, greatest(3, ceil(count(*) * {SHARE}e0)) AS floor FROM rest0 GROUP BY hall)"]
    for k in range(ATTEMPTS):
        corner = ", ".join(f"max(CASE WHEN (n - 1) % 3 = {j} THEN {a} END) AS {a}{j}" for j in range(3) for a in "xyz")
        less = ", ".join(f"{a}{j} - {a}0 AS {a}{j}" for j in (1, 2) for a in "xyz")
        parts += [
            f"""hyp{k} AS MATERIALIZED (SELECT hall, trial, hx, hy, hz, -(hx * x0 + hy * y0 + hz * z0) AS hd FROM (SELECT hall, trial, x0, y0, z0, nx / size AS hx, ny / size AS hy, nz / size AS hz FROM (
              SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM (SELECT hall, trial, x0, y0, z0, y1 * z2 - z1 * y2 AS nx, z1 * x2 - x1 * z2 AS ny, x1 * y2 - y1 * x2 AS nz FROM (
                SELECT hall, trial, x0, y0, z0, {less} FROM (SELECT hall, (n - 1) // 3 AS trial, {corner} FROM (
                  SELECT *, row_number() OVER (PARTITION BY hall ORDER BY md5(concat_ws(':', {k}, id)), x, y, z) AS n FROM rest{k}) WHERE n <= {3 * TRIALS} GROUP BY hall, (n - 1) // 3)))) WHERE size > 1e-12))""",
            f"best{k} AS MATERIALIZED (SELECT h.* FROM hyp{k} h JOIN (SELECT hall, arg_min(trial, (-n, trial)) AS trial FROM (SELECT r.hall, h.trial, count(*) AS n FROM rest{k} r JOIN hyp{k} h ON r.hall = h.hall WHERE {off('h')} < {THRESHOLD}e0 GROUP BY r.hall, h.trial) GROUP BY hall) USING (hall, trial))",
            f"near{k} AS MATERIALIZED (SELECT r.* FROM rest{k} r JOIN best{k} h ON r.hall = h.hall WHERE {off('h')} < {THRESHOLD}e0)",
            f"""fit{k} AS MATERIALIZED (SELECT f.*, -(nx * cx + ny * cy + nz * cz) AS d, sqrt(greatest({spread}, 0)) AS rms, {k} AS attempt FROM (SELECT *, rx / size AS nx, ry / size AS ny, rz / size AS nz FROM (
              SELECT *, CASE WHEN greatest(det_x, det_y, det_z) > 1e-18 THEN sqrt(rx * rx + ry * ry + rz * rz) END AS size FROM (SELECT *, {', '.join(f'{pick(i)} AS r{a}' for i, a in enumerate('xyz'))} FROM (
                SELECT *, {det} FROM (SELECT hall, inliers, cx, cy, cz, {', '.join(f'm{a}{b} - c{a} * c{b} AS {a}{b}' for a, b in pairs)} FROM (
                  SELECT hall, count(*) AS inliers, {', '.join(f'avg({a}) AS c{a}' for a in 'xyz')}, {', '.join(f'avg({a} * {b}) AS m{a}{b}' for a, b in pairs)} FROM near{k} GROUP BY hall)))))) f JOIN floors USING (hall) WHERE inliers >= floor AND nx IS NOT NULL)""",
            f"rest{k + 1} AS MATERIALIZED (SELECT r.* FROM rest{k} r JOIN fit{k} f ON r.hall = f.hall JOIN best{k} h ON r.hall = h.hall WHERE NOT {off('h')} < {THRESHOLD}e0)",
        ]
    tilt = "least(degrees(acos(least(abs(nz), 1.0))), abs(90 - degrees(acos(least(abs(nz), 1.0)))))"
    parts.append("fits AS MATERIALIZED (SELECT *, " + tilt + " AS tilt, " + tilt + " <= 15 AS accepted FROM (" + " UNION ALL ".join(f"SELECT hall, attempt, inliers, cx, cy, cz, nx, ny, nz, d, rms FROM fit{k}" for k in range(ATTEMPTS)) + "))")
    return ", ".join(parts)


_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("nx", "ny", "nz", "d", "rms", "tilt"))


@query(f"WITH {_peel_sql()} SELECT hall, attempt, inliers, accepted, CASE WHEN accepted THEN (sum(accepted::INT) OVER (PARTITION BY hall ORDER BY attempt) - 1)::BIGINT END AS plane, CASE WHEN abs(nz) > 0.5 THEN 'floor_ceiling' ELSE 'wall' END AS orientation, {_ROUND} FROM fits")
def plane_peel(spark, sf_dir):
    """Planes of whole clouds, each round's best hypothesis refitted and its inliers left out; tilted ones are noise; residual of each plane."""
    out = _peeled(rooms(spark, sf_dir))
    return out.selectExpr("hall", "attempt", "inliers", "accepted", "plane", "orientation", *(f"round({c}, 6) AS {c}" for c in ("nx", "ny", "nz", "d", "rms", "tilt")))


_RECT_SQL = f"""WITH RECURSIVE {_peel_sql()},
based AS (SELECT *, CASE WHEN abs(nz) > 0.5 THEN 1 - nx * nx ELSE ny END AS ax, CASE WHEN abs(nz) > 0.5 THEN -nx * ny ELSE -nx END AS ay, CASE WHEN abs(nz) > 0.5 THEN -nx * nz ELSE 0 END AS az FROM fits WHERE accepted),
unit AS (SELECT *, ax / sqrt(ax * ax + ay * ay + az * az) AS ux, ay / sqrt(ax * ax + ay * ay + az * az) AS uy, az / sqrt(ax * ax + ay * ay + az * az) AS uz FROM based),
axes AS (SELECT *, CASE WHEN abs(nz) > 0.5 THEN ny * uz - nz * uy ELSE 0 END AS vx, CASE WHEN abs(nz) > 0.5 THEN nz * ux - nx * uz ELSE 0 END AS vy, CASE WHEN abs(nz) > 0.5 THEN nx * uy - ny * ux ELSE 1 END AS vz FROM unit),
near AS ({' UNION ALL '.join(f'SELECT {k} AS attempt, * FROM near{k}' for k in range(ATTEMPTS))}),
flat AS (SELECT hall, attempt, (x - cx) * ux + (y - cy) * uy + (z - cz) * uz AS u, (x - cx) * vx + (y - cy) * vy + (z - cz) * vz AS v FROM near JOIN axes USING (hall, attempt)),
cells AS MATERIALIZED (SELECT hall, attempt, floor(u / {GAP}e0)::BIGINT AS i, floor(v / {GAP}e0)::BIGINT AS j, count(*) AS n, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM flat GROUP BY ALL),
links AS MATERIALIZED (SELECT a.hall, a.attempt, a.i, a.j, b.i AS bi, b.j AS bj FROM cells a JOIN cells b ON a.hall = b.hall AND a.attempt = b.attempt AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1),
reach(hall, attempt, i, j, ri, rj) AS (SELECT hall, attempt, i, j, i, j FROM cells UNION SELECT r.hall, r.attempt, l.bi, l.bj, r.ri, r.rj FROM reach r JOIN links l ON l.hall = r.hall AND l.attempt = r.attempt AND l.i = r.i AND l.j = r.j),
named AS (SELECT hall, attempt, i, j, min((ri, rj)) AS component FROM reach GROUP BY hall, attempt, i, j),
sizes AS (SELECT hall, attempt, component, sum(n) AS size FROM cells JOIN named USING (hall, attempt, i, j) GROUP BY hall, attempt, component),
chosen AS (SELECT *, row_number() OVER (PARTITION BY hall, attempt ORDER BY size DESC, component) AS place, sum(size) OVER (PARTITION BY hall, attempt) AS whole FROM sizes)
SELECT hall, attempt, round(min(u0), 6) AS u0, round(max(u1), 6) AS u1, round(min(v0), 6) AS v0, round(max(v1), 6) AS v1, round((max(u1) - min(u0)) * (max(v1) - min(v0)), 6) AS area
FROM cells JOIN named USING (hall, attempt, i, j) JOIN chosen USING (hall, attempt, component) WHERE place = 1 OR whole <= 10 GROUP BY hall, attempt"""


@query(_RECT_SQL)
def plane_rectangles(spark, sf_dir):
    """Rectangles of the largest patch of each plane's inliers, along the structure."""
    cloud = rooms(spark, sf_dir)
    found = A.stored(_peeled(cloud), "planes")
    taken = P.members(cloud, found, ["hall"], THRESHOLD, A.stored)
    out = P.rectangles(taken, found.where("accepted"), ["hall", "attempt"], GAP, A.stored)
    return out.selectExpr("hall", "attempt", *(f"round({c}, 6) AS {c}" for c in ("u0", "u1", "v0", "v1", "area")))


@query()
def plane_least_rectangles(spark, sf_dir):
    """Rectangles of least area around the hull of the largest patch of each plane's inliers, turned as they may be."""
    cloud = rooms(spark, sf_dir)
    found = A.stored(_peeled(cloud), "planes")
    keys, planes = ["hall", "attempt"], found.where("accepted")
    flat = P.on_plane(P.members(cloud, found, ["hall"], THRESHOLD, A.stored), planes, keys, A.stored)
    out = P.least_rectangles(P.in_patches(flat, keys, GAP, A.stored), keys)
    return out.selectExpr(*keys, *(f"round({c}, 5) AS {c}" for c in ("centre_u", "centre_v", "width", "height", "angle")))


def closed_boxes(spark, sf_dir):
    """Planes, rectangles, one plane a surface, the largest plane of each side, a second look at open sides, caps, shared edges."""
    cloud = rooms(spark, sf_dir)
    found = A.stored(_peeled(cloud), "planes")
    sized = found.where("accepted").join(P.rectangles(P.members(cloud, found, ["hall"], THRESHOLD, A.stored), found.where("accepted"), ["hall", "attempt"], GAP, A.stored), ["hall", "attempt"])
    planes = A.stored(P.unlike(sized, ["hall"]), "unlike")
    out = P.close_box(planes, cloud, ["hall"], A.stored, THRESHOLD, TRIALS, 3, 0.05, 0.5, 0.4, GAP)
    return out.selectExpr("hall", "face", "axis", "side", "inliers", "retried", "synthetic", *(f"round({c}, 6) AS {c}" for c in ("fixed", "a0", "a1", "b0", "b1", "area")))


query()(closed_boxes)


# Planes of parts: a brand is a building, a part a plane with its axis, centroid and number of inliers; the axis z has one side or none in some brands.
_PART_PLANES = """SELECT p_brand AS brand, CAST(p_partkey AS int) AS plane, CAST(round(p_retailprice * 100) AS bigint) AS inliers, axis, 1.0e0 * (p_partkey * 7 % 101) AS cx, 1.0e0 * (p_partkey * 13 % 89) AS cy, 1.0e0 * (p_partkey * 29 % 83) AS cz
FROM (SELECT *, CASE WHEN substr(p_brand, 8, 1) = '1' AND p_size % 3 = 2 THEN 0 ELSE p_size % 3 END AS axis FROM part)
WHERE substr(p_brand, 8, 1) <> '2' OR axis <> 2 OR p_partkey * 29 % 83 < 12"""


@query(f"""WITH p AS ({_PART_PLANES}), m AS (SELECT *, sum(cx * inliers) OVER w / sum(inliers) OVER w AS mx, sum(cy * inliers) OVER w / sum(inliers) OVER w AS my, sum(cz * inliers) OVER w / sum(inliers) OVER w AS mz FROM p WINDOW w AS (PARTITION BY brand)),
s AS (SELECT *, CASE axis WHEN 0 THEN cx WHEN 1 THEN cy ELSE cz END AS fixed, CASE WHEN CASE axis WHEN 0 THEN cx < mx WHEN 1 THEN cy < my ELSE cz < mz END THEN '-' ELSE '+' END AS side FROM m),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY brand, axis, side ORDER BY inliers DESC, plane) = 1), e AS (SELECT brand, [min(cx), min(cy), min(cz)] AS low, [max(cx), max(cy), max(cz)] AS high FROM p GROUP BY brand),
g AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY brand) >= 3), b AS (SELECT brand, i AS axis, low[i + 1] AS lo, high[i + 1] AS hi, (SELECT min(fixed) FROM g WHERE g.brand = e.brand AND g.axis = i) AS f0, (SELECT max(fixed) FROM g WHERE g.brand = e.brand AND g.axis = i) AS f1 FROM e, range(3) r(i) WHERE brand IN (SELECT brand FROM g)),
o AS (SELECT *, CASE WHEN f0 IS NULL THEN 3 WHEN f1 - f0 > 1e-9 THEN 0 WHEN abs(f0 - hi) < abs(f0 - lo) THEN 1 ELSE 2 END AS opened FROM b),
t AS (SELECT *, CASE WHEN opened IN (1, 3) THEN lo ELSE f0 END AS p0, CASE opened WHEN 0 THEN f1 WHEN 1 THEN f0 ELSE hi END AS p1 FROM o),
f AS (SELECT brand, plane, axis, side, fixed, inliers, false AS synthetic FROM g UNION ALL SELECT brand, NULL, axis, '-', p0, 0, true FROM t WHERE opened IN (1, 3) UNION ALL SELECT brand, NULL, axis, '+', p1, 0, true FROM t WHERE opened IN (2, 3))
SELECT f.brand, f.plane, f.axis, f.side, f.fixed, f.inliers, f.synthetic, u.p0 AS a0, u.p1 AS a1, v.p0 AS b0, v.p1 AS b1, row_number() OVER (PARTITION BY f.brand ORDER BY plane NULLS LAST, f.axis, side) - 1 AS face
FROM f JOIN t u ON u.brand = f.brand AND u.axis = CASE WHEN f.axis = 0 THEN 1 ELSE 0 END JOIN t v ON v.brand = f.brand AND v.axis = CASE WHEN f.axis = 2 THEN 1 ELSE 2 END""")
def box_sides_and_bounds(spark, sf_dir):
    """Largest plane of each axis and side around the weighted centre, bounds, caps of open sides, edges that meet; planes from all parts."""
    p = spark.sql(_PART_PLANES.replace("FROM part)", "FROM {part})"), part=A.table(spark, sf_dir, "part"))
    p = p.withColumns({f"n{a}": (F.col("axis") == i).cast("double") for i, a in enumerate("xyz")}).drop("axis")
    p = A.stored(p.withColumn("area", F.lit(1.0)), "planes")
    kept = A.stored(P._sides(p, ["brand"]).withColumn("retried", F.lit(False)), "sides")
    extent = P.extents(p.selectExpr("brand", "cx AS x", "cy AS y", "cz AS z"), ["brand"])
    return P.box_faces(kept, extent, ["brand"]).select("brand", "plane", "axis", "side", "fixed", "inliers", "synthetic", "a0", "a1", "b0", "b1", "face")
