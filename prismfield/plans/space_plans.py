"""Clouds: voxels, octrees, filters, range and radius joins, projection, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismfield.functions import geometry as G
from prismfield.operators import space as S
from prismfield.operators.quantiles import spread_quantiles
from prismfield.sources import adapters as A

from .registry import query

_P = A.POINTS_SQL
_ORD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@query(f"WITH {_P} SELECT floor(x / 5)::BIGINT AS i, floor(y / 5)::BIGINT AS j, floor(z / 5)::BIGINT AS k, count(*) AS n, round((floor(x / 5) + 0.5) * 5, 4) AS cx FROM points GROUP BY 1, 2, 3, 5 HAVING count(*) >= 2")
def voxel_grid(spark, sf_dir):
    v = S.voxelize(A.points(spark, sf_dir), 5.0).groupBy("i", "j", "k").agg(F.count("*").alias("n")).where("n >= 2")
    return v.select("i", "j", "k", "n", F.round(S.centre("i", 5.0), 4).alias("cx"))


_OCT = f"""{_P}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM points),
c AS (SELECT points.*, least(greatest(floor((x - lx) / e * 32), 0), 31)::BIGINT AS i, least(greatest(floor((y - ly) / e * 32), 0), 31)::BIGINT AS j, least(greatest(floor((z - lz) / e * 32), 0), 31)::BIGINT AS k FROM points, b)"""


@query(f"WITH {_OCT} SELECT i, j, k, count(*) AS n, arg_min(l_returnflag, l_returnflag) AS first_flag FROM c GROUP BY i, j, k")
def octree_lattice(spark, sf_dir):
    return S.octree_cells(A.points(spark, sf_dir), 5).groupBy("i", "j", "k").agg(F.count("*").alias("n"), F.min("l_returnflag").alias("first_flag"))


@query(f"WITH {_OCT}, l AS (SELECT DISTINCT i, j, k FROM c), v AS (SELECT unnest(range(0, 6)) AS level) SELECT level::INTEGER AS level, count(DISTINCT (i // (1 << (5 - level))::BIGINT, j // (1 << (5 - level))::BIGINT, k // (1 << (5 - level))::BIGINT)) AS nodes FROM l, v GROUP BY level")
def octree_level_counts(spark, sf_dir):
    return S.octree_levels(A.points(spark, sf_dir), 5)


@query(f"WITH {_P}, c AS (SELECT *, floor(x / 5)::BIGINT AS i, floor(y / 5)::BIGINT AS j, floor(z / 5)::BIGINT AS k FROM points), w AS (SELECT i, j, k, l_returnflag, count(*) AS w FROM c GROUP BY ALL) SELECT i, j, k, arg_min(l_returnflag, (-w, l_returnflag)) AS label, sum(w)::BIGINT AS n FROM w GROUP BY i, j, k")
def voxel_majority_class(spark, sf_dir):
    m = S.majority(S.voxelize(A.points(spark, sf_dir), 5.0), ["i", "j", "k"], "l_returnflag")
    return m.select("i", "j", "k", F.col("l_returnflag").alias("label"), F.col("total").alias("n"))


@query(f"WITH {_P}, c AS (SELECT *, floor(x / 5)::BIGINT AS i, floor(y / 5)::BIGINT AS j, floor(z / 5)::BIGINT AS k, row_number() OVER (PARTITION BY floor(x / 5), floor(y / 5), floor(z / 5) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn FROM points) SELECT i, j, k, x, y, z FROM c WHERE rn = 1")
def voxel_downsample_first(spark, sf_dir):
    return S.first_per_cell(S.voxelize(A.points(spark, sf_dir), 5.0), ["i", "j", "k"], _ORD, ["x", "y", "z"])


@query(f"WITH {_P} SELECT floor(x / 5)::BIGINT AS i, floor(y / 5)::BIGINT AS j, floor(z / 5)::BIGINT AS k, round(avg(x) + 1e-9, 5) AS x, round(avg(y) + 1e-9, 5) AS y, round(avg(z) + 1e-9, 5) AS z FROM points GROUP BY 1, 2, 3")
def voxel_downsample_average(spark, sf_dir):
    return S.voxelize(A.points(spark, sf_dir), 5.0).groupBy("i", "j", "k").agg(*(F.round(F.avg(a) + 1e-9, 5).alias(a) for a in "xyz"))


@query(f"""WITH {_P}, c AS (SELECT floor(x / 5)::BIGINT AS i, floor(y / 5)::BIGINT AS j, floor(z / 5)::BIGINT AS k FROM points), n AS (SELECT i, j, k, count(*) AS n FROM c GROUP BY ALL),
s AS (SELECT sum(n * n) / sum(n) AS m, sqrt(sum(n * n * n) / sum(n) - pow(sum(n * n) / sum(n), 2)) AS d FROM n)
SELECT count(*) AS cells, sum(n)::BIGINT AS points, count(*) FILTER (n >= greatest(2, m - 1.0 * d)) AS kept_cells, coalesce(sum(n) FILTER (n >= greatest(2, m - 1.0 * d)), 0)::BIGINT AS kept_points FROM n, s""")
def density_outlier_removal(spark, sf_dir):
    """Points whose cell holds at least max(2, mean - std) points; mean and deviation over points."""
    n = S.voxelize(A.points(spark, sf_dir), 5.0).groupBy("i", "j", "k").agg(F.count("*").cast("double").alias("n"))
    m = F.sum(F.col("n") * F.col("n")) / F.sum("n")
    s = n.agg(m.alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n") * F.col("n")) / F.sum("n") - m * m).alias("d"))
    keep = F.col("n") >= F.greatest(F.lit(2.0), F.col("m") - F.col("d"))
    return n.crossJoin(F.broadcast(s)).agg(F.count("*").alias("cells"), F.sum("n").cast("long").alias("points"), F.count_if(keep).alias("kept_cells"), F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).cast("long").alias("kept_points"))


@query(f"WITH {_P} SELECT frame, count(*) AS n, count(*) FILTER (x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 50 AND z BETWEEN 0 AND 6) AS roi, count(*) FILTER (sqrt(x*x + y*y + z*z) > 1e-6 AND sqrt(x*x + y*y + z*z) BETWEEN 10 AND 60) AS in_range, round(min(degrees(atan2(y, x))), 5) AS az_min, round(max(degrees(asin(z / sqrt(x*x + y*y + z*z)))), 5) AS el_max FROM points GROUP BY frame")
def roi_and_range_filters(spark, sf_dir):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    roi = F.col("x").between(10, 30) & F.col("y").between(5, 50) & F.col("z").between(0, 6)
    return A.points(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"), F.count_if(roi).alias("roi"), F.count_if((r > 1e-6) & r.between(10, 60)).alias("in_range"), F.round(F.min(F.degrees(F.atan2("y", "x"))), 5).alias("az_min"), F.round(F.max(F.degrees(F.asin(F.col("z") / r))), 5).alias("el_max"))


_K = {"fx": 400.0, "fy": 410.0, "cx": 168.0, "cy": 128.0, "k1": -0.2, "k2": 0.05, "p1": 0.001, "p2": -0.0005, "k3": 0.0}


@query(f"""WITH {_P}, c AS (SELECT frame, (x - 25) / 10 AS px, (z - 5) / 4 AS py, y / 5 AS pz FROM points),
n AS (SELECT *, px / nullif(CASE WHEN pz > 0 THEN pz END, 0) AS a, py / nullif(CASE WHEN pz > 0 THEN pz END, 0) AS b FROM c),
r AS (SELECT *, a*a + b*b AS r2 FROM n),
d AS (SELECT *, 1 - 0.2 * r2 + 0.05 * r2 * r2 AS rad FROM r),
uv AS (SELECT frame, pz, 400 * (a * rad + 2 * 0.001 * a * b - 0.0005 * (r2 + 2 * a * a)) + 168 AS u, 410 * (b * rad + 0.001 * (r2 + 2 * b * b) + 2 * -0.0005 * a * b) + 128 AS v FROM d)
SELECT frame, count(*) AS n, count(*) FILTER (u >= 0 AND u < 336 AND v >= 0 AND v < 256) AS visible,
 count(DISTINCT CASE WHEN u >= 0 AND u < 336 AND v >= 0 AND v < 256 THEN (least(greatest(round_even(u, 0), 0), 335) * 256 + least(greatest(round_even(v, 0), 0), 255))::BIGINT END) AS pixels,
 round(min(CASE WHEN u >= 0 AND u < 336 AND v >= 0 AND v < 256 THEN pz END), 5) AS nearest FROM uv GROUP BY frame""")
def camera_projection(spark, sf_dir):
    p = ((F.col("x") - 25) / 10, (F.col("z") - 5) / 4, F.col("y") / 5)
    u, v, ok = G.project(p, _K, 336, 256)
    c = A.points(spark, sf_dir).select("frame", p[2].alias("pz"), u.alias("u"), v.alias("v"), ok.alias("ok"))
    return c.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("ok").alias("visible"), F.count_distinct(F.when(F.col("ok"), G.pixel(F.col("u"), 336).cast("long") * 256 + G.pixel(F.col("v"), 256))).alias("pixels"), F.round(F.min(F.when(F.col("ok"), F.col("pz"))), 5).alias("nearest"))


@query(f"""WITH {_P}, u AS (SELECT frame, floor(x)::BIGINT AS col, floor(z)::BIGINT AS row, y FROM points), m AS (SELECT *, min(y) OVER (PARTITION BY frame, col, row) AS zmin FROM u)
SELECT frame, count(*) FILTER (y <= zmin + 2) AS visible, count(*) AS n FROM m GROUP BY frame""")
def z_buffer_visibility(spark, sf_dir):
    u = A.points(spark, sf_dir).select("frame", F.floor("x").alias("col"), F.floor("z").alias("row"), "y")
    near = u.groupBy("frame", "col", "row").agg(F.min("y").alias("zmin"))
    return u.join(near, ["frame", "col", "row"]).groupBy("frame").agg(F.count_if(F.col("y") <= F.col("zmin") + 2).alias("visible"), F.count("*").alias("n"))


@query(f"""WITH {_P}, t AS (SELECT frame, 0.8 * x - 0.6 * y + 1 AS x2, 0.6 * x + 0.8 * y - 2 AS y2, z + 3 AS z2 FROM points)
SELECT frame, round(avg(x2), 4) AS x2, round(avg(y2), 4) AS y2, round(avg(z2), 4) AS z2, count(*) FILTER (abs(x2 * 0.6 + y2 * 0.8 - 20) < 2) AS on_plane FROM t GROUP BY frame""")
def rigid_transform_plane(spark, sf_dir):
    x, y, z = G.transform((F.col("x"), F.col("y"), F.col("z")), ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0)), (1.0, -2.0, 3.0))
    t = A.points(spark, sf_dir).select("frame", x.alias("x2"), y.alias("y2"), z.alias("z2"))
    on = G.plane_distance((F.col("x2"), F.col("y2"), F.col("z2")), (0.6, 0.8, 0.0), -20.0) < 2
    return t.groupBy("frame").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("x2", "y2", "z2")), F.count_if(on).alias("on_plane"))


_TILES = "tiles AS (SELECT p_partkey AS id, (p_partkey % 50)::DOUBLE AS lo_x, (p_partkey % 50) + 1.0::DOUBLE AS hi_x, (p_partkey // 50) * 2.5::DOUBLE AS lo_y, (p_partkey // 50) * 2.5::DOUBLE + 2.5 AS hi_y FROM part)"


def _tiles(spark, sf_dir):
    """Every part is a tile of a regular grid of 50 columns."""
    p, q = (F.col("p_partkey") % 50).cast("double"), F.floor(F.col("p_partkey") / 50).cast("double")
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), p.alias("lo_x"), (p + 1.0).alias("hi_x"), (q * 2.5).alias("lo_y"), (q * 2.5 + 2.5).alias("hi_y"))


@query(f"""WITH {_P}, {_TILES}, m AS (SELECT id, median(t) AS u, count(*) AS n FROM (SELECT id, 20 + 100 * l_discount AS t FROM points JOIN tiles ON x BETWEEN lo_x - 0.3 AND hi_x + 0.3 AND y BETWEEN lo_y - 0.3 AND hi_y + 0.3) GROUP BY id)
SELECT t.id, round(u, 4) AS u, coalesce(n, 0) AS n_voxels, CASE WHEN n >= 3 THEN 'measured' ELSE 'none' END AS u_source FROM tiles t LEFT JOIN m USING (id)""")
def tile_median_range_join(spark, sf_dir):
    """Median over all points in each padded tile: a range join that lets a point serve several tiles."""
    tiles = _tiles(spark, sf_dir)
    hit = S.range_join(A.points(spark, sf_dir), tiles, ["x", "y"], [0.3, 0.3], [1.0, 2.5])
    m = hit.groupBy("id").agg(F.median(20 + 100 * F.col("l_discount")).alias("u"), F.count("*").alias("n"))
    return tiles.join(m, "id", "left").select("id", F.round("u", 4).alias("u"), F.coalesce("n", F.lit(0)).alias("n_voxels"), F.when(F.col("n") >= 3, "measured").otherwise("none").alias("u_source"))


@query(f"""WITH {_TILES} SELECT a.id AS src, b.id AS dst FROM tiles a JOIN tiles b ON a.id < b.id AND (
 ((abs(a.hi_x - b.lo_x) < 1e-6 OR abs(b.hi_x - a.lo_x) < 1e-6) AND least(a.hi_y, b.hi_y) - greatest(a.lo_y, b.lo_y) > 1e-6) OR
 ((abs(a.hi_y - b.lo_y) < 1e-6 OR abs(b.hi_y - a.lo_y) < 1e-6) AND least(a.hi_x, b.hi_x) - greatest(a.lo_x, b.lo_x) > 1e-6))""")
def edge_adjacency(spark, sf_dir):
    """Tiles that share an edge; a common corner does not count."""
    return tile_edges(_tiles(spark, sf_dir)).where("src < dst")


def tile_edges(tiles, tol: float = 1e-6):
    """Both directions of every shared edge: tiles meet through the coordinates that their sides lie on.

    The sides on one line meet within stretches of it as long as the mean side: a stretch holds the sides that touch it, not all of the line.
    """
    mean = tiles.agg(F.avg(F.col("hi_x") - F.col("lo_x")).alias("x"), F.avg(F.col("hi_y") - F.col("lo_y")).alias("y")).first()

    def side(axis: str, other: str):
        long = mean[other] if mean[other] and mean[other] > tol else 1.0
        cell = lambda c: F.floor(F.col(c) / long).cast("bigint")
        sides = lambda name: tiles.select(F.col("id"), F.rint(F.col(f"{name}_{axis}") / tol).cast("bigint").alias("at"), F.col(f"lo_{other}").alias("lo"), F.col(f"hi_{other}").alias("hi")).where("lo <= hi").withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))
        a, b = sides("hi").alias("a"), sides("lo").hint("merge").alias("b")
        met = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.cell") == F.col("b.cell"))).where(F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo") > tol)
        return met.select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    one = side("x", "y").unionByName(side("y", "x"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


@query(f"""WITH {_P}, s AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 20 AS y, 5.0::DOUBLE AS z FROM part), c AS (SELECT x, y, z FROM points)
SELECT s.p_partkey, count(c.x) AS n, round(min(sqrt((s.x-c.x)*(s.x-c.x) + (s.y-c.y)*(s.y-c.y) + (s.z-c.z)*(s.z-c.z))), 5) AS nearest, round(avg(c.y) + 1e-9, 2) AS mean_y
FROM s LEFT JOIN c ON abs(s.x-c.x) <= 2.0 AND sqrt((s.x-c.x)*(s.x-c.x) + (s.y-c.y)*(s.y-c.y) + (s.z-c.z)*(s.z-c.z)) <= 2.0 GROUP BY s.p_partkey""")
def radius_join_mean(spark, sf_dir):
    left = A.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"), F.lit(5.0).alias("z"))
    pairs = S.radius_places(left, A.points(spark, sf_dir).select("x", "y", "z"), 2.0)
    found = pairs.groupBy(*(F.col(f"a.{c}").alias(c) for c in "xyz")).agg(F.sum("b.n").alias("n"), F.round(F.min("d"), 5).alias("nearest"), F.round(F.sum(F.col("b.n") * F.col("b.y")) / F.sum("b.n") + 1e-9, 2).alias("mean_y"))
    return left.join(found, ["x", "y", "z"], "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), "nearest", "mean_y")


@query(f"""WITH {_P}, b AS (SELECT DISTINCT floor(x / 5)::BIGINT AS i, floor(y / 5)::BIGINT AS j, floor(z / 5)::BIGINT AS k, frame % 8 AS block FROM points), r AS (SELECT i, j, k FROM b GROUP BY ALL HAVING count(*) >= 7)
SELECT frame, count(*) AS foreground FROM points WHERE (floor(x / 5)::BIGINT, floor(y / 5)::BIGINT, floor(z / 5)::BIGINT) NOT IN (SELECT (i, j, k) FROM r) GROUP BY frame""")
def background_anti_join(spark, sf_dir):
    v = S.voxelize(A.points(spark, sf_dir), 5.0)
    back = v.select("i", "j", "k", (F.col("frame") % 8).alias("b")).distinct().groupBy("i", "j", "k").count().where("count >= 7").drop("count")
    return v.join(back, ["i", "j", "k"], "left_anti").groupBy("frame").agg(F.count("*").alias("foreground"))


@query(f"""WITH {_P}, c AS (SELECT frame, floor(x / 5)::BIGINT AS i, floor(y / 5)::BIGINT AS j FROM points GROUP BY ALL),
n AS (SELECT frame, count(*) AS n FROM c GROUP BY frame), s AS (SELECT a.frame, count(*) AS shared FROM c a JOIN c b ON b.frame = a.frame - 1 AND a.i = b.i AND a.j = b.j GROUP BY a.frame)
SELECT n.frame, round(1 - coalesce(shared, 0) / (n.n + m.n - coalesce(shared, 0)), 6) AS distance FROM n JOIN n m ON m.frame = n.frame - 1 LEFT JOIN s ON s.frame = n.frame""")
def scan_jaccard_distance(spark, sf_dir):
    c = S.voxelize(A.points(spark, sf_dir), 5.0).select("frame", "i", "j").distinct()
    n = c.groupBy("frame").agg(F.count("*").alias("n"))
    both = c.join(c.withColumn("frame", F.col("frame") + 1), ["frame", "i", "j"]).groupBy("frame").agg(F.count("*").alias("both"))
    m = n.select((F.col("frame") + 1).alias("frame"), F.col("n").alias("m"))
    b = F.coalesce("both", F.lit(0))
    return n.join(m, "frame").join(both, "frame", "left").select("frame", F.round(1 - b / (F.col("n") + F.col("m") - b), 6).alias("distance"))


@query(f"""WITH {_P}, z AS (SELECT quantile_cont(y, 0.02) AS lo, quantile_cont(y, 0.98) AS hi FROM points), h AS (SELECT band, floor(x)::BIGINT AS bin, count(*) AS n FROM points, (SELECT unnest(range(0, 10)) AS band) WHERE y >= band * 10 AND y < band * 10 + 20 GROUP BY ALL)
SELECT band::INTEGER AS band, bin, n, round((SELECT lo FROM z), 5) AS floor_y, round((SELECT hi FROM z), 5) AS ceiling_y FROM h""")
def banded_profile(spark, sf_dir):
    """Counts per bin in overlapping bands (each row serves two), with the percentile floor and ceiling."""
    p = A.points(spark, sf_dir)
    z = spread_quantiles(p, [], "y", {"floor": 0.02, "ceiling": 0.98}).select(*(F.round(n, 5).alias(f"{n}_y") for n in ("floor", "ceiling")))
    top = F.floor(F.col("y") / 10).cast("int")
    b = p.withColumn("band", F.explode(F.array(top - 1, top))).where(F.col("band").between(0, 9))
    return b.groupBy("band", F.floor("x").cast("bigint").alias("bin")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(z))


@query(f"""WITH RECURSIVE {_P}, cells AS (SELECT row_number() OVER (ORDER BY i, j) AS id, i, j FROM (SELECT floor(x / 2)::BIGINT AS i, floor(y / 2)::BIGINT AS j FROM points GROUP BY 1, 2 QUALIFY count(*) >= 1.15 * avg(count(*)) OVER ())),
e AS (SELECT a.id AS s, b.id AS d FROM cells a JOIN cells b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1),
r(s, d) AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s),
l AS (SELECT s AS id, min(d) AS comp FROM r GROUP BY s)
SELECT i, j, comp, count(*) OVER (PARTITION BY comp) AS size FROM l JOIN cells USING (id)""")
def grid_connected_components(spark, sf_dir):
    from pyspark.sql import Window

    from prismfield.operators.components import connected_components

    counts = S.voxelize(A.points(spark, sf_dir), 2.0).groupBy("i", "j").agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    cells = counts.crossJoin(F.broadcast(mean)).where(F.col("n") >= 1.15 * F.col("mean")).select("i", "j")
    cells = cells.withColumn("id", F.row_number().over(Window.orderBy("i", "j")).cast("long"))
    label = connected_components(S.neighbour_edges(cells), A.cut)
    out = cells.join(label.withColumnRenamed("node", "id"), "id", "left").select("i", "j", F.coalesce("component", "id").alias("comp"))
    return out.join(out.groupBy("comp").agg(F.count("*").alias("size")), "comp").select("i", "j", "comp", "size")


@query()
def neighbour_ring_fill(spark, sf_dir):
    """Tiles without a measurement take the mean of their neighbours, ring by ring."""
    measured = tile_median_range_join(spark, sf_dir).select("id", F.when(F.col("n_voxels") >= 60, F.col("u")).alias("value"))
    return S.ring_fill(measured, tile_edges(_tiles(spark, sf_dir)), A.stored).select("id", F.round("value", 6).alias("u"), "ring", F.when(F.col("ring") == 0, "measured").when(F.col("ring") > 0, "neighbor_fill").otherwise("none").alias("u_source"))
