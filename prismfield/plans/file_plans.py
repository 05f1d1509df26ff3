"""Sources and sinks: files are written, read back through Spark and compared with the rows they came from."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from prismfield.sinks import files as W
from prismfield.sources import adapters as A
from prismfield.sources import files as R

from .registry import query

_P = A.POINTS_SQL
_F32 = "f AS (SELECT frame, count(*) AS n, round(sum(x::FLOAT::DOUBLE), 3) AS sx, round(sum(y::FLOAT::DOUBLE), 3) AS sy, round(sum(z::FLOAT::DOUBLE), 3) AS sz FROM points GROUP BY frame)"


def _cloud(spark, sf_dir):
    return A.points(spark, sf_dir).select("frame", "x", "y", "z", (F.col("l_discount") * 100).alias("v"), F.lit(1).alias("c"))


def _sums(df):
    return df.groupBy("frame").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 3).alias(f"s{c}") for c in "xyz"))


def _written(spark, df, key, suffix, encode):
    base = f"{A.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    W.write_groups(df, key, base, suffix, encode).agg(F.sum("n_bytes")).first()
    return base


@query(f"WITH {_P}, {_F32} SELECT * FROM f")
def binary_ply_round_trip(spark, sf_dir):
    """Binary PLY, one file a frame."""
    base = _written(spark, _cloud(spark, sf_dir), "frame", ".ply", W.binary_ply)
    return _sums(R.read_files(spark, base, "*.ply", "frame long, x double, y double, z double", R.parse_cloud_file))


@query(f"WITH {_P} SELECT frame, count(*) AS n, round(sum(x), 3) AS sx, round(sum(round(y, 6)), 3) AS sy, round(sum(z), 3) AS sz FROM points GROUP BY frame")
def ascii_ply_round_trip(spark, sf_dir):
    """ASCII PLY with percentile colours, renamed when whole."""
    base = _written(spark, _cloud(spark, sf_dir), "frame", ".ply", W.ascii_ply)
    return _sums(R.read_files(spark, base, "*.ply", "frame long, x double, y double, z double", R.parse_cloud_file))


@query(f"WITH {_P} SELECT frame, count(*) AS n, round(sum(x), 3) AS sx, round(sum(round(y, 6)), 3) AS sy, round(sum(z), 3) AS sz FROM points GROUP BY frame")
def ascii_pcd_round_trip(spark, sf_dir):
    """ASCII PCD with five fields."""
    base = _written(spark, _cloud(spark, sf_dir), "frame", ".pcd", W.ascii_pcd)
    return _sums(R.read_files(spark, base, "*.pcd", "frame long, x double, y double, z double", R.parse_cloud_file))


@query(f"WITH {_P}, v AS (SELECT frame, floor(x / 2) AS i, floor(y / 2) AS j, floor(z / 2) AS k, count(*) AS n FROM points GROUP BY ALL) SELECT frame, count(*) AS voxels, sum(n)::BIGINT AS points, sum((i + 0.5) * 2)::DOUBLE AS cx, -1::BIGINT AS depth FROM v GROUP BY frame")
def voxel_npz_round_trip(spark, sf_dir):
    """K5: a voxel grid with centres, counts and the sentinel depth of a metric grid."""
    base = _written(spark, _cloud(spark, sf_dir), "frame", ".npz", W.voxel_npz)
    v = R.read_files(spark, base, "*.npz", "frame long, cx double, cy double, cz double, n long, depth long", R.parse_voxels)
    return v.groupBy("frame").agg(F.count("*").alias("voxels"), F.sum("n").alias("points"), F.sum("cx").alias("cx"), F.min("depth").alias("depth"))


@query(f"WITH {_P}, m AS (SELECT frame, floor(z)::BIGINT AS r, (x % 16)::BIGINT AS c, avg(y) AS v FROM points GROUP BY ALL) SELECT frame, count(*) AS known, 256 - count(*) AS unknown, round(sum(v), 3) AS total FROM m GROUP BY frame")
def map_npy_round_trip(spark, sf_dir):
    """2-D maps by frame, unknown pixels stay unknown."""
    m = A.points(spark, sf_dir).select("frame", F.floor("z").alias("r"), (F.col("x") % 16).cast("long").alias("c"), F.col("y").alias("v"))
    base = _written(spark, m, "frame", ".npy", W.map_npy)
    p = R.read_files(spark, base, "*.npy", "frame long, r long, c long, v double", R.parse_map)
    return p.groupBy("frame").agg(F.count("v").alias("known"), (F.count("*") - F.count("v")).alias("unknown"), F.round(F.sum("v"), 3).alias("total"))


_BOX = "bx AS (SELECT l_suppkey % 20 AS room, l_partkey % 40 AS box, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem GROUP BY ALL)"


@query(f"WITH {_BOX} SELECT * FROM bx")
def boxes_json_round_trip(spark, sf_dir):
    """A JSON document of boxes per room, with a schema tag."""
    b = A.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("room"), (F.col("l_partkey") % 40).alias("box")).agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.min("l_extendedprice").alias("y0"), F.max("l_extendedprice").alias("y1"))
    base = _written(spark, b, "room", ".json", W.boxes_json)
    return R.read_files(spark, base, "*.json", "room long, box long, x0 double, y0 double, x1 double, y1 double", R.parse_boxes)


def _messages(spark, sf_dir, laser: bool):
    def run(k, pdf):
        xyz = pdf[["x", "y", "z"]].to_numpy()
        if laser:
            data = W.laser_message(xyz, np.arange(len(pdf)) * 10, pdf["line"].to_numpy(), 1_700_000_000 + int(k[0]), "laser" * (int(k[0]) % 4))
        else:
            data = W.cloud_message(np.where(xyz == 25, np.nan, xyz), 1_700_000_000 + int(k[0]), int(k[0]) * 1000)
        return pd.DataFrame({"frame": [k[0]], "data": [data]})

    p = A.points(spark, sf_dir).select("frame", "x", "y", "z", F.col("l_linenumber").alias("line"))
    return p.groupBy("frame").applyInPandas(run, "frame long, data binary")


@query(f"WITH {_P} SELECT frame, count(*) AS n, round(sum(x), 3) AS sx, round(sum(y::FLOAT::DOUBLE), 3) AS sy, round(sum(z), 3) AS sz FROM points WHERE x <> 25 AND y <> 25 AND z <> 25 GROUP BY frame")
def cloud_messages(spark, sf_dir):
    """Clouds as messages and back; points that are not finite go."""
    return _sums(R.decode_rows(_messages(spark, sf_dir, False), "data", ["frame"], "x double, y double, z double", R.parse_cloud_message))


@query(f"WITH {_P} SELECT frame, count(*) AS n, round(sum(y::FLOAT::DOUBLE), 3) AS sy, sum(l_linenumber)::BIGINT AS lines, (10 * (count(*) - 1))::BIGINT AS last_offset FROM points GROUP BY frame")
def laser_messages(spark, sf_dir):
    """S3: laser messages with a text of any length before points of 20 bytes, read from the tail with a length check."""
    d = R.decode_rows(_messages(spark, sf_dir, True), "data", ["frame"], "offset long, x double, y double, z double, line long", R.parse_laser_message)
    return d.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("y"), 3).alias("sy"), F.sum("line").alias("lines"), F.max("offset").alias("last_offset"))


@query(f"WITH {_P} SELECT DISTINCT frame, 1700000000 + frame AS seconds, frame * 1000 AS nanos FROM points")
def header_stamps(spark, sf_dir):
    """Stamps from a message's first bytes, by columns alone."""
    m = _messages(spark, sf_dir, False)
    return m.select("frame", R.little_endian(F.col("data"), 4).alias("seconds"), R.little_endian(F.col("data"), 8).alias("nanos"))


@query("""WITH r AS (SELECT user_id % 20 AS recording, event_type AS topic, epoch_us(ts) AS stamp, event_id, value, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('click', 'view'))
SELECT recording, topic, count(*) AS n, min(stamp) AS first_stamp, max(stamp) AS last_stamp, round(sum(value), 4) AS total FROM r WHERE (n - 1) % 3 = 0 GROUP BY ALL""")
def recording_topic_scan(spark, sf_dir):
    """Topics and messages of SQLite recordings, strided by topic: written in splits of bounded size, whose list says where a split's stride starts."""
    from prismfield.sources import recordings as S

    S.register(spark)
    e = A.table(spark, sf_dir, "events").where("event_type IS NOT NULL")
    m = e.select((F.col("user_id") % 20).cast("long").alias("recording"), F.col("event_type").alias("topic"), F.col("event_id").cast("long").alias("id"), A.epoch_us("ts").alias("stamp"), F.col("value").cast("string").cast("binary").alias("data"))
    base = f"{A.shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    S.sorted_for_writing(m).write.format("recording").mode("overwrite").save(base)
    got = spark.read.format("recording").options(topics="click,view", stride=3).load(base).withColumn("value", F.col("data").cast("string").cast("double"))
    return got.groupBy("recording", "topic").agg(F.count("*").alias("n"), F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT user_id, '/rig/' || replace(event_type, 'view', 'camera') AS topic, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seq FROM events WHERE event_type <> 'error'""")
def recording_conversion(spark, sf_dir):
    """Topics filtered and renamed, a sequence number per topic of a recording."""
    e = A.table(spark, sf_dir, "events").where("event_type <> 'error'")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select("user_id", F.concat(F.lit("/rig/"), F.replace("event_type", F.lit("view"), F.lit("camera"))).alias("topic"), "event_id", (F.row_number().over(w) - 1).cast("long").alias("seq"))


@query(f"WITH {_P} SELECT count(*) AS n, round(sum(x), 3) AS sx, round(sum(round(y, 6)), 3) AS sy, max(frame) AS last_frame, count(*) FILTER (l_returnflag = 'R') AS scene FROM points")
def points_csv_round_trip(spark, sf_dir):
    """Points with their class, frame and segment as CSV, sorted in files by x, y, z; matches and scene apart."""
    base = f"{A.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    p = A.points(spark, sf_dir).select("x", F.round("y", 6).alias("y"), "z", F.col("l_returnflag").alias("class"), "frame", F.col("l_partkey").alias("segment_id"))
    p = p.withColumn("part", F.when(F.col("class") == "R", "scene").otherwise("labelled"))
    p.repartitionByRange("x", "y", "z").sortWithinPartitions("part", "x", "y", "z").write.partitionBy("part").option("header", True).csv(base)
    back = spark.read.schema("x double, y double, z double, class string, frame long, segment_id long, part string").option("header", True).csv(base)
    return back.agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"), F.max("frame").alias("last_frame"), F.count_if(F.col("part") == "scene").alias("scene"))


@query("""WITH t AS (SELECT user_id, json_object('id', event_id, 'topic', event_type, 'value', round(value, 2)) AS j, event_id FROM events) SELECT user_id, count(*) AS n_triplets, sum(json_extract(j, '$.id')::BIGINT)::BIGINT AS id_sum, round(sum(json_extract(j, '$.value')::DOUBLE), 4) AS total, max(json_extract_string(j, '$.topic')) AS last_topic FROM t GROUP BY user_id""")
def sync_manifest_json(spark, sf_dir):
    """A manifest document per session (envelope and triplets), written, read by schema and exploded again."""
    base = f"{A.shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    e = A.table(spark, sf_dir, "events").select("user_id", F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("topic"), F.round("value", 2).alias("value")).alias("t"))
    m = e.groupBy("user_id").agg(F.sort_array(F.collect_list("t")).alias("triplets"))
    m.select(F.lit("manifest/1").alias("schema"), F.col("user_id").alias("session"), F.size("triplets").alias("n"), "triplets").write.json(base)
    back = spark.read.schema("schema string, session long, n long, triplets array<struct<id:long,topic:string,value:double>>").json(base).where("schema = 'manifest/1'")
    t = back.select(F.col("session").alias("user_id"), F.explode("triplets").alias("t"))
    return t.groupBy("user_id").agg(F.count("*").alias("n_triplets"), F.sum("t.id").alias("id_sum"), F.round(F.sum("t.value"), 4).alias("total"), F.max("t.topic").alias("last_topic"))


@query("""SELECT page_id, coalesce(len(regexp_extract_all(html, '<p[ >]')), 0)::BIGINT AS n_rows, coalesce(sum_len, 0)::BIGINT AS captured_chars FROM pages LEFT JOIN (SELECT page_id, sum(length(x)) AS sum_len FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS x FROM pages) GROUP BY page_id) USING (page_id)""")
def html_table_rows(spark, sf_dir):
    """Rows scraped from pages by patterns; rows and captured characters are counted."""
    p = A.table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return p.select("page_id", F.coalesce(F.regexp_count("html", F.lit("<p[ >]")), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.aggregate(links, F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)).cast("long").alias("captured_chars"))


_NAME = "strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_R' || lpad(o_orderkey::VARCHAR, 6, '0') || '.tif'"


@query(f"""WITH n AS (SELECT o_orderkey, o_orderdate, {_NAME} AS name, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 7 SECOND END AS exif, CASE WHEN o_orderstatus = 'P' THEN 'IMG.tif' ELSE {_NAME} END AS file FROM orders)
SELECT o_orderkey, epoch_us(CASE WHEN exif IS NOT NULL THEN exif WHEN regexp_matches(file, '^\\d{{8}}_\\d{{6}}_R') THEN strptime(substr(file, 1, 15), '%Y%m%d_%H%M%S') ELSE o_orderdate + INTERVAL 1 HOUR END) // 1000000 AS stamp, CASE WHEN exif IS NOT NULL THEN 'exif' WHEN regexp_matches(file, '^\\d{{8}}_\\d{{6}}_R') THEN 'filename' ELSE 'mtime' END AS source, regexp_extract(name, '(\\d+)\\.[^.]+$', 1)::BIGINT AS frame_index FROM n""")
def image_timestamps(spark, sf_dir):
    """The stamp from the picture's tag, else its file name, else the file's time, with its source; the trailing frame index."""
    o = A.table(spark, sf_dir, "orders")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit("_R"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(".tif"))
    o = o.select("o_orderkey", "o_orderdate", name.alias("name"), F.when(F.col("o_orderstatus") == "F", F.expr("o_orderdate + INTERVAL 7 SECOND")).alias("exif"), F.when(F.col("o_orderstatus") == "P", "IMG.tif").otherwise(name).alias("file"))
    named = F.when(F.col("file").rlike(r"^\d{8}_\d{6}_R"), F.to_timestamp_ntz(F.substring("file", 1, 15), F.lit("yyyyMMdd_HHmmss")))
    o = o.select("o_orderkey", "name", F.coalesce("exif", named, F.expr("o_orderdate + INTERVAL 1 HOUR")).alias("s"), F.when(F.col("exif").isNotNull(), "exif").when(named.isNotNull(), "filename").otherwise("mtime").alias("source"))
    return o.select("o_orderkey", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', s)").alias("stamp"), "source", F.regexp_extract("name", r"(\d+)\.[^.]+$", 1).cast("long").alias("frame_index"))


@query("""WITH r AS (SELECT o_custkey AS session, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT session, max(n) AS n, count(*) FILTER ((k - 1) % 5 = 0 AND (k - 1) // 5 < 20) AS pinned, count(*) FILTER ((k - 1) % ceil(n / 4.0) = 0) AS capped, count(*) FILTER (k <= 2 OR (k > n // 2 AND k <= n // 2 + 2)) AS blocks FROM r GROUP BY session""")
def frame_sampling(spark, sf_dir):
    """Frames in a three-level order; a stride-pinned sample, a stride by a cap, blocks over the whole recording."""
    w = Window.partitionBy("o_custkey")
    r = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), F.row_number().over(w.orderBy("o_orderpriority", "o_totalprice", "o_orderkey")).alias("k"), F.count("*").over(w).alias("n"))
    return r.groupBy("session").agg(F.max("n").alias("n"), F.expr("count_if((k - 1) % 5 = 0 AND (k - 1) div 5 < 20)").alias("pinned"), F.expr("count_if((k - 1) % ceil(n / 4) = 0)").alias("capped"), F.expr("count_if(k <= 2 OR (k > n div 2 AND k <= n div 2 + 2))").alias("blocks"))


@query(f"""WITH {A.MATERIALS_SQL}, g AS (SELECT p_partkey AS frame, split_part(p_type, ' ', 1) AS material, nullif(p_brand, 'Brand#11') AS note, p_size FROM part) SELECT g.frame, coalesce(note, '') AS note, emissivity, p_size::BIGINT AS size, CASE WHEN m.material IS NULL THEN 'unknown material' WHEN zone NOT IN ('any', 'floor', 'ceiling', 'vertical') THEN 'unknown zone' ELSE 'ok' END AS integrity FROM g LEFT JOIN material_dim m USING (material)""")
def ground_truth_scan(spark, sf_dir):
    """Dimension and truth tables with their guards: repeated or reserved names raise, unknown references are named, empty text fills in."""
    m = A.checked_dimension(A.materials(spark), "material", reserved=["unknown"])
    g = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("material"), F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("note"), F.col("p_size").cast("long").alias("size"))
    j = g.join(F.broadcast(m), "material", "left")
    integrity = F.when(F.col("emissivity").isNull(), "unknown material").when(~F.col("zone").isin("any", "floor", "ceiling", "vertical"), "unknown zone").otherwise("ok")
    return j.select("frame", F.coalesce("note", F.lit("")).alias("note"), "emissivity", "size", integrity.alias("integrity"))


@query("""WITH l AS (SELECT doc_id, trim(regexp_replace(line, '#.*$', '')) AS name FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)), n AS (SELECT doc_id, name FROM l WHERE name <> '') SELECT doc_id, count(*) AS names, count(DISTINCT name) AS distinct_names, count(*) > count(DISTINCT name) AS has_duplicates FROM n GROUP BY doc_id""")
def name_list_scan(spark, sf_dir):
    """A list of names, comments and blank lines stripped, with a flag for repeats."""
    l = A.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = l.select("doc_id", F.trim(F.regexp_replace("line", "#.*$", "")).alias("name")).where("name <> ''")
    g = n.groupBy("doc_id", "name").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.sum("c").alias("names"), F.count("*").alias("distinct_names"))
    return g.select("*", (F.col("names") > F.col("distinct_names")).alias("has_duplicates"))


@query("""WITH r AS (SELECT l_suppkey AS frame, list_sort(list(DISTINCT l_partkey % 23)) AS ids FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), j AS (SELECT l_suppkey AS frame, list_sort(list(DISTINCT l_partkey % 23)) AS ids FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) SELECT frame, len(r.ids)::BIGINT AS in_raster, len(j.ids)::BIGINT AS in_json, r.ids = j.ids AS consistent FROM r JOIN j USING (frame)""")
def run_frame_invariant(spark, sf_dir):
    """The ids of a frame's records must be those of its raster."""
    li = A.table(spark, sf_dir, "lineitem").where("l_linenumber <= 4").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 23).alias("id"), "l_linenumber")
    g = li.groupBy("frame").agg(F.sort_array(F.collect_set("id")).alias("r"), F.sort_array(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("id")))).alias("j"))
    return g.select("frame", F.size("r").cast("long").alias("in_raster"), F.size("j").cast("long").alias("in_json"), (F.col("r") == F.col("j")).alias("consistent"))


@query("""SELECT s_suppkey, 'OS:Surface,' || chr(10) || '  {' || s_suppkey || '},' || chr(10) || '  ' || s_name || ',' || chr(10) || '  ' || CASE s_nationkey % 3 WHEN 0 THEN 'Floor' WHEN 1 THEN 'Wall' ELSE 'RoofCeiling' END || ',' || chr(10) || '  0, 0, ' || s_nationkey || ';' || chr(10) AS object FROM supplier""")
def building_model_export(spark, sf_dir):
    """Surfaces as objects of a building model in its text form, one per row: an external exporter writes them as they are."""
    kind = F.element_at(F.array(F.lit("Floor"), F.lit("Wall"), F.lit("RoofCeiling")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return A.table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("OS:Surface,\n  {%d},\n  %s,\n  %s,\n  0, 0, %d;\n", "s_suppkey", "s_name", kind, "s_nationkey").alias("object"))


@query("""SELECT user_id % 20 AS recording, '/rig/' || replace(event_type, 'view', 'camera') AS topic, count(*) AS n, min(epoch_us(ts)) AS first_stamp, max(epoch_us(ts)) AS last_stamp, round(sum(value), 4) AS total
FROM events WHERE event_type IN ('click', 'view', 'purchase') AND ts >= TIMESTAMP '2024-01-10' GROUP BY ALL""")
def recording_rewrite(spark, sf_dir):
    """All events written as recordings in splits, converted to others with topics filtered and renamed, read back from a time on; splits are the partitions."""
    from prismfield.sources import recordings as S

    S.register(spark)
    stamp = A.epoch_us("ts").alias("stamp")
    e = A.table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL")
    m = e.select((F.col("user_id") % 20).cast("long").alias("recording"), F.concat(F.lit("/"), "event_type").alias("topic"), F.col("event_id").cast("long").alias("id"), stamp, F.col("value").cast("string").cast("binary").alias("data"))
    base = f"{A.shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    S.sorted_for_writing(m).write.format("recording").mode("overwrite").save(f"{base}/taken")
    S.convert(spark, f"{base}/taken", f"{base}/converted", ["/click", "/view", "/purchase"], {"/": "/rig/", "/view": "/rig/camera"})
    got = spark.read.format("recording").load(f"{base}/converted").where(F.col("stamp") >= 1_704_844_800_000_000)
    total = F.round(F.sum(F.col("data").cast("string").cast("double")), 4).alias("total")
    return got.groupBy("recording", "topic").agg(F.count("*").alias("n"), F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp"), total)
