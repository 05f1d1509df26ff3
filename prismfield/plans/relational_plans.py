"""Scoring, set operations, dimension checks, interval joins and text sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismfield.sources import adapters as A

from .registry import query

_L = """l AS (SELECT doc_id, lang, n_chars, quality AS truth, CASE WHEN n_chars > 400 AND lang <> 'es' THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id))"""


def _labels(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return A.table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "lang", "n_chars", F.col("quality").alias("truth"), F.when((F.col("n_chars") > 400) & (F.col("lang") != "es"), 1).otherwise(0).alias("pred"))


@query(f"WITH {_L} SELECT truth, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM l GROUP BY truth")
def confusion_matrix(spark, sf_dir):
    m = _labels(spark, sf_dir).groupBy("truth").pivot("pred", [0, 1]).agg(F.count(F.lit(1)))
    return m.select("truth", F.coalesce("0", F.lit(0)).alias("pred_0"), F.coalesce("1", F.lit(0)).alias("pred_1"))


@query(f"""WITH {_L}, c AS (SELECT unnest([0, 1]) AS cls), k AS (SELECT cls, count(*) FILTER (truth = cls AND pred = cls) AS tp, count(*) FILTER (truth = cls) AS support, count(*) FILTER (pred = cls) AS predicted, sum(CASE WHEN truth = cls THEN n_chars ELSE 0 END)::BIGINT AS area FROM l, c GROUP BY cls)
SELECT cls, support, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(support + predicted, 0), 0), 6) AS f1, area FROM k""")
def precision_recall_f1(spark, sf_dir):
    l = _labels(spark, sf_dir).withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1))))
    t, p = F.col("truth") == F.col("cls"), F.col("pred") == F.col("cls")
    k = l.groupBy("cls").agg(F.count_if(t & p).alias("tp"), F.count_if(t).alias("support"), F.count_if(p).alias("predicted"), F.sum(F.when(t, F.col("n_chars")).otherwise(0)).alias("area"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return k.select("cls", "support", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "area")


@query(f"""WITH {_L}, a AS (SELECT lang, avg(n_chars) AS mean_chars, stddev_pop(n_chars) AS std_chars, count(*)::DOUBLE AS n FROM l GROUP BY lang)
SELECT lang, metric, round(value, 4) AS value FROM (UNPIVOT a ON mean_chars, std_chars, n INTO NAME metric VALUE value)""")
def metric_table_unpivot(spark, sf_dir):
    a = _labels(spark, sf_dir).groupBy("lang").agg(F.avg("n_chars").alias("mean_chars"), F.stddev_pop("n_chars").alias("std_chars"), F.count("*").cast("double").alias("n"))
    return a.unpivot("lang", ["mean_chars", "std_chars", "n"], "metric", "value").select("lang", "metric", F.round("value", 4).alias("value"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1994-01-01')
SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a""")
def key_set_operations(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    sides = li.groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("a"), F.max(F.when(F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1994-01-01'"), 1).otherwise(0)).alias("b"))
    return sides.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"), F.count_if((F.col("a") == 1) | (F.col("b") == 1)).alias("either"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"))


@query("""WITH w AS (SELECT l_suppkey AS voxel, l_returnflag AS cls, sum(1 - l_tax) AS w, count(DISTINCT l_orderkey) AS frames, count(*) AS points FROM lineitem WHERE l_quantity <= 40 GROUP BY ALL)
SELECT voxel, arg_min(cls, (-round(w, 9), cls)) AS opening_class, round(max(w) / sum(w), 6) AS agreement, sum(points)::BIGINT AS n_votes, round(coalesce(sum(w) FILTER (cls = 'A'), 0), 6) AS w_a, round(coalesce(sum(w) FILTER (cls = 'N'), 0), 6) AS w_n, round(coalesce(sum(w) FILTER (cls = 'R'), 0), 6) AS w_r FROM w GROUP BY voxel""")
def opening_votes_pivot(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").where("l_quantity <= 40")
    w = li.groupBy(F.col("l_suppkey").alias("voxel"), F.col("l_returnflag").alias("cls")).agg(F.sum(1 - F.col("l_tax")).alias("w"), F.count("*").alias("points"))
    out = w.groupBy("voxel").agg(
        F.min(F.struct((-F.round("w", 9)).alias("n"), "cls")).alias("b"), F.round(F.max("w") / F.sum("w"), 6).alias("agreement"), F.sum("points").alias("n_votes"),
        *(F.round(F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("w"))), F.lit(0.0)), 6).alias(f"w_{c.lower()}") for c in "ANR"),
    )
    return out.select("voxel", F.col("b.cls").alias("opening_class"), "agreement", "n_votes", "w_a", "w_n", "w_r")


@query("""WITH p AS (SELECT p_brand, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part)
SELECT p_brand, p_size, p_retailprice, rk FROM p WHERE rk <= 3""")
def top_k_candidates(spark, sf_dir):
    from prismfield.operators.space import top_k

    t = top_k(A.table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)
    return t.select("p_brand", "p_size", "p_retailprice", F.col("rank").cast("long").alias("rk"))


@query("""WITH b AS (SELECT p_partkey AS id, p_size AS w, p_retailprice / 100 AS h, p_type FROM part)
SELECT id, CASE WHEN w < 5 THEN 'below min width (' || w || ')' WHEN h < 9.5 THEN 'below min height' WHEN w > 45 THEN 'above max width (' || w || ')' WHEN p_type LIKE 'LARGE%' AND h > 12 THEN 'door height outside range' END AS rejected FROM b""")
def plausibility_rules(spark, sf_dir):
    """First failing rule names the reason; accepted rows have none."""
    w, h = F.col("p_size"), F.col("p_retailprice") / 100
    rule = (
        F.when(w < 5, F.format_string("below min width (%d)", w)).when(h < 9.5, "below min height").when(w > 45, F.format_string("above max width (%d)", w))
        .when(F.col("p_type").startswith("LARGE") & (h > 12), "door height outside range")
    )
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), rule.alias("rejected"))


@query("""WITH g AS (SELECT event_type AS topic, epoch_us(ts) / 1e6 AS e, lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts) AS s FROM events), w AS (SELECT topic, s, e FROM g WHERE e - s > 3600)
SELECT a.topic, round(a.s, 3) AS start_t, string_agg(DISTINCT b.topic, '+' ORDER BY b.topic) AS overlapping FROM w a JOIN w b ON a.topic <> b.topic AND a.s < b.e AND b.s < a.e GROUP BY a.topic, a.s""")
def gap_overlap_topics(spark, sf_dir):
    """Gaps of different topics that overlap in time, met through the hours that they cover."""
    t = A.epoch_us("ts") / F.lit(1e6)
    g = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), t.alias("e"), F.lag(t).over(Window.partitionBy("event_type").orderBy("ts")).alias("s")).where("e - s > 3600")
    hours = g.withColumn("hour", F.explode(F.sequence(F.floor(F.col("s") / 3600), F.floor(F.col("e") / 3600))))
    a, b = hours.alias("a"), hours.alias("b")
    met = a.join(b, F.col("a.hour") == F.col("b.hour")).where("a.topic <> b.topic AND a.s < b.e AND b.s < a.e")
    return met.groupBy("a.topic", "a.s").agg(F.array_join(F.array_sort(F.collect_set("b.topic")), "+").alias("overlapping")).select("topic", F.round("s", 3).alias("start_t"), "overlapping")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '/(\\d+)(?:[?#].*)?$', 1) AS frame_index, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def html_scrape(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"/(\d+)(?:[?#].*)?$", 1).alias("frame_index"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"))


@query("""WITH s AS (SELECT n_regionkey AS session, n_nationkey AS hall FROM nation) SELECT session, hall + 1000 * session AS hall, hall AS source_hall, dense_rank() OVER (ORDER BY session) AS session_no FROM s""")
def session_merge_offsets(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    return n.select(F.col("n_regionkey").alias("session"), (F.col("n_nationkey") + 1000 * F.col("n_regionkey")).alias("hall"), F.col("n_nationkey").alias("source_hall"), F.dense_rank().over(Window.orderBy("n_regionkey")).cast("long").alias("session_no"))


@query("""WITH v AS (SELECT vec_id, label, atan2(embedding[2], embedding[1]) AS th FROM embeddings)
SELECT label, count(*) AS n, round(atan2(avg(sin(4 * th)), avg(cos(4 * th))) / 4, 6) AS mean_angle FROM v GROUP BY label""")
def circular_mean_angle(spark, sf_dir):
    th = F.atan2(F.col("embedding")[1].cast("double"), F.col("embedding")[0].cast("double"))
    return A.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.atan2(F.avg(F.sin(4 * th)), F.avg(F.cos(4 * th))) / 4, 6).alias("mean_angle"))


@query("""SELECT o_orderpriority, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 3) AS intercept, count(*) AS n FROM orders GROUP BY o_orderpriority""")
def linear_fit(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.regr_slope("o_totalprice", "o_custkey"), 6).alias("slope"), F.round(F.regr_intercept("o_totalprice", "o_custkey"), 3).alias("intercept"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_suppkey AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT k, max(CASE WHEN rn = greatest(1, least(n, round(0.05 * n)::BIGINT)) THEN v END) AS p05, max(CASE WHEN rn = greatest(1, least(n, round(0.95 * n)::BIGINT)) THEN v END) AS p95 FROM r GROUP BY k""")
def nearest_rank_percentile(spark, sf_dir):
    w = Window.partitionBy("k")
    r = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v")).withColumn("rn", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count("*").over(w))
    pick = lambda q: F.max(F.when(F.col("rn") == F.greatest(F.lit(1), F.least("n", F.round(q * F.col("n")).cast("long"))), F.col("v")))
    return r.groupBy("k").agg(pick(0.05).alias("p05"), pick(0.95).alias("p95"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, rint_key FROM (SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 100, 0)::BIGINT AS rint_key FROM lineitem WHERE l_returnflag = 'R')),
b AS (SELECT round_even(o_totalprice * 100, 0)::BIGINT % 100000 AS rint_key, count(*) AS n FROM orders GROUP BY 1) SELECT a.rint_key % 100000 AS rint_key, count(*) AS pairs, any_value(b.n) AS n FROM a JOIN b ON a.rint_key % 100000 = b.rint_key GROUP BY 1""")
def rounded_key_join(spark, sf_dir):
    key = lambda c: F.rint(F.col(c) * 100).cast("bigint") % 100000
    a = A.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(key("l_extendedprice").alias("rint_key")).agg(F.count("*").alias("pairs"))
    b = A.table(spark, sf_dir, "orders").groupBy(key("o_totalprice").alias("rint_key")).agg(F.count("*").alias("n"))
    return a.join(b, "rint_key")


@query("""SELECT c_nationkey AS segment, min(c_custkey) AS x0, max(c_custkey) AS x1, round(avg(c_acctbal), 5) AS centroid, count(*) AS area, round(sum(c_acctbal * c_custkey) / sum(c_custkey), 5) AS weighted, md5(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey)) AS digest FROM customer GROUP BY c_nationkey""")
def segment_boxes(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("segment")).agg(
        F.min("c_custkey").alias("x0"), F.max("c_custkey").alias("x1"), F.round(F.avg("c_acctbal"), 5).alias("centroid"), F.count("*").alias("area"),
        F.round(F.sum(F.col("c_acctbal") * F.col("c_custkey")) / F.sum("c_custkey"), 5).alias("weighted"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",")).alias("digest"),
    )
