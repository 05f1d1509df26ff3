"""Queries op1 .. op13 and the pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, dominance, fingerprints, html_extraction, importance, language_id, licenses, minhash, ngram_join, packing, quality, secrets, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(language_id.held_out(), F.lit(False))
    model = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.label(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.detect(docs, secrets.thresholds(docs))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.merge_index(warc.write(table(spark, sf_dir, "pages")))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_dominance_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance.dominance(table(spark, sf_dir, "sales"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_secret_scans, op3_best_fit_packing, op4_quality_classifier, op5_document_fingerprints, op6_html_extraction, op7_benchmark_decontamination, op8_ngram_jaccard_join, op9_license_scans, op10_warc, op11_minhash_near_dedup, op12_importance_resampling, op13_dominance_counting, pipeline)}


def _license_sql() -> str:
    """The same units, words, bigrams, bounds and coefficient, by plain SQL over whole texts."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(name)}, {quote(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    blanks = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), " + quote("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + ")"
    size = 5 + len("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    words = lambda c: f"list_filter(string_split(lower(translate({c}, {blanks}, repeat(' ', {size}))), ' '), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
    t = licenses.THRESHOLD
    return f"""
WITH raw_templates(template, license_id, body) AS (VALUES {rows}),
templates AS (
  SELECT template, license_id, len({grams}) AS t_size, {grams} AS t_grams
  FROM (SELECT template, license_id, {words('body')} AS w FROM raw_templates)
),
known AS (SELECT list_distinct(flatten(list(t_grams))) AS every FROM templates),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
units AS (
  SELECT r, unnest(list_concat(
    string_split(text, chr(10)),
    list_filter(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10)))
  )) AS body FROM docs WHERE text IS NOT NULL
),
numbered AS (SELECT r, row_number() OVER () AS u, body FROM units WHERE length(body) >= 5),
worded AS (SELECT r, u, {words('body')} AS w FROM numbered),
grammed AS (SELECT r, u, {grams} AS g FROM worded),
near AS (SELECT r, u, g FROM grammed, known WHERE list_has_any(g, every)),
scored AS (
  SELECT r, u, license_id, max(2.0::DOUBLE * len(list_intersect(t_grams, g)) / (len(g) + t_size)) AS dice
  FROM near JOIN templates ON t_size >= len(g) * ({t} / (2 - {t}))::DOUBLE AND t_size <= len(g) * ((2 - {t}) / {t})::DOUBLE
  GROUP BY r, u, license_id
),
found AS (
  SELECT r, count(*) AS n_matches, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license_ids,
         min(struct_pack(d := -dice, l := license_id)) AS best
  FROM scored WHERE dice >= {t} GROUP BY r
)
SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(license_ids, '') AS license_ids,
       best.l AS license_id, -best.d AS dice
FROM docs LEFT JOIN found USING (r)
"""


# Unsigned crc32 of a list of bytes, from the 256 states that one byte leaves in the register.
_CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS states FROM range(256) t(i))"


def _crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, in a query over crc_table."""
    octets = f"list_transform(range(0, strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, states[xor(a & 255, b) + 1])), 4294967295)"


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _resampling_sql() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))"
    return f"""
WITH {_CRC_TABLE},
docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
items AS (SELECT {words} AS w FROM benchmark),
grams AS (SELECT r, unnest({grams}) AS f FROM docs),
held AS (SELECT r, f, count(*) AS n FROM grams GROUP BY r, f),
wanted AS (SELECT f, count(*) AS n FROM (SELECT unnest({grams}) AS f FROM items) GROUP BY f),
known AS (SELECT f, {_crc_sql('f')} % 10000 AS bucket FROM (SELECT f FROM held UNION SELECT f FROM wanted), crc_table),
raw AS (SELECT bucket, sum(n) AS s FROM held JOIN known USING (f) GROUP BY bucket),
goal AS (SELECT bucket, sum(n) AS t FROM wanted JOIN known USING (f) GROUP BY bucket),
both_ AS (SELECT bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM raw FULL JOIN goal USING (bucket)),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM both_) + 10000) / ((s + 1) * ((SELECT sum(t) FROM both_) + 10000))))::BIGINT AS g FROM both_),
weighed AS (SELECT r, sum(n * g)::BIGINT AS weight FROM held JOIN known USING (f) JOIN gain USING (bucket) GROUP BY r),
drawn AS (
  SELECT r, doc_id, len(w) AS n_words, (SELECT coalesce(sum(greatest(len(w) - k, 0)), 0) FROM range(3) t(k))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM docs LEFT JOIN weighed USING (r)
),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM drawn),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


_NEAR_DUPLICATE_SQL = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM docs
),
classes AS (SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS least FROM shingled WHERE len(s) > 0 GROUP BY s),
elements AS (SELECT c, n, hash(e) AS e FROM (SELECT c, n, unnest(s) AS e FROM classes)),
pairs AS (SELECT a.c AS x, b.c AS y, count(*) AS shared, a.n + b.n AS total FROM elements a JOIN elements b ON a.e = b.e AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 85 * (total - shared)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(c, m) AS (SELECT c, least FROM classes UNION SELECT ways.y, reach.m FROM reach JOIN ways ON ways.x = reach.c),
named AS (SELECT c, min(m) AS component_id FROM reach GROUP BY c)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(component_id, doc_id) AS kept
FROM shingled LEFT JOIN classes USING (s) LEFT JOIN named USING (c)
"""


_DOMINANCE_SQL = f"""
WITH {_CRC_TABLE},
placed AS (
  SELECT sale_id, floor(epoch(sold_at) / 3600)::BIGINT AS slot, floor(floor(100 * total + 0.5) / 100)::BIGINT AS level,
         1 + {_crc_sql('sale_id::VARCHAR')} % 2 AS n_rows
  FROM sales, crc_table
),
points AS (SELECT slot, level, count(*) AS n_sales, sum(n_rows) AS n_rows FROM placed WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY slot, level),
above AS (
  SELECT q.slot, q.level, sum(p.n_sales)::BIGINT AS n_sales, sum(p.n_rows)::BIGINT AS n_rows
  FROM points q JOIN points p ON p.slot <= q.slot AND p.level > q.level GROUP BY q.slot, q.level
)
SELECT sale_id, slot, level, CASE WHEN slot IS NOT NULL AND level IS NOT NULL THEN coalesce(a.n_sales, 0) END AS n_sales,
       CASE WHEN slot IS NOT NULL AND level IS NOT NULL THEN coalesce(a.n_rows, 0) END AS n_rows
FROM placed LEFT JOIN above a USING (slot, level)
"""

ORACLE_SQL = {
    "op9_license_scans": _license_sql(),
    "op11_minhash_near_dedup": _NEAR_DUPLICATE_SQL,
    "op12_importance_resampling": _resampling_sql(),
    "op13_dominance_counting": _DOMINANCE_SQL,
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
""",
}
