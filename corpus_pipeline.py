"""Training-corpus pipeline: five stages, each written as Parquet and read again by the next.

1. language ID: documents without a language, or with less than half of their letters in it, go.
2. n-gram Jaccard join: the document with the smallest doc_id of each group of near-duplicates stays.
3. benchmark decontamination: documents with words inside a benchmark window go.
4. secret scans: found secrets are replaced in the text; n_chars follows.
5. best-fit packing: token pieces placed into sequences.

Defined edge cases
- null and empty texts go in stage 1, as they have no language; a null doc_id is kept like any other.
- extra columns, whatever their names, pass through stages 1 to 4; an empty table gives no rows.
- very long texts are read whole by every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfield.llm import decontamination, language_id, ngram_join, packing, secrets
from prismfield.llm.common import shared_dir, table

MIN_LANGUAGE_SHARE = 0.5


def _whole(docs: DataFrame, *more) -> DataFrame:
    """Text beside the whole row as one column, so that no name of a row can clash with an operator's results."""
    return docs.select(F.struct("*").alias("kept"), "text", *more)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose main language covers at least half of their letters."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.label(_whole(docs), model, ["kept"])
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)).select("kept.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of the 5-word Jaccard join: the smallest doc_id, one without id only if none has one.

    Documents without words belong to no component and stay. Rows that repeat doc_id and text count once.
    """
    found = ngram_join.jaccard_rows(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("first")).select("component", F.col("first.row").alias("first"))
    dropped = found.join(first, "component").where("row != first").select("row").distinct()
    # Few rows repeat: only these are shuffled with their texts.
    repeated = found.where(F.col("doc_id").isNotNull() | F.col("component").isNotNull()).groupBy("row").count().where("count > 1").select("row")
    kept = _whole(docs, ngram_join.row_key().alias("row")).join(dropped, "row", "left_anti")
    single = kept.join(repeated, "row", "left_anti").select("kept.*")
    return single.unionByName(kept.join(repeated, "row", "left_semi").dropDuplicates(["row"]).select("kept.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    out = decontamination.decontaminate(_whole(docs), table(spark, sf_dir, "benchmark"), keep=["kept"])
    return out.where(~F.col("contaminated")).select("kept.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts and brings n_chars up to date."""
    out = secrets.redact(docs, secrets.thresholds(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/prismfield/pipeline-{uuid.uuid4().hex}"
    # Rows are whole documents: fewer of them at a time keep Arrow batches small on both sides.
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "2000")
    try:
        for i, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
            docs = spark.read.parquet(f"{base}/{i}-{name}")
    finally:
        spark.conf.set(batch, before)
    return docs
