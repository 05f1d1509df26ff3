"""Views of the driver's tables as survey data (points, streams, labels); operators stay table-agnostic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Material dimension: p_type -> emissivity, solar absorptance, zone (adapter values of our own).
MATERIALS = (
    ("ECONOMY", 0.92, 0.60, "any"), ("STANDARD", 0.95, 0.70, "vertical"), ("PROMO", 0.30, 0.20, "any"),
    ("SMALL", 0.85, 0.50, "floor"), ("MEDIUM", 0.90, 0.55, "ceiling"), ("LARGE", 0.10, 0.15, "vertical"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(col: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {col})")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud of points with a total order `ord` columns and a frame key."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("frame"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.round(F.col("l_discount") * 100).alias("z"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_tax", "l_discount", "l_returnflag",
    )


POINTS_SQL = """points AS (SELECT l_suppkey AS frame, l_quantity AS x, l_extendedprice / 1000 AS y, round(l_discount * 100) AS z,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_tax, l_discount, l_returnflag FROM lineitem)"""


def materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MATERIALS, "material string, emissivity double, solar_absorptance double, zone string")


MATERIALS_SQL = "material_dim(material, emissivity, solar_absorptance, zone) AS (VALUES " + ", ".join(f"('{m}', {e}::DOUBLE, {a}::DOUBLE, '{z}')" for m, e, a, z in MATERIALS) + ")"


def thermal_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thermal observations of points: temperature, material (first word of the part type), confidence, depth."""
    p = points(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("material"))
    return p.join(part, "l_partkey").select("frame", "x", "y", "z", (20 + 100 * F.col("l_discount")).alias("t_c"), "material", (1 - F.col("l_tax")).alias("confidence"), F.col("x").alias("depth"))


THERMAL_SQL = f"""{POINTS_SQL},
thermal_obs AS (SELECT frame, x, y, z, 20 + 100 * l_discount AS t_c, split_part(p_type, ' ', 1) AS material, 1 - l_tax AS confidence, x AS depth
  FROM points JOIN part ON l_partkey = p_partkey)"""


def stream(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One event type as a time series: id, t (seconds, double), value."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(F.col("event_id").alias("id"), (epoch_us("ts") / F.lit(1e6)).alias("t"), "value", "user_id")


def stream_sql(kind: str, name: str) -> str:
    return f"{name} AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS t, value, user_id FROM events WHERE event_type = '{kind}')"


def cut(df: DataFrame, label: str) -> DataFrame:
    """End a lineage by a checkpoint in the shared folder (spark.checkpoint.dir, a local one only where unset)."""
    import tempfile

    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="prismfield-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, one of our own on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="prismfield-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """End a lineage by a table in the shared folder. It is computed once (a checkpoint computes twice), and later readers read the columns they need."""
    import uuid

    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{shared_folder(spark)}/prismfield/{label.replace(' ', '-')}-{uuid.uuid4().hex}"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")  # its shuffle files go with the write: nothing reads them again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and that nothing reads any more; others are left alone."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 2)[-2] == "prismfield":
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checked_dimension(df: DataFrame, key: str, reserved: list[str]) -> DataFrame:
    """A small dimension table whose keys are present, unique and not reserved; it raises otherwise."""
    bad = df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull() | F.col(key).isin(reserved)).limit(5).collect()
    if bad:
        raise ValueError(f"missing, repeated or reserved {key}: {[r[key] for r in bad]}")
    return df
