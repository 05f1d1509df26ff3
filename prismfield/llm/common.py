"""Shared plumbing: shared-folder tables, Arrow text scans, column safety."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

TABLES = ("documents", "pages", "benchmark", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir, or a test-only fallback."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext.getCheckpointDir()
        if made:
            return made.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="prismfield-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    return found.rstrip("/")


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for a table of so many short rows: by rows, not by a fixed count, as each task that writes costs files and processes."""
    return min(max(spark.sparkContext.defaultParallelism, -(-rows // 1_000_000)), 50_000)


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder.

    A lost executor costs a reread, not a recomputation; unlike an RDD checkpoint the table
    is compressed and later readers prune its columns. Where a bound of its `rows` is known, a
    small table is not spread over more files than that takes.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(tasks_for(spark, rows))
    path = f"{shared_dir(spark)}/prismfield/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files go as soon as the action that wrote them ends: nothing reads them again, they only take up disk."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(cleanup)
        else:
            spark.conf.set(cleanup, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(path)
            if "/prismfield/" in path:
                where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_fields(schema: StructType, more: str) -> StructType:
    """Schema with the fields of a DDL string added."""
    return StructType([*schema.fields, *_parse_datatype_string(more).fields])


def slices_of(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that few texts are Python strings at a time.

    In the end memory that was freed goes back to the system: workers are reused and outlive their tasks.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def blocks(texts: list[str | None], most_chars: int = 500_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most_chars` characters (a longer single text is its own range)."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > most_chars:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def sampled(df: DataFrame, key: str, count: int, most: int, seed: str) -> DataFrame:
    """Rows whose hashed key falls in the share most/count: about `most` rows, the same ones on every run."""
    if count <= most:
        return df
    grain = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(grain)) < F.lit(int(grain * most / count)))
