"""Importance resampling towards a target distribution, by an external sort-count of feature buckets.

Features of a text are its runs of one to `ORDER` words; a feature's bucket is the crc32 of its bytes modulo BUCKETS.

1. One pass over the texts writes packed uint16 bucket streams: a row is a block of documents, with their ids,
   the offsets of their parts and one binary of all their buckets. The texts are not read again.
2. Each block's stream is sorted and run-length encoded, the runs of a task are merged, and Spark adds up
   (bucket, count) rows. Raw and target counts, one number a bucket, give the gains.
3. A pass over the streams gathers the gains of all buckets and sums them by document with np.add.reduceat.
4. Scores add Gumbel noise made from a hash of the id, so that the highest scores are a weighted sample without
   replacement. Their ranks come from range partitions and the sizes of these; no task sees all rows.

All checksums of a block are made at once: a crc is linear over the bits of its message, so a word's is the
exclusive or of its bytes' parts, and that of a run of words is put together from those of its words.

Defined edge cases
- null or empty text, or one without words: no features, weight 0; it is never drawn.
- very long texts are taken whole; a text is one block at most, and its bytes are split in pieces of words.
- ties in the score go to the smaller id, then to the row with fewer features; a null id counts as the largest and
  hashes as an empty one. Repeated rows each have a rank. Empty tables give no rows; without target texts all
  target counts are 0. Further columns are left alone, whatever their names.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, materialize, shuffles_dropped, slices_of, tasks_for

BUCKETS = 10_000
ORDER = 3
LONG = 64  # bytes; features with a longer word are hashed one by one
_PIECE = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _register() -> np.ndarray:
    """State of the checksum's register after each byte from an empty register."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, state >> 1 ^ np.uint32(0xEDB88320), state >> 1)
    return state


_BYTE = _register()


def _zero_byte(state: np.ndarray) -> np.ndarray:
    return state >> 8 ^ _BYTE[state & 255]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a byte with so many bytes after it; of a register (by its bytes) after so many zero bytes; checksums of so many zero bytes."""
    tail = [_BYTE]
    shift = [np.stack([np.arange(256, dtype=np.uint32) << 8 * k for k in range(4)])]
    for _ in range(LONG + 1):
        tail.append(_zero_byte(tail[-1]))
        shift.append(_zero_byte(shift[-1]))
    return np.stack(tail), np.stack(shift), np.array([zlib.crc32(bytes(n)) for n in range(ORDER * (LONG + 1))], np.uint32)


def _shifted(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    table = _tables()[1]
    return table[n, 0, state & 255] ^ table[n, 1, state >> 8 & 255] ^ table[n, 2, state >> 16 & 255] ^ table[n, 3, state >> 24]


def _cuts(data: np.ndarray) -> list[int]:
    """Ends of pieces of about _PIECE bytes; none but the last stands within a word."""
    out, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and _WORD[data[end - 1]]:
            gaps = np.flatnonzero(~_WORD[data[max(at, end - 4096) : end]])
            end = max(at, end - 4096) + int(gaps[-1]) + 1 if len(gaps) else min(end + _PIECE, len(data))
        out.append(end)
        at = end
    return out


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, linear part of the checksum) of all words of texts that lie one after another and end at `ends`.

    The linear part of a word beyond LONG bytes is of no use.
    """
    tail = _tables()[0]
    found = []
    at = 0
    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]
    for end in _cuts(data):
        raw = data[at:end]
        inside = _WORD[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[inner[np.searchsorted(inner, at) : np.searchsorted(inner, end, side="right")] - at] = True
        first = inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1])
        last = inside & (~np.concatenate([inside[1:], [False]]) | edge[1:])
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(start):
            size = stop - start
            after = np.repeat(stop, size) - 1 - np.flatnonzero(inside)
            parts = tail[np.minimum(after, LONG), _LOWER[raw[inside]]]
            found.append((start + at, size, np.bitwise_xor.reduceat(parts, np.cumsum(size) - size)))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, text after text; number of features, number of words of each text)."""
    start, size, part = words(data, ends)
    zero = _tables()[2]
    n = len(start)
    until = np.searchsorted(start, ends)
    n_words = np.diff(np.concatenate([[0], until]))
    left = np.repeat(until, n_words) - np.arange(n)  # words of the text from here on
    out = np.zeros((n, ORDER), np.uint16)
    state, total, longest = part, size, size
    space = _BYTE[32]
    for k in range(ORDER):
        m = max(n - k, 0)
        if k:
            more = np.minimum(size[k:], LONG)
            state = _shifted(state[:m], more + 1) ^ _shifted(np.full(m, space, np.uint32), more) ^ part[k:]
            total, longest = total[:m] + 1 + size[k:], np.maximum(longest[:m], size[k:])
        out[:m, k] = (state ^ zero[np.minimum(total, len(zero) - 1)]) % BUCKETS
        for i in np.flatnonzero((longest > LONG) & (left[:m] > k)):
            raw = b" ".join(_LOWER[data[start[j] : start[j] + size[j]]].tobytes() for j in range(i, i + k + 1))
            out[i, k] = zlib.crc32(raw) % BUCKETS
    held = np.arange(ORDER) < left[:, None]
    n_features = sum(np.maximum(n_words - k, 0) for k in range(ORDER))
    return out[held], n_features, n_words


def streams(texts: DataFrame, id_col: str) -> DataFrame:
    """Stored blocks of texts: ids, their numbers of features and words, and one packed stream of buckets."""
    kind = texts.schema[id_col].dataType.simpleString()

    def write(batches):
        for batch in slices_of(batches):
            ids, held = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(held, 250_000):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in held[a:b]]
                buckets, n_features, n_words = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), x)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one(pa.concat_arrays([ids.slice(a, b - a)])), one(pa.array(n_features, pa.int64())), one(pa.array(n_words, pa.int64())), pa.array([buckets.astype("<u2").tobytes()], pa.binary())], ["ids", "n_features", "n_words", "stream"])

    stored = texts.select(id_col, "text").mapInArrow(write, f"ids array<{kind}>, n_features array<long>, n_words array<long>, stream binary")
    return materialize(stored, "streams")


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, count) of the runs of a stream once sorted."""
    held = np.sort(stream)
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    return held[first], np.diff(np.append(first, len(held)))


def merged_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several sorted streams as those of one: values in order, counts of equal ones added."""
    value = np.concatenate([r[0] for r in runs])
    order = np.argsort(value, kind="stable")
    value, count = value[order], np.concatenate([r[1] for r in runs])[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return value[first], np.add.reduceat(count, first) if len(first) else count


def bucket_counts(stored: DataFrame) -> np.ndarray:
    """Number of features in each bucket. A task sends one row a bucket at most, so does the whole table."""

    def count(batches):
        total = (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        for batch in batches:
            for packed in batch.column(0):
                total = merged_runs([total, run_lengths(np.frombuffer(packed.as_buffer(), "<u2"))])
        yield pa.RecordBatch.from_arrays([pa.array(total[0].astype(np.int32)), pa.array(total[1].astype(np.int64))], ["bucket", "n"])

    got = stored.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the target's to the raw share), smoothed by one a bucket."""
    s, t = float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + BUCKETS) / ((float(a) + 1) * (t + BUCKETS)))) for a, b in zip(raw, target, strict=True)], np.int64)


def weigh(stored: DataFrame, gain: np.ndarray, id_col: str) -> DataFrame:
    """(id, n_features, n_words, weight) of each text of the stored streams."""
    kind = stored.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n_features, n_words = (batch.column(j)[i].values for j in range(3))
                each = n_features.to_numpy()
                gathered = gain[np.frombuffer(batch.column(3)[i].as_buffer(), "<u2")]
                weight = np.zeros(len(each), np.int64)
                full = each > 0  # reduceat has no empty parts
                if full.any():
                    weight[full] = np.add.reduceat(gathered, (np.cumsum(each) - each)[full])
                yield pa.RecordBatch.from_arrays([ids, n_features, n_words, pa.array(weight)], [id_col, "n_features", "n_words", "weight"])

    return stored.mapInArrow(run, f"`{id_col}` {kind}, n_features long, n_words long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """floor(1000 times a Gumbel number) from the first 32 bits of a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def placed(rows: DataFrame, order: list, n_rows: int) -> DataFrame:
    """Rows with `place`, their number in the order, from 1.

    Range partitions number their rows; a partition's offset is the size of those before it, a table of one row a partition.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(tasks_for(spark, n_rows), *order).sortWithinPartitions(*order)
    held = materialize(ranged.withColumn("__n", F.monotonically_increasing_id()), "placed")
    sizes = held.groupBy(F.shiftright("__n", 33).alias("__part")).count().collect()  # one row a partition, 50,000 at most
    offsets, total = [], 0
    for part, count in sorted((r["__part"], r["count"]) for r in sizes):
        offsets.append((part, total))
        total += count
    table = F.broadcast(spark.createDataFrame(offsets, "__part long, __before long"))
    at = F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("__part", F.shiftright("__n", 33)).join(table, "__part").withColumn("place", at + F.col("__before") + 1).drop("__n", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", target_id: str = "item_id") -> DataFrame:
    """id, n_features, weight, score and rank of every document; rank is null for those that are not drawn.

    Of the documents with at least `least_words` words, `percent` in a hundred are drawn, the highest scores first.
    """
    with shuffles_dropped(docs.sparkSession):
        raw, wanted = streams(docs, id_col), streams(target, target_id)
        gain = gains(bucket_counts(raw), bucket_counts(wanted))
        scored = weigh(raw, gain, id_col).withColumn("score", F.col("weight") + noise(id_col, seed))
        held = materialize(scored, "weights")
        discard(raw, wanted)
        able = F.col("n_words") >= least_words
        n = held.where(able).count()
        draws = percent * n // 100
        ranked = placed(held.where(able), [F.desc("score"), F.asc_nulls_last(id_col), "n_features"], n)
    rank = F.when(F.col("place") <= draws, F.col("place")).alias("rank")
    names = [id_col, "n_features", "weight", "score"]
    return ranked.select(*names, rank).unionByName(held.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))
