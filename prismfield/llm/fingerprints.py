"""Document fingerprints from prefix polynomial hashes.

A text's code points c give prefix sums S[i] = sum of c[j] * B**j (mod P) for two moduli.
Any span's hash is S[j] - S[i] shifted to a common power, so spans compare in constant time
and longest common extensions follow by binary search. The fingerprint joins the hash of the
whole text with the smallest window hash of each of 64 slots, all read off the same arrays.

Defined edge cases
- null text counts as empty: n_chars 0 and the fingerprint of the empty text.
- texts shorter than the window have one window, the whole text; an empty text has none.
- likeness of equal fingerprints is 1, of an empty text with any other 0.
- rows with equal doc_id: ordered by text; null doc_id comes last; a single row is its own next row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, materialize

MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
WINDOW, SLOTS = 24, 64
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(which: int, n: int) -> np.ndarray:
    """B**0 .. B**(n-1) modulo P, grown by doubling."""
    have = _POWERS[which]
    p, b = np.uint64(MODULI[which]), BASES[which]
    while len(have) < n:
        step = np.uint64(pow(b, len(have), MODULI[which]))
        have = np.concatenate([have, have * step % p])
    _POWERS[which] = have
    return have[:n]


class Prefix:
    """Prefix arrays of one text; index i covers the first i code points."""

    def __init__(self, text: str):
        codes = code_points(text).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for which, p in enumerate(MODULI):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * powers(which, self.n) % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))

    def span(self, start: int, end: int, at: int) -> tuple[int, int]:
        """Hash of [start, end) shifted as if it began at `at` >= start."""
        out = []
        for which, p in enumerate(MODULI):
            d = (int(self.sums[which][end]) - int(self.sums[which][start])) % p
            out.append(d * pow(BASES[which], at - start, p) % p)
        return out[0], out[1]

    def whole(self) -> tuple[int, int, int]:
        return int(self.sums[0][-1]), int(self.sums[1][-1]), self.n

    def windows(self) -> np.ndarray:
        """Hash of every window, all shifted to the last power."""
        w = min(WINDOW, self.n)
        if not w:
            return np.zeros(0, np.uint64)
        count = self.n - w + 1
        out = np.zeros(count, np.uint64)
        for which, p in enumerate(MODULI):
            m = np.uint64(p)
            d = (self.sums[which][w:] + m - self.sums[which][:count]) % m
            # c * B**(j) -> window-relative: multiply by B**-(start)
            out = (out << np.uint64(31)) ^ d * inverse_powers(which, count) % m
        return out


_INVERSE: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def inverse_powers(which: int, n: int) -> np.ndarray:
    have = _INVERSE[which]
    p = MODULI[which]
    inv = pow(BASES[which], -1, p)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(inv, len(have), p)) % np.uint64(p)])
    _INVERSE[which] = have
    return have[:n]


def spans_equal(a: Prefix, i: int, b: Prefix, j: int, n: int) -> bool:
    """Are the n code points of `a` from i those of `b` from j (up to hash collisions)?"""
    if i + n > a.n or j + n > b.n:
        return False
    at = max(i, j)
    return a.span(i, i + n, at) == b.span(j, j + n, at)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Longest n with equal spans from i and j, by binary search over the prefix arrays."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if spans_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def fingerprint(prefix: Prefix) -> str:
    """62 hash bits and the length of the whole text, then four hex digits for each slot (`....` if empty)."""
    head = "%08x%08x%x" % prefix.whole()
    h = prefix.windows()
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (h & np.uint64(SLOTS - 1)).astype(np.int64), h >> np.uint64(6))
    empty = least == np.iinfo(np.uint64).max
    return head + ":" + "".join("...." if e else f"{v:04x}" for v, e in zip(((least ^ (least >> np.uint64(29))) & np.uint64(0xFFFF)).tolist(), empty.tolist(), strict=True))


def likeness(a: str, b: str) -> float:
    """Dice likeness of two fingerprints: 1 if equal, else from the share of slots that agree."""
    if a == b:
        return 1.0
    x, y = a.partition(":")[2], b.partition(":")[2]
    pairs = [(x[i : i + 4], y[i : i + 4]) for i in range(0, 4 * SLOTS, 4)]
    used = [p for p in pairs if p != ("....", "....")]
    j = sum(p == q for p, q in used) / len(used) if used else 0.0
    return min(2 * j / (1 + j), 0.999999)


def edit(text: str, following: str) -> str:
    """The last quarter replaced by as many code points of the following text, or by all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _finish(row: tuple, following: str, next_print: str) -> tuple:
    ident, text, prefix, own = row
    edited = edit(text, following)
    changed = Prefix(edited)
    mark = own if edited == text else fingerprint(changed)
    return (ident, prefix.n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, mark, likeness(own, mark), likeness(own, next_print), common_extension(prefix, 0, changed, 0))


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", most_rows: int = 50_000) -> DataFrame:
    """Fingerprint of every text, of its edit and its likeness to the edit and to the next document.

    Texts are shuffled once, by ranges of the id. Each range task streams its sorted rows and
    hands on only its first and last text; those join to the neighbouring range by its number.
    The driver sees the numbers of the ranges that have rows, nothing else.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-src.count() // most_rows))
    ordered = src.repartitionByRange(parts, F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last(), "text")
    id_type = pa.schema(ordered.select("id").limit(0).toArrow().schema).field("id").type

    def batch_of(rows, pid, edge):
        role, edge_rows = edge
        n = len(rows) + len(edge_rows)
        cols = [pa.array([r[0] for r in rows] + [r[0] for r in edge_rows], id_type)]
        cols += [pa.array([r[i + 1] for r in rows] + [None] * len(edge_rows), t) for i, t in enumerate(TYPES)]
        cols += [pa.array([pid] * n, pa.int32()), pa.array([None] * len(rows) + role, pa.string()), pa.array([None] * len(rows) + [r[1] for r in edge_rows], pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["id", *NAMES, "part", "edge", "text"])

    def run(batches):
        from pyspark import TaskContext

        pid, held, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            done = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = Prefix(text)
                row = (ident, text, prefix, fingerprint(prefix))
                if held:
                    done.append(_finish(held, text, row[3]))
                else:
                    first = (ident, text)
                held = row
            yield batch_of(done, pid, ([], []))
        if held:
            yield batch_of([], pid, (["first", "last"], [first, held[:2]]))

    edges = materialize(ordered.mapInArrow(run, f"id {kind}, {FIELDS}, part int, edge string, text string"), "fingerprints")
    inner = edges.where(F.col("edge").isNull()).select("id", *NAMES)
    used = sorted(r["part"] for r in edges.where("edge = 'first'").select("part").collect())
    follows = spark.createDataFrame([(p, used[(i + 1) % len(used)]) for i, p in enumerate(used)], "part int, next_part int")
    last = edges.where("edge = 'last'").select("part", "id", "text")
    first = edges.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))

    def close(batches):
        for batch in batches:
            rows = []
            for ident, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                prefix = Prefix(text)
                rows.append(_finish((ident, text, prefix, fingerprint(prefix)), following, fingerprint(Prefix(following))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(TYPES))], ["id", *NAMES])

    outer = last.join(follows, "part").join(first, "next_part").select("id", "text", "following").mapInArrow(close, f"id {kind}, {FIELDS}")
    return inner.unionByName(outer).withColumnRenamed("id", id_col)
