"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are all windows of `window` consecutive words of every item (an item with fewer
words is one window). A block of two words at the search position looks up a shift; zero
selects the bucket of windows that end in that block, and a direct comparison confirms.

Defined edge cases
- null or empty text: no words, no hits. Null items and items without words give no window.
- repeated items and windows that several items share: every item_id counts; a null item_id is left out.
- repeated documents each get their own, equal row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices_of, with_fields

#: Bytes of UTF-8 that belong to words, lower-cased; all others become blanks.
_WORD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


class Searcher:
    """Windows of one common length m: shift table by block, buckets by final block."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], m: int):
        self.m, self.block = m, min(2, m)
        self.items = windows
        self.last: set[bytes] = set()
        self.shift: dict = {}
        self.bucket: dict = {}
        far = m - self.block + 1
        for w in windows:
            for end in range(self.block, m + 1):
                key = w[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, far), m - end)
                self.last.update(w)
            self.bucket.setdefault(w[m - self.block :], {}).setdefault(w[: self.block], []).append(w)

    def find(self, text: list[bytes]):
        """(start, window) of each occurrence."""
        m, block, known, shift, far = self.m, self.block, self.last, self.shift, self.m - self.block + 1
        i, n = m - 1, len(text)
        while i < n:
            if text[i] not in known:
                i += m
                continue
            key = tuple(text[i - block + 1 : i + 1])
            step = shift.get(key, far)
            if step:
                i += step
                continue
            start = i - m + 1
            for w in self.bucket[key].get(tuple(text[start : start + block]), ()):
                if all(a == b for a, b in zip(w, text[start : i + 1], strict=True)):
                    yield start, w
            i += 1


def build(items: list[tuple[str | None, str | None]], window: int = 10) -> list[Searcher]:
    """One searcher for each window length that occurs."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for at in range(len(w) - m + 1) if m else ():
            by_length.setdefault(m, {}).setdefault(tuple(w[at : at + m]), set()).update([] if item is None else [item])
    return [Searcher(by_length[m], m) for m in sorted(by_length)]


def search(text: str | None, searchers: list[Searcher]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged word intervals inside occurrences, items found."""
    w = words(text)
    found, items = [], set()
    for s in searchers:
        for start, window in s.find(w):
            found.append((start, start + s.m))
            items |= s.items[window]
    return len(w), merge(found), items


def merge(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def item_blocks(items: DataFrame, most_bytes: int, item_col: str = "item_id"):
    """Blocks of items for broadcasting; each is about `most_bytes` of text, however large the table is."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most_bytes) or 1
    block = F.pmod(F.xxhash64("text", "item"), F.lit(n))
    for k in range(n):
        yield [(r["item"], r["text"]) for r in rows.where(block == k).collect()]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, most_bytes: int = 2 << 20, keep: list[str] | None = None, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Columns `keep` (the id by default) plus n_words, n_hit, n_items, items_sha256, contaminated.

    Items are broadcast in blocks of bounded size. One block, the usual case, is one narrow
    pass over the documents. More blocks make a pass each: what a pass found is written beside
    the text in the shared folder, so that a worker never holds more than one block.
    """
    keep = keep or [id_col]
    kept = docs.select(*keep).schema
    src = docs.select(*keep, F.col("text").alias("__text"), F.expr("cast(array() as array<bigint>)").alias("__hits"), F.expr("cast(array() as array<string>)").alias("__found"))
    context = docs.sparkSession.sparkContext
    waiting = None
    for block in item_blocks(items, most_bytes, item_col):
        if waiting is not None:
            src = materialize(src.mapInArrow(_pass(waiting, len(keep), False), with_fields(kept, "__text string, __hits array<bigint>, __found array<string>")), "decontaminated")
        waiting = context.broadcast(build(block, window))
    return src.mapInArrow(_pass(waiting, len(keep), True), with_fields(kept, COLUMNS))


def _pass(shared, kept: int, last: bool):
    def run(batches):
        searchers = shared.value
        for batch in slices_of(batches):
            names = batch.schema.names
            rows = []
            for text, hits, found in zip(*(batch.column(kept + i).to_pylist() for i in range(3)), strict=True):
                n, more, items = search(text, searchers)
                rows.append((n, merge([*zip(hits[::2], hits[1::2], strict=True), *more]), items.union(found)))
            if last:
                hit = [sum(b - a for a, b in r[1]) for r in rows]
                new = [pa.array([r[0] for r in rows], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([_digest(r[2]) for r in rows]), pa.array([h > 0 for h in hit])]
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *new], [*names[:kept], "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
            else:
                new = [pa.array([[x for ab in r[1] for x in ab] for r in rows], pa.list_(pa.int64())), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: kept + 1], *new], names)

    return run
