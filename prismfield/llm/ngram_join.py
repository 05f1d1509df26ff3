"""N-gram Jaccard self-join: size-aware heavy-light join, exact, with connected components.

Sets of word shingles (64-bit hashes) are ordered by one global order: shingles that a sample
shows to be common come last, the rest go by hash. Two sets of sizes a and b with Jaccard
likeness of at least num/den share at least `overlap(a, b)` elements, so their prefixes meet:

- light sets (size up to a boundary) enumerate all fixed-size subsets (pairs) of a prefix that
  is one element longer; two similar light sets share such a subset;
- heavy sets scan inverted lists of single prefix elements; light sets near the boundary are
  posted in them too, to be met by heavy ones.

The boundary minimises the predicted cost of both sides on a sample. Whatever the order, the
sample or the boundary, no pair is lost: they only move work.

Within a list no pairs are emitted for copies (equal sets are one class from the start) and
none that are linked already: first every class is verified against its most promising
partner only, then components are formed, and only pairs across components are left to verify.
Bucket counts of the sets (sketches) rule out most dissimilar pairs before any text is fetched.

Defined edge cases
- null or empty text, or text without words: n_shingles 0, linked with nothing, its own component.
- fewer words than a shingle: the whole sequence is one shingle.
- repeated rows (equal doc_id too) are copies of one class; null doc_ids never name a component
  unless all documents of it have none. An empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismfield.operators.components import connected_components

from .common import discard, materialize, sampled, shuffles_dropped, slices_of, tasks_for

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LONG_WORD = 64
SLICES = 4


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_BASE_INVERSE, 1 << 16)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z as a-z, in order.

    A prefix polynomial modulo 2^64 over mixed byte values gives all words at once; words beyond
    64 bytes, which could be built to collide in it, take xxhash.
    """
    if not text:
        return np.zeros(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    at = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = at[::2], at[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(b)
    up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n), _powers(_BASE_INVERSE, n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[b] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    for i in np.flatnonzero(end - start > _LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].lower())
    return h


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word k-grams; words are separated by ASCII white space, A-Z is lower-cased."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    m = min(k, n)
    out = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        out += h[i : n - m + 1 + i] * (_MULTIPLIERS[i % 8] + np.uint64(2 * (i // 8)))
    return np.unique(mix(out))


def class_key(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


class Threshold:
    """Jaccard likeness of at least num/den, in whole numbers."""

    def __init__(self, num: int = 3, den: int = 4):
        self.num, self.den = num, den

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def sizes_fit(self, small: int, large: int) -> bool:
        return self.den * small >= self.num * large

    def prefix(self, n: int, extra: int = 1) -> int:
        return min(n, n - -(-self.num * n // self.den) + extra)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        if not len(a) or not len(b):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def ordered(s: np.ndarray, common: np.ndarray, most: int) -> np.ndarray:
    """First `most` elements of a sorted set in the global order: rare ones by hash, then common ones by hash."""
    if not len(common):
        return s[:most]
    at = np.searchsorted(common, s)
    hit = common[np.minimum(at, len(common) - 1)] == s
    rare = s[~hit]
    return rare[:most] if len(rare) >= most else np.concatenate([rare, s[hit]])[:most]


def postings(s: np.ndarray, limit: Threshold, common: np.ndarray, boundary: int) -> np.ndarray:
    """Signatures of a set: its prefix in order, so that the index of an element is its place; then, if it is light, its subsets.

    Low bit 1 marks a subset of a light set; its place is of no use.
    """
    n = len(s)
    parts = [np.zeros(0, np.uint64)]
    if n > boundary or (n and limit.sizes_fit(n, boundary + 1)):
        parts.append(ordered(s, common, limit.prefix(n)) & ~np.uint64(1))
    if 2 <= n <= boundary:
        p = ordered(s, common, limit.prefix(n, 2))
        i, j = np.triu_indices(len(p), 1)
        parts.append(mix(p[i] * _MULTIPLIERS[0] + p[j] * _MULTIPLIERS[1]) | np.uint64(1))
    return np.concatenate(parts)


def common_shingles(docs: DataFrame, k: int, n_docs: int, max_docs: int, most: int) -> np.ndarray:
    """Shingles that a bounded sample shows in several documents, at most `most` of them, sorted."""

    def count(batches):
        seen: list[np.ndarray] = []
        for batch in batches:
            seen += [shingles(t, k) for t in set(batch.column(0).to_pylist())]
        values, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = n >= 2
        yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["h", "n"])

    sample = sampled(docs, "row", n_docs, max_docs, "common shingles").select("text")
    got = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).select("h").toPandas()
    return np.sort(got["h"].to_numpy(np.int64).view(np.uint64))


def list_lengths(docs: DataFrame, k: int, n_docs: int, max_docs: int, limit: Threshold, common: np.ndarray, most: int = 64) -> list[tuple[int, int, float]]:
    """(set size, classes, mean length of the lists that such a class scans) of small sets in a bounded sample."""

    def prefixes(batches):
        for batch in batches:
            sets = [s for t in set(batch.column(0).to_pylist()) if 2 <= len(s := shingles(t, k)) <= most]
            heads = [ordered(s, common, limit.prefix(len(s))) for s in sets]
            flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([len(s) for s in sets], [len(h) for h in heads]).astype(np.int64)), pa.array(flat.view(np.int64))], ["n", "h"])

    # Whatever the text, a set of at most `most` shingles has few words: the length only spares work.
    sample = sampled(docs, "row", n_docs, max_docs, "list lengths").where(F.length("text") <= 40 * most).select("text")
    got = sample.mapInArrow(prefixes, "n long, h long").toPandas()
    if not len(got):
        return []
    got["length"] = got.groupby("h")["h"].transform("size") * max(1.0, n_docs / max_docs)
    by = got.groupby("n").agg(rows=("h", "size"), length=("length", "mean"))
    return [(int(n), max(1, int(r["rows"]) // limit.prefix(int(n))), float(r["length"]) - 1) for n, r in by.iterrows()]


def choose_boundary(sizes: list[tuple[int, int, float]], limit: Threshold, most: int = 64) -> int:
    """Light-heavy boundary of least predicted cost.

    `sizes` holds (set size, number of classes, mean length of the inverted lists that a class
    of that size scans). A light class costs its number of subsets, a heavy one the lists of
    its prefix; classes just below the boundary pay their prefix as well.
    """

    def cost(x: int) -> float:
        total = 0.0
        for n, count, length in sizes:
            p, q = limit.prefix(n), limit.prefix(n, 2)
            if 2 <= n <= x:
                total += count * q * (q - 1) / 2
                if limit.sizes_fit(n, x + 1):
                    total += count * p
            elif n > x:
                total += count * p * (1 + length)
        return total

    return min(range(1, most + 1), key=lambda x: (cost(x), x))


def jaccard_components(docs: DataFrame, k: int = 5, limit: Threshold | None = None, id_col: str = "doc_id", sample_docs: int = 20_000, most_common: int = 1 << 17, asks: tuple[int, ...] = (4, 8, 16), long_list: int = 3, trace: list | None = None) -> DataFrame:
    """doc id, n_shingles, component_id (smallest id reachable by links) of every row."""
    return jaccard_rows(docs, k, limit, id_col, sample_docs, most_common, asks, long_list, trace).drop("row", "component")


def row_key(id_col: str = "doc_id"):
    """Key of a document that null ids and repeated ids have too; rows that repeat id and text share it."""
    return F.xxhash64(id_col, "text")


def jaccard_rows(docs: DataFrame, k: int = 5, limit: Threshold | None = None, id_col: str = "doc_id", sample_docs: int = 20_000, most_common: int = 1 << 17, asks: tuple[int, ...] = (4, 8, 16), long_list: int = 3, trace: list | None = None) -> DataFrame:
    """The same, with `row` (row_key) and `component`, a number of the component, null for rows without words."""
    with shuffles_dropped(docs.sparkSession):
        return _jaccard_rows(docs, k, limit, id_col, sample_docs, most_common, asks, long_list, trace)


def _jaccard_rows(docs, k, limit, id_col, sample_docs, most_common, asks, long_list, trace) -> DataFrame:
    limit = limit or Threshold()
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    # Texts are fetched again by a key of the row's own, so that null and repeated ids are served alike.
    src = docs.select(F.col(id_col).alias("id"), "text", row_key(id_col).alias("row"))

    n_docs = src.count()
    common = common_shingles(src, k, n_docs, sample_docs, most_common)
    boundary = choose_boundary(list_lengths(src, k, n_docs, sample_docs, limit, common), limit)
    shared = spark.sparkContext.broadcast(common)

    def read(batches):
        """One pass over the texts: size, class and, for the first copy that the task meets, signatures in prefix order."""
        hot, seen = shared.value, set()
        for batch in slices_of(batches):
            ns, keys, sigs, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, k)
                key = class_key(s) if len(s) else None
                ns.append(len(s))
                keys.append(key)
                # A set of one element is similar to its like only, the same class.
                first = len(s) > 1 and key not in seen
                sigs.append(postings(s, limit, hot, boundary).view(np.int64) if first else None)
                sketches.append(sketch(s) if first else None)
                if first:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "row", "n", "cls", "sigs", "sketch"])

    sets = materialize(src.mapInArrow(read, f"id {kind}, row long, n long, cls long, sigs array<long>, sketch binary"), "sets")
    meta = F.shiftleft("n", 24).bitwiseOR(F.least(F.col("place"), F.lit((1 << 24) - 1)).cast("long")).alias("meta")
    posted = sets.where(F.col("sigs").isNotNull()).select("cls", "n", F.posexplode("sigs").alias("place", "sig")).select("sig", "cls", meta)
    tasks = functools.partial(tasks_for, spark)
    # The lists are made in `SLICES` passes over the stored signatures: shuffle files hold a slice at a time.
    most = sets.agg(F.sum(F.size("sigs"))).first()[0] or 0  # rows of lists; all that comes after them is less
    in_slice = most // SLICES
    slices = []
    for i in range(SLICES):
        lists = posted.where(F.pmod(F.shiftright("sig", 1), F.lit(SLICES)) == i).repartition(tasks(in_slice), "sig").sortWithinPartitions("sig", "meta", "cls")
        slices.append(materialize(lists.mapInArrow(lambda b: _first_partners(b, limit, boundary), "sig long, cls long, meta long, partner long"), "met", in_slice))
    met = functools.reduce(DataFrame.unionByName, slices)
    names = materialize(sets.where("n > 1").groupBy("cls").agg(F.min("row").alias("rep"), F.max("sketch").alias("sketch")), "classes", n_docs)
    rows = materialize(sets.select("id", "row", "n", "cls"), "rows", n_docs)
    discard(sets)

    # Round 1: each class against the one partner with which it shares most lists.
    support = met.where(F.col("partner").isNotNull()).groupBy("cls", "partner").agg(F.count("*").alias("lists"))
    best = support.groupBy("cls").agg(F.max(F.struct("lists", "partner")).alias("b")).select(F.col("cls").alias("x"), F.col("b.partner").alias("y"))
    tried = materialize(best.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs", n_docs)
    links = [verify(tried, names, src, k, limit, most)]
    label = _components(links, most)

    # Next rounds: in one list of each class, its largest or another one by turns, the class asks up to
    # `q` partners of other components. A group of similar sets falls into one component within a few
    # turns, as in Boruvka's spanning trees, and its pairs need no look any more. Only lists longer
    # than `long_list` are worth such a turn. The last turn asks all partners in all lists that
    # still hold two components: nothing is left out. Lists of one component are never looked at again.
    lists = met.select("sig", "cls", "meta")
    changed = True
    for turn, q in enumerate(asks + (None,)):
        if changed:
            torn = _torn(lists, label, most)
            discard(lists)
            lists = torn
        left = lists
        if q is None:
            left = left.withColumn("asks", F.lit(True))
        else:
            draw = F.struct(-F.col("members") if turn % 2 == 0 else F.lit(0), F.xxhash64("sig", F.lit(turn)))
            left = left.where(F.col("members") > long_list).withColumn("asks", draw == F.min(draw).over(Window.partitionBy("cls")))
        # In the last turn a pair is not made again where both classes came from a list that they share.
        before = F.collect_list("sig").over(Window.partitionBy("cls", F.col("sig").bitwiseAND(F.lit(1))).orderBy(F.when(F.col("sig").bitwiseAND(F.lit(1)) == 0, F.col("meta")), "sig").rowsBetween(-8, -1))
        left = left.withColumn("before", before if q is None else F.expr("cast(array() as array<bigint>)"))
        left = left.select("sig", "cls", "meta", "component", "asks", "before").repartition(tasks(most), "sig").sortWithinPartitions("sig", "meta", "cls")
        pairs = left.mapInArrow(_cross_pairs(limit, boundary, q, turn), "x long, y long").distinct()
        pairs = materialize(pairs.join(tried, ["x", "y"], "left_anti"), "pairs", most)
        changed = False
        n_pairs = pairs.count()
        if not n_pairs:
            continue
        links.append(verify(pairs, names, src, k, limit, most, n_pairs))
        if trace is not None:
            trace.append((q, lists.count(), n_pairs, links[-1].count()))
        tried = tried.unionByName(pairs)
        if links[-1].limit(1).count():
            old, label, changed = label, _components(links, most), True
            discard(old)

    by_class = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id").alias("rep")).join(label.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    least = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = by_class.join(least, "component").select("cls", "component", "component_id")
    out = rows.join(found, "cls", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "row", "component")
    discard(lists, names, tried, *links)
    return out


def _components(links: list[DataFrame], most: int) -> DataFrame:
    return connected_components(functools.reduce(DataFrame.unionByName, links), lambda df, label: materialize(df, label, most), "x", "y", drop=discard)


def _torn(lists: DataFrame, label: DataFrame, most: int) -> DataFrame:
    """Rows of the lists that hold two components or more, with the list's number of members.

    Of lists with the very same members (by three sums over hashes of them) only the first in the
    global order stays: a pair that meets in one of them meets in all, and there each member
    has its earliest place, which leaves the most room for what the two may share.
    """
    named = lists.select("sig", "cls", "meta").join(label.withColumnRenamed("node", "cls"), "cls", "left")
    tagged = named.select("sig", "cls", "meta", F.coalesce("component", "cls").alias("component")).repartition(tasks_for(lists.sparkSession, most), "sig")
    place = F.col("meta").bitwiseAND(F.lit((1 << 24) - 1))
    half = F.sum(F.shiftrightunsigned(F.xxhash64("cls"), 32))
    by = tagged.groupBy("sig").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members"), half.alias("h1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("h2"), F.bit_xor(F.xxhash64("cls", F.lit(2))).alias("h3"), F.min(place).alias("at"))
    kept = by.where("a < b").groupBy("h1", "h2", "h3", "members", F.col("sig").bitwiseAND(F.lit(1)).alias("light")).agg(F.min(F.struct("at", "sig")).alias("first"))
    return materialize(tagged.join(kept.select(F.col("first.sig").alias("sig"), "members"), "sig"), "torn", most)


def _fits(limit: Threshold, boundary: int, sig: int, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Can the sets with (size, place in prefix) a, b, the first not the larger, be similar and meet in this list?"""
    if not limit.sizes_fit(a[0], b[0]):
        return False
    if sig & 1:
        return True
    if b[0] <= boundary:
        return False  # both light: they meet in a list of subsets
    return min(a[0] - a[1], b[0] - b[1]) >= limit.overlap(a[0], b[0])


def _runs(batches):
    """Rows of lists with at least two rows, streaming: (sig, cls, size, place)."""
    held, joined = None, False  # the last row, and whether it continues a list
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            cols = [np.concatenate([[h], x]) for h, x in zip(held, cols, strict=True)]
        sig, cls, meta = cols
        same = sig[1:] == sig[:-1]
        together = np.concatenate([[joined], same]) | np.concatenate([same, [False]])
        keep = np.flatnonzero(together[:-1])
        yield sig[keep].tolist(), cls[keep].tolist(), (meta[keep] >> 24).tolist(), (meta[keep] & 0xFFFFFF).tolist()
        joined = bool(same[-1]) if len(same) else joined
        held = (sig[-1], cls[-1], meta[-1])
    if held is not None and joined:
        yield [int(held[0])], [int(held[1])], [int(held[2]) >> 24], [int(held[2]) & 0xFFFFFF]


def _first_partners(batches, limit: Threshold, boundary: int, most_held: int = 100_000):
    """Rows of lists with two classes or more that fit; `partner` is the smallest set of the list that fits.

    Lists come sorted by size. Of all sets of one size only the one with the earliest place is
    remembered, so the state is bounded by the number of different sizes that fit. Rows are held
    back until two of the list fit: a list without such a pair is left out (one of more than
    `most_held` rows is kept unseen).
    """
    at, window, last, held, fit = None, [], None, [], False
    for sigs, classes, ns, places in _runs(batches):
        out = []
        for sig, cls, n, place in zip(sigs, classes, ns, places, strict=True):
            if sig != at:
                at, window, last, held, fit = sig, [], None, [], False
            if cls == last:
                continue  # a copy posted by another task
            last = cls
            while window and not limit.sizes_fit(window[0][0], n):
                window.pop(0)
            partner = next((w[2] for w in window if w[2] != cls and _fits(limit, boundary, sig, w[:2], (n, place))), None)
            held.append((sig, cls, n << 24 | place, partner))
            fit = fit or partner is not None or len(held) > most_held
            if fit:
                out += held
                held = []
            if not window or window[-1][0] != n:
                window.append((n, place, cls))
            elif place < window[-1][1]:
                window[-1] = (n, place, cls)
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sig", "cls", "meta", "partner"])


def _cross_pairs(limit: Threshold, boundary: int, q: int | None, turn: int):
    """Pairs of a list, in different components, that could be similar.

    Rows that ask get up to `q` partners of at most their size, the nearest or the smallest
    by turns; without `q` they get all of them, but those with which they share one of the last
    lists `before` this one: lists of a kind (elements, subsets) are ordered alike for all
    classes, so the pair was met in its first common list, where alone it must fit.
    """

    def run(batches):
        at, window = None, []
        for batch in batches:
            xs, ys = [], []
            for sig, cls, meta, component, asks, before in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                n, place = meta >> 24, meta & 0xFFFFFF
                if sig != at:
                    at, window = sig, []
                while window and not limit.sizes_fit(window[0][0], n):
                    window.pop(0)
                got = 0
                before = frozenset(before)
                for m, p, other, c, shared in (window if turn // 2 % 2 else reversed(window)) if asks else ():
                    if c != component and before.isdisjoint(shared) and _fits(limit, boundary, sig, (m, p), (n, place)):
                        xs.append(min(cls, other))
                        ys.append(max(cls, other))
                        got += 1
                        if got == q:
                            break
                window.append((n, place, cls, component, before))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], ["x", "y"])

    return run


def sketch(s: np.ndarray, most_bits: int = 12) -> bytes:
    """Counts of a sorted set's elements by their leading bits, one byte each, about one to two elements a count.

    Empty if a count exceeds a byte; such a sketch rules nothing out.
    """
    bits = min(most_bits, max(4, int(len(s) // 2).bit_length()))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_similar(a: bytes, b: bytes, limit: Threshold) -> bool:
    """Whether two sketches leave room for a similar pair: shared elements cannot exceed the smaller count of each bucket."""
    if not a or not b:
        return True
    u, v = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    size = int(u.sum()), int(v.sum())
    fewer = min(len(u), len(v))
    both = int(np.minimum(u.reshape(fewer, -1).sum(1), v.reshape(fewer, -1).sum(1)).sum())
    return both >= limit.overlap(*size)


def verify(pairs: DataFrame, names: DataFrame, src: DataFrame, k: int, limit: Threshold, most: int, n_pairs: int | None = None, most_pairs: int = 100_000) -> DataFrame:
    """(x, y) of the pairs of classes that are similar.

    Sketches rule most pairs out; the others are compared exactly on the texts of one row of each
    class. Up to `most_pairs` pairs (counted), the keys of their classes and rows are broadcast to
    filter the scan of the texts; beyond that the filter is a shuffled join.
    """
    def sift(batches):
        for batch in batches:
            keep = [i for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if may_be_similar(a, b, limit)]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in (0, 1, 4, 5)], ["x", "y", "rx", "ry"])

    few = (pairs.count() if n_pairs is None else n_pairs) <= most_pairs
    asked = pairs.select(F.col("x").alias("cls")).union(pairs.select("y")).distinct()
    names = names.join(F.broadcast(asked) if few else asked, "cls", "left_semi")
    side = lambda c: names.select(F.col("cls").alias(c), F.col("rep").alias(f"r{c}"), F.col("sketch").alias(f"s{c}"))
    known = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "sx", "sy", "rx", "ry")
    near = materialize(known.mapInArrow(sift, "x long, y long, rx long, ry long"), "near", most)
    ids = near.select(F.col("rx").alias("row")).union(near.select("ry")).distinct()
    ids = F.broadcast(ids) if few else ids
    # Repeated rows are one text; the partial aggregate meets them before the shuffle.
    texts = src.where(F.col("text").isNotNull()).join(ids, "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    one = near.join(texts.select(F.col("row").alias("ry"), F.col("text").alias("ty")), "ry").select("x", "y", "rx", "ty")
    two = one.join(texts.select(F.col("row").alias("rx"), F.col("text").alias("tx")), "rx").select("x", "y", "tx", "ty")

    def compare(batches):
        for batch in batches:
            rows = []
            for x, y, tx, ty in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                a, b = shingles(tx, k), shingles(ty, k)
                if class_key(a) == x and class_key(b) == y and limit.similar(a, b):  # two texts may share a row's key
                    rows.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["x", "y"])

    links = materialize(two.mapInArrow(compare, "x long, y long").distinct(), "links", most)
    discard(near)
    return links
