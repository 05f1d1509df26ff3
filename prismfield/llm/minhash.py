"""MinHash near-duplicates: inverted join over signature coordinates, links confirmed on full sets, connected components.

A text's set of word shingles has a signature of COORDINATES minima. Two sets of Jaccard likeness j agree in each
coordinate with probability j; a pair whose signatures agree in MATCHES coordinates or more is a candidate. At the
limit of 0.85 a pair falls below 40 of 64 with probability 2.4e-6.

- Classes: texts with the same set are one class from the start (128-bit key of the set).
- Posting: a class is posted under (coordinate, value) pairs, rare ones first in one global order. Two signatures that
  agree in t of k coordinates share one of the first k - t + 1 pairs of either, so only this prefix is posted.
- Counting: the lists are merged in order of set size; members whose sizes cannot fit are skipped by a binary search, and
  for the others all coordinates are compared at once, a byte each. Bytes agree where values do, so nothing is lost. What two sets of
  known sizes share is bounded by the counts of their elements in BUCKETS; pairs that this bound rules out are not made.
- Links: a candidate is compared exactly on the full sets. No pairs are made within a group that is linked already: first every
  class meets the smallest fitting member of each of its lists, then components are formed, then in turns each class asks a few
  members of other components, and the last turn asks all that are left. Lists of one component are never looked at again.
- A long list is dealt by pairs of slabs of about SLAB members, so that no task holds or compares more than two of them.

Defined edge cases
- null or empty text, or text without words: n_shingles 0, linked with nothing, its own component, kept.
- fewer words than a shingle: the whole sequence is one shingle. Very long texts are taken whole.
- repeated rows are copies of one class; rows that repeat the smallest id are all kept. A null id names a component only if all ids
  in it are null; such rows are kept. Ties do not arise: links depend on sets alone. An empty table gives no rows.
- further columns are left alone, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismfield.operators.components import connected_components

from .common import discard, materialize, sampled, shuffles_dropped, slices_of, tasks_for
from .ngram_join import Threshold, mix, shingles

COORDINATES = 64
MATCHES = 40
SLAB = 2000
BUCKETS = 256
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADDENDS = mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's hash over the set."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):
        np.minimum(least, (s[a : a + 2048, None] * _FACTORS + _ADDENDS).min(0), out=least)
    return least


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's elements by their leading bits, a byte each; empty, and ruling nothing out, if a count exceeds a byte."""
    counts = np.bincount((s >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def tokens(sig: np.ndarray) -> np.ndarray:
    """The (coordinate, value) pairs of a signature as 64-bit hashes."""
    return mix(sig ^ _ADDENDS)


def in_order(pairs: np.ndarray, common: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """The first `most` pairs in the global order: rare ones by value, then common ones by rank."""
    if not len(common):
        return np.sort(pairs)[:most]
    at = np.minimum(np.searchsorted(common, pairs), len(common) - 1)
    hit = common[at] == pairs
    rare = np.sort(pairs[~hit])
    return rare[:most] if len(rare) >= most else np.concatenate([rare, pairs[hit][np.argsort(rank[at[hit]])]])[:most]


def common_pairs(src: DataFrame, k: int, n_docs: int, sample_docs: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that a bounded sample shows in several texts, sorted, and their ranks by frequency. This moves work only: any order is right."""

    def count(batches):
        seen: list[np.ndarray] = []
        for batch in batches:
            seen += [tokens(signature(s)) for t in set(batch.column(0).to_pylist()) if len(s := shingles(t, k)) > 1]
        value, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

    sample = sampled(src, "h1", n_docs, sample_docs, "common pairs").select("text")
    got = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toPandas()
    value, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort([value, n])] = np.arange(len(n))
    order = np.argsort(value)
    return value[order], rank[order]


def near_duplicates(docs: DataFrame, k: int = 5, limit: Threshold | None = None, matches: int = MATCHES, id_col: str = "doc_id", sample_docs: int = 20_000, most_common: int = 1 << 17, asks: tuple[int, ...] = (4, 16), slab: int = SLAB, trace: list | None = None) -> DataFrame:
    """id, n_shingles, component_id, kept of every row. `trace` gets (partners asked, pairs, links) of each turn."""
    with shuffles_dropped(docs.sparkSession):
        return _near_duplicates(docs, k, limit or Threshold(85, 100), matches, id_col, sample_docs, most_common, asks, slab, trace)


def _near_duplicates(docs, k, limit, matches, id_col, sample_docs, most_common, asks, slab, trace) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    # A text is fetched again by two hashes of its own, so null and repeated ids are served alike.
    src = docs.select(F.col(id_col).alias("id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    n_docs = src.count()
    common, rank = common_pairs(src, k, n_docs, sample_docs, most_common)
    shared = spark.sparkContext.broadcast((common, rank))
    prefix = COORDINATES - matches + 1

    def read(batches):
        """One pass over the texts: size, class and, for the first copy that the task meets, signature and posted pairs."""
        seen: set[bytes] = set()
        for batch in slices_of(batches):
            ns, keys, sigs, posted, sketches = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, k)
                key = set_key(s) if len(s) else None
                first = len(s) > 1 and key not in seen  # a set of one element is similar to its like only
                sig = signature(s) if first else None
                ns.append(len(s))
                keys.append(key)
                sigs.append((sig & np.uint64(255)).astype(np.uint8).tobytes() if first else None)
                sketches.append(sketch(s) if first else None)
                posted.append(in_order(tokens(sig), *shared.value, prefix).view(np.int64) if first else None)
                if first:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
            made = [pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(posted, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *made], ["id", "h1", "h2", "n", "cls", "sig", "posted", "sketch"])

    sets = materialize(src.mapInArrow(read, f"id {kind}, h1 long, h2 long, n long, cls binary, sig binary, posted array<long>, sketch binary"), "sets")
    one = F.min_by(F.struct("n", "sig", "posted", "sketch", "h1", "h2"), F.struct("h1", "h2")).alias("c")
    classes = materialize(sets.where(F.col("sig").isNotNull()).groupBy("cls").agg(one).select("cls", "c.*"), "classes", n_docs)
    rows = materialize(sets.select("id", "n", "cls"), "rows", n_docs)
    discard(sets)
    names = classes.select("cls", "h1", "h2")
    most = classes.count() * prefix
    tasks = functools.partial(tasks_for, spark)

    lists = classes.select(F.explode("posted").alias("pair"), "cls", "n", "sig").repartition(tasks(most), "pair").sortWithinPartitions("pair", "n", "cls")
    met = materialize(lists.mapInArrow(_first_partners(limit, matches), "pair long, cls binary, n long, sig binary, partner binary, agree int"), "met", most)
    best = met.where(F.col("partner").isNotNull()).groupBy("cls").agg(F.max(F.struct("agree", "partner")).alias("b"))
    tried = materialize(best.select(F.least("cls", "b.partner").alias("x"), F.greatest("cls", "b.partner").alias("y")).distinct(), "pairs", n_docs)
    links = [confirm(tried, names, src, k, limit, most)]
    label = _components(links, most)

    lists, changed = met.select("pair", "cls", "n", "sig"), True
    for q in (*asks, None):
        if changed:
            torn = _torn(lists, label, classes.select("cls", "sketch"), most)
            discard(lists)
            lists = torn
        dealt = lists.withColumn("slabs", F.ceil(F.col("members") / slab)).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("slabs")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1)))
        dealt = dealt.withColumns({"a": F.least("mine", "other"), "b": F.greatest("mine", "other")}).select("pair", "a", "b", "cls", "n", "sig", "component", "mine", "sketch")
        dealt = dealt.repartition(tasks(most), "pair", "a", "b").sortWithinPartitions("pair", "a", "b", "n", "cls")
        found = dealt.mapInArrow(_cross_pairs(limit, matches, q), "asker binary, other binary, agree int")
        if q is not None:
            nearest = Window.partitionBy("asker").orderBy(F.desc("agree"), "other")
            found = found.distinct().withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= q)
        pairs = found.select(F.least("asker", "other").alias("x"), F.greatest("asker", "other").alias("y")).distinct()
        pairs = materialize(pairs.join(tried, ["x", "y"], "left_anti"), "pairs", most)
        n_pairs, changed = pairs.count(), False
        if n_pairs:
            links.append(confirm(pairs, names, src, k, limit, most, n_pairs))
            tried = tried.unionByName(pairs)
            n_links = links[-1].count()
            if trace is not None:
                trace.append((q, n_pairs, n_links))
            if n_links:
                old, label, changed = label, _components(links, most), True
                discard(old)

    by_class = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("id").alias("rep")).join(label.withColumnRenamed("node", "cls"), "cls", "left")
    by_class = by_class.select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    least = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = rows.join(by_class.join(least, "component").select("cls", "component_id"), "cls", "left")
    component_id = F.coalesce("component_id", "id")
    discard(lists, classes, tried, *links)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))


def _components(links: list[DataFrame], most: int) -> DataFrame:
    return connected_components(functools.reduce(DataFrame.unionByName, links), lambda df, label: materialize(df, label, most), "x", "y", drop=discard)


def _torn(lists: DataFrame, label: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """Rows of the lists that hold two components or more, with component, number of members and sketch.

    Of lists with the very same members (by 128 bits over hashes of them) one stays: the same pairs meet in all of them.
    """
    named = lists.select("pair", "cls", "n", "sig").join(label.withColumnRenamed("node", "cls"), "cls", "left")
    tagged = named.select("pair", "cls", "n", "sig", F.coalesce("component", "cls").alias("component"))
    by = tagged.groupBy("pair").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("cls")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("m2"))
    kept = by.where("a < b").groupBy("m1", "m2", "members").agg(F.min("pair").alias("pair")).select("pair", "members")
    return materialize(tagged.join(kept, "pair").join(sketches, "cls"), "torn", most)


def _table(column) -> np.ndarray:
    """Signatures of a batch's column as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _first_partners(limit: Threshold, matches: int):
    """Rows of lists with two members or more; `partner` is the list's smallest member whose size fits, if the signatures agree.

    Lists are streamed in order of size. What is held of one are the first members of each size that may still fit.
    """

    def run(batches):
        held, at, firsts = None, None, []  # a last row that may be alone, the list it continues, that list's (size, class, signature)
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            pair, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            stop = np.append(start[1:], len(pair))
            if stop[-1] - start[-1] == 1 and pair[-1] != at:
                held = batch.slice(len(pair) - 1, 1)
                start, stop = start[:-1], stop[:-1]
            if not len(start):
                continue
            goes_on = pair[start[0]] == at
            keep = np.flatnonzero((stop - start > 1) | (goes_on & (np.arange(len(start)) == 0)))
            if not len(keep):
                continue
            sig = _table(batch.column(3))
            classes = batch.column(1).to_pylist()
            inside = np.concatenate([np.arange(start[r], stop[r]) for r in keep]) if len(keep) < len(start) else np.arange(stop[-1])
            leader = np.repeat(start[keep], stop[keep] - start[keep])
            partner, agree = [None] * len(inside), np.zeros(len(inside), np.int32)
            fits = (limit.den * n[leader] >= limit.num * n[inside]) & (leader != inside)
            ready = np.flatnonzero(fits)
            agree[ready] = (sig[leader[ready]] == sig[inside[ready]]).sum(1)
            for i in ready[agree[ready] >= matches]:
                partner[i] = classes[leader[i]]
            place = np.cumsum(np.append(0, stop[keep] - start[keep]))
            for r, run_at in zip(keep, place, strict=False):
                a, b = start[r], stop[r]
                earlier = firsts if goes_on and r == 0 else []
                if earlier or limit.den * n[a] < limit.num * n[b - 1]:  # not all fit the first of this batch
                    known = [(m, c, s) for m, c, s in earlier]
                    for i in range(a, b):
                        while known and limit.den * known[0][0] < limit.num * n[i]:
                            known.pop(0)
                        if known:
                            count = int((known[0][2] == sig[i]).sum())
                            if known[0][1] != classes[i] and count >= matches:
                                partner[run_at + i - a], agree[run_at + i - a] = known[0][1], count
                        if not known or known[-1][0] != n[i]:
                            known.append((n[i], classes[i], sig[i].copy()))
                    if r == keep[-1]:
                        firsts = known
                elif r == keep[-1]:
                    new = np.flatnonzero(np.concatenate([[True], n[a + 1 : b] != n[a : b - 1]])) + a
                    firsts = [(n[i], classes[i], sig[i].copy()) for i in new]
            if keep[-1] == len(start) - 1 and stop[-1] == len(pair):
                at = pair[-1]
            else:
                at, firsts = None, []
            take = pa.array(inside)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(4)), pa.array(partner, pa.binary()), pa.array(agree)], ["pair", "cls", "n", "sig", "partner", "agree"])

    return run


def _cross_pairs(limit: Threshold, matches: int, q: int | None):
    """Pairs of a list (of two slabs of one) in different components whose sizes fit and whose signatures agree; the nearest `q` of each asker."""

    def pairs_of(rows: pa.Table):
        n, mine = rows.column("n").to_numpy(), rows.column("mine").to_numpy()
        two = rows.column("a")[0].as_py() != rows.column("b")[0].as_py()
        component = pc.dictionary_encode(rows.column("component").combine_chunks())
        component = (component.combine_chunks() if isinstance(component, pa.ChunkedArray) else component).indices.to_numpy()
        sig = _table(rows.column("sig"))
        low = np.searchsorted(n * limit.den, n * limit.num)  # smaller members are skipped
        held = rows.column("sketch").to_pylist()
        bounded = np.array([len(x) > 0 for x in held])
        counts_of = np.frombuffer(b"".join(x or bytes(BUCKETS) for x in held), np.uint8).reshape(-1, BUCKETS)
        askers, others, counts = [], [], []
        for i in range(1, len(n)):
            near = component[low[i] : i] != component[i]
            if two:
                near &= mine[low[i] : i] != mine[i]
            j = np.flatnonzero(near) + low[i]
            if not len(j):
                continue
            agree = (sig[j] == sig[i]).sum(1)
            fine = agree >= matches
            if fine.any() and bounded[i]:
                at = j[fine]
                shared = np.minimum(counts_of[at], counts_of[i]).sum(1, dtype=np.int64)
                fine[fine] = (shared * (limit.num + limit.den) >= limit.num * (n[at] + n[i])) | ~bounded[at]
            j, agree = j[fine], agree[fine]
            if q is not None and len(j) > q:
                top = np.argsort(-agree, kind="stable")[:q]
                j, agree = j[top], agree[top]
            askers += [i] * len(j)
            others += j.tolist()
            counts += agree.tolist()
        cls = rows.column("cls").combine_chunks()
        return cls.take(pa.array(askers, pa.int64())), cls.take(pa.array(others, pa.int64())), pa.array(counts, pa.int32())

    def run(batches):
        open_ = None  # rows of the last list of the batches so far
        names = ["asker", "other", "agree"]
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if open_ is not None:
                rows = pa.concat_tables([open_, rows]).combine_chunks()
            key = [rows.column(c).to_numpy() for c in ("pair", "a", "b")]
            start = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in key])]))
            for a, b in zip(start[:-1], start[1:], strict=True):
                if b - a > 1:
                    yield pa.RecordBatch.from_arrays(list(pairs_of(rows.slice(a, b - a))), names)
            open_ = rows.slice(start[-1])
        if open_ is not None and open_.num_rows > 1:
            yield pa.RecordBatch.from_arrays(list(pairs_of(open_)), names)

    return run


def confirm(pairs: DataFrame, names: DataFrame, src: DataFrame, k: int, limit: Threshold, most: int, n_pairs: int | None = None, most_pairs: int = 100_000) -> DataFrame:
    """(x, y) of the pairs of classes whose full sets are similar.

    Texts of one row of each class are fetched by their hashes; up to `most_pairs` pairs (counted) these are broadcast to
    filter the scan, beyond that the filter is a shuffled join.
    """
    few = (pairs.count() if n_pairs is None else n_pairs) <= most_pairs
    side = lambda c: names.select(F.col("cls").alias(c), F.col("h1").alias(f"{c}1"), F.col("h2").alias(f"{c}2"))
    known = materialize(pairs.join(side("x"), "x").join(side("y"), "y"), "known", most)
    asked = known.select(F.col("x1").alias("h1"), F.col("x2").alias("h2")).union(known.select("y1", "y2")).distinct()
    wanted = src.where(F.col("text").isNotNull()).join(F.broadcast(asked) if few else asked, ["h1", "h2"], "left_semi")
    texts = wanted.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    of = lambda c: texts.select(F.col("h1").alias(f"{c}1"), F.col("h2").alias(f"{c}2"), F.col("text").alias(f"{c}t"))
    both = known.join(of("y"), ["y1", "y2"]).join(of("x"), ["x1", "x2"]).select("x", "y", "xt", "yt")

    def compare(batches):
        last = (None, None)
        for batch in slices_of(batches, 200):
            xs, ys = [], []
            for x, y, tx, ty in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last[0] != x:
                    last = (x, shingles(tx, k))
                a, b = last[1], shingles(ty, k)
                if set_key(a) == x and set_key(b) == y and limit.similar(a, b):  # two texts may share a row's hashes
                    xs.append(x)
                    ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])

    links = materialize(both.mapInArrow(compare, "x binary, y binary").distinct(), "links", most)
    discard(known)
    return links
