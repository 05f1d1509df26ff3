import hashlib
import math
import random
import re
import zlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from prismfield.llm import dominance, importance, minhash
from prismfield.llm.ngram_join import Threshold, shingles

ODD = [None, "", " ", "\n", "1234 !?", "é" * 3, "word " * 3000, "a", "a", "<x> it's don't!!!  x\x85y 中文"]
DOCS = "doc_id long, text string, weight string, rank string, component_id string, n_shingles string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS)


def plain_counts(rows):
    """Per row slot, level, number of rows above and of rows they stand for, by comparing all pairs."""
    def one(sale_id, sold_at, total):
        slot = None if sold_at is None else (sold_at - datetime(1970, 1, 1)) // timedelta(hours=1)
        level = None if total is None or total != total or abs(total) >= 9e16 else math.floor(math.floor(100 * total + 0.5) / 100)
        return slot, level, 1 + (zlib.crc32(str(sale_id).encode()) % 2 if sale_id is not None else 0)

    at = [one(*r) for r in rows]
    whole = [(s, v, w) for s, v, w in at if s is not None and v is not None]
    out = []
    for (sale_id, *_), (s, v, _) in zip(rows, at, strict=True):
        above = None if s is None or v is None else [w for s2, v2, w in whole if s2 <= s and v2 > v]
        out.append((sale_id, s, v, None if above is None else len(above), None if above is None else sum(above)))
    return out


@pytest.mark.parametrize(("zone", "per_leaf", "blocks"), [("UTC", 10_000, 512), ("America/New_York", 20, 3), ("Asia/Kolkata", 7, 64)])
def test_dominance_equals_all_pairs(spark, zone, per_leaf, blocks):
    rng = random.Random(per_leaf)
    start = datetime(2024, 3, 9, 12)  # a clock change in some zones
    rows = [(rng.choice([i, i, 7, None]), start + timedelta(minutes=rng.randint(0, 4000)), rng.choice([rng.random() * 30, 5.004999, 5.995, -0.004, 12.0])) for i in range(250)]
    rows += [(i, start, 9.5) for i in range(150)]  # a third of all rows in one slot and level
    rows += [(1, None, 3.0), (2, start, None), (3, start, float("nan")), (4, start, float("inf")), (5, start, -1e300), (6, datetime(1969, 12, 31, 23, 59, 59, 999999), 1e15), (None, None, None), (8, start, 9.5), (8, start, 9.5)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "sale_id long, sold_at timestamp_ntz, total double, slot string, n_rows int").repartition(5)
        got = [tuple(r) for r in dominance.dominance(df, rows_per_leaf=per_leaf, blocks=blocks).collect()]
        empty = dominance.dominance(df.where("false")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(got, key=repr) == sorted(plain_counts(rows), key=repr) and empty == []


def test_dominance_of_one_slot_or_one_level(spark):
    start = datetime(2024, 1, 1)
    for rows in ([(i, start, float(i % 40)) for i in range(120)], [(i, start + timedelta(hours=i % 40), 3.0) for i in range(120)]):
        df = spark.createDataFrame(rows, "sale_id long, sold_at timestamp_ntz, total double")
        assert sorted(tuple(r) for r in dominance.dominance(df, rows_per_leaf=5, blocks=4).collect()) == sorted(plain_counts(rows))


def test_count_before_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 17, 64, 101):
        level, w = rng.integers(0, 9, n), rng.integers(1, 4, n)
        want = [int(sum(w[j] for j in range(i) if level[j] > level[i])) for i in range(n)]
        assert dominance.count_before(level, [w])[0].tolist() == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w)], len(w)


@pytest.mark.parametrize("piece", [1 << 20, 37])
def test_bucket_streams_equal_checksums_of_words(monkeypatch, piece):
    monkeypatch.setattr(importance, "_PIECE", piece)
    rng = random.Random(piece)
    parts = ["word", "a", "É", " ", "  ", "\n", "Zeile", "x" * 63, "x" * 64, "X" * 65, "y" * 200, "-", "'", "9", "中文", "\x7f", "\x85"]
    for _ in range(150):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        raw = [t.encode() for t in texts]
        got = importance.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64))
        want = [plain_features(t) for t in texts]
        assert got[0].tolist() == [x for f, _ in want for x in f]
        assert got[1].tolist() == [len(f) for f, _ in want] and got[2].tolist() == [n for _, n in want]


def test_run_lengths_of_blocks_merge_to_those_of_the_whole():
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 50, n).astype(np.uint16) for n in (0, 1, 300, 40)]
    value, count = importance.merged_runs([importance.run_lengths(b) for b in blocks])
    whole = np.unique(np.concatenate(blocks), return_counts=True)
    assert value.tolist() == whole[0].tolist() and count.tolist() == whole[1].tolist()


def test_resampling_equals_a_plain_version(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = list(enumerate(" ".join(rng.choices(vocabulary[: rng.choice([10, 60])], k=rng.randint(0, 60))) for _ in range(150))) + [(200 + i, t) for i, t in enumerate(ODD)]
    rows += [(7, rows[7][1]), (None, "some words without an id " * 9), (None, None), (-5, "Long " * 2000 + "z" * 300)]
    items = ["w1 w2 w3 w4", "W1 w2", None, ""]
    target = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    found = [(i, *plain_features(t)) for i, t in rows]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, f, _ in found:
        np.add.at(s, f, 1)
    for x in items:
        np.add.at(t, plain_features(x)[0], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t, strict=True)]
    scored = []
    for i, f, n in found:
        weight = sum(gain[x] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in scored if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = len(able) * 30 // 100
    want = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in scored if r[4] < 20]
    got = [tuple(r) for r in importance.resample(docs(spark, rows).repartition(4), target, percent=30).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert importance.resample(docs(spark, []), target).count() == 0
    assert importance.resample(docs(spark, rows[:3]), target.where("false")).count() == 3


def components(texts, limit):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if limit.similar(sets[i], sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sets, label


def near_copies(seed):
    """Groups of copies and near copies, a group beyond the limit to each other but near the first, and documents that share passages."""
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage = new(40)
    texts = []
    for size in (7, 30, 60, 200, 400):
        base = new(size)
        texts.append(" ".join(base))
        for _ in range(8):
            words = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, size // 60 + 1, size // 25 + 1])):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], new(1), new(2)])
            texts.append(" ".join(words))
    texts += [" ".join(new(rng.randint(5, 90)) + passage + new(rng.randint(5, 90))) for _ in range(20)]
    texts += [texts[0].upper(), texts[9] + " ", *ODD]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "slab"), [(1, 2000), (2, 3)])
def test_near_duplicates_equal_brute_force(spark, seed, slab):
    texts = near_copies(seed)
    sets, label = components(texts, Threshold(85, 100))
    first = {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    trace = []
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, list(enumerate(texts))).repartition(5), asks=(1,), slab=slab, trace=trace).collect()}
    assert got == {i: (len(sets[i]), first[label[i]], first[label[i]] == i) for i in range(len(texts))}


def test_near_duplicates_without_or_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(90)]
    near = " ".join([*words[:-1], "z"])
    rows = [(None, near), (7, " ".join(words)), (7, near), (9, "other words here"), (None, "other words here"), (None, ""), (None, None)]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == sorted([(0, 86, 7, False), (7, 86, 7, True), (7, 86, 7, True), (9, 1, 9, True), (0, 1, 9, False), (0, 0, 0, True), (0, 0, 0, True)])
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def lists_of(rng, n_lists):
    """Rows of sorted lists: (pair, class, size, signature)."""
    rows = []
    for pair in range(n_lists):
        base = rng.integers(0, 256, 64).astype(np.uint8)
        for c in range(int(rng.choice([1, 1, 2, 3, 9]))):
            sig = base.copy()
            at = rng.integers(0, 64, int(rng.choice([0, 5, 40])))
            sig[at] = rng.integers(0, 256, len(at))
            rows.append((pair, b"%016d" % (1000 * pair + c), int(rng.choice([90, 95, 100, 130, 400])), sig.tobytes()))
    return sorted(rows, key=lambda r: (r[0], r[2], r[1]))


def test_first_partners_do_not_depend_on_batches():
    rng = np.random.default_rng(3)
    limit = Threshold(85, 100)
    rows = lists_of(rng, 60)

    def run(cut):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a : a + cut], strict=True)], ["pair", "cls", "n", "sig"]) for a in range(0, len(rows), cut)]
        return [r for b in minhash._first_partners(limit, 40)(iter(batches)) for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]

    sizes = {p: sum(r[0] == p for r in rows) for p, *_ in rows}
    want = []
    for pair, cls, n, sig in rows:
        if sizes[pair] > 1:
            fit = next((r for r in rows if r[0] == pair and limit.sizes_fit(r[2], n)), None)
            agree = fit[1] != cls and (np.frombuffer(fit[3], np.uint8) == np.frombuffer(sig, np.uint8)).sum() >= 40
            want.append((pair, cls, n, sig, fit[1] if agree else None))
    assert run(10_000) == want
    for cut in (1, 2, 3, 5, 8):
        got = run(cut)
        assert [r[:4] for r in got] == [r[:4] for r in want]
        known = {(r[0], r[1]): r for r in rows}
        for g, w in zip(got, want, strict=True):  # another member may be met first where a batch begins, but it fits and agrees
            if g[4] is None:
                assert w[4] is None
            else:
                other = known[g[0], g[4]]
                assert limit.sizes_fit(other[2], g[2]) and (np.frombuffer(other[3], np.uint8) == np.frombuffer(g[3], np.uint8)).sum() >= 40


def test_a_long_list_is_dealt_by_pairs_of_slabs(spark):
    base = [f"w{i}" for i in range(120)]
    rng = random.Random(9)
    texts = [" ".join(base[:100] + [f"u{i}-{j}" for j in range(rng.choice([2, 6, 30]))]) for i in range(60)]  # all share a passage
    _, label = components(texts, Threshold(85, 100))
    want = {i: min(j for j in range(len(texts)) if label[j] == label[i]) for i in range(len(texts))}
    for slab in (5, 2000):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, list(enumerate(texts))), asks=(), slab=slab).collect()}
        assert got == want


def test_sketches_of_signatures_never_rule_out_similar_sets():
    rng = np.random.default_rng(8)
    limit = Threshold(85, 100)
    for n in (5, 40, 300, 4000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for share in (0.02, 0.07, 0.2):
            b = a.copy()
            b[rng.random(len(a)) < share] += np.uint64(1)
            b = np.unique(b)
            u, v = (np.frombuffer(minhash.sketch(x), np.uint8).astype(int) for x in (a, b))
            assert np.minimum(u, v).sum() >= len(np.intersect1d(a, b))
            if limit.similar(a, b):
                assert np.minimum(u, v).sum() * 185 >= 85 * (len(a) + len(b))
    assert minhash.sketch(np.arange(300, dtype=np.uint64)) == b""
