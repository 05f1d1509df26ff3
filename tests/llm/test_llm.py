import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismfield.llm import decontamination as D
from prismfield.llm import fingerprints as FP
from prismfield.llm import html_extraction as H
from prismfield.llm import language_id as L
from prismfield.llm import licenses, ngram_join, packing, quality, queries, secrets, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, dice string"


def docs(spark, texts, langs=None):
    """Documents with nulls, and extra columns whose names clash with results."""
    rows = [(i, t, (langs or {}).get(i), None, len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n", "1234 !?", "é" * 3, "word " * 5000, "a", "a", "<|endoftext|> it's don't!!!  x\x85y 中文"]


def test_language_model_labels_held_out_and_mixed_text(spark):
    out = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.95
    train = docs(spark, ["the thing and that with other words " * 9, "der hund und die katze nicht schön " * 9] * 4, {i: "ed"[i % 2] for i in range(8)})
    m = L.fit(train)
    text = "the other thing with words and that thing der hund und nicht die katze schön und der hund"
    assert [s["lang"] for s in L.label_block(m, [text])[0][2]] == ["e", "d"]
    got = {r["doc_id"]: r for r in L.label(docs(spark, ODD), m, ["doc_id"]).collect()}
    assert len(got) == len(ODD) and [got[i]["lang_pred"] for i in range(5)] == ["und"] * 5 and got[7]["lang_pred"] in "ed"
    assert L.label(docs(spark, []), m, ["doc_id"]).count() == 0 and L.label_block(L.fit(docs(spark, [])), ["abc"])[0][0] == "und"


def test_viterbi_shortcut_equals_the_dynamic_program():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = np.minimum(rng.normal(-2, 3, (rng.integers(1, 30), 3)), 0)
        m = L.Model(["a", "b", "c"], np.zeros((2, 3)), None, 6.0, 6.0)
        path, free = L._labels(m, s, np.zeros(len(s), np.int64), 1), L.viterbi(s, 6.0)
        cost = lambda p: s[np.arange(len(s)), p].sum() - 6.0 * (np.diff(p) != 0).sum()
        assert cost(path) == pytest.approx(cost(free))


def _plain_spans(t):
    found = [(m.start(), m.end(), "assign") for m in re.finditer("(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def test_secret_base_spans_counts_and_digests(spark):
    rng = random.Random(8)
    parts = ["password", "Secret", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "AKIAABCDEFGHIJKLMN", "deadbeef" * 4, "0123456789abcdef", "é", "abcdefgh", "-_.", "\n", "x" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["word " * 30_000 + "token: abcdefgh1"]
    d = docs(spark, [*texts, *ODD, *ODD])
    got = {r["doc_id"]: r for r in secrets.detect(d, secrets.Limits({})).collect()}
    for i, t in enumerate([*texts, *ODD, *ODD]):
        want = _plain_spans(t or "")
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(s[2] == k for s in want) for k in ("assign", "access", "hex")]
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and got[i]["spans"] == line
    assert secrets.detect(docs(spark, []), secrets.thresholds(docs(spark, []))).count() == 0


def test_secret_battery_finds_random_runs_and_controls_false_ones(spark):
    rng = random.Random(9)
    words = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    plain = [w for t in words for w in re.findall("[A-Za-z]+", t or "")]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = ["".join(rng.choice(letters) for _ in range(n)) for n in (32, 40, 40, 64) for _ in range(10)]
    glued = ["".join(rng.choice(plain).title() for _ in range(9))[:40] for _ in range(400)]
    texts = [t or "" for t in words] + [f"see {p} there" for p in planted] + [f"see {g} there" for g in glued]
    d = docs(spark, texts)
    limits = secrets.thresholds(d)
    got = {r["doc_id"]: r["spans"] for r in secrets.detect(d, limits).collect()}
    at = len(words)
    assert sum("random" in got[at + i] for i in range(len(planted))) >= 0.9 * len(planted)
    false = sum("random" in got[at + len(planted) + i] for i in range(len(glued)))
    assert false <= 0.1 * len(planted)
    assert secrets.redact_text(texts[at + 35], limits) == "see [SECRET] there"
    assert not secrets.find("AccountKey=" + "z" * 40, limits)[1]


def test_secrets_in_key_value_form_and_beside_names():
    every = secrets.Limits({}, dict.fromkeys(range(len(secrets.LENGTHS)), 1.0))  # reports whatever fits an encoding
    key, b64 = "q8Zx7LmW2pK9vRt4YsB1nDc6", "q8Zx7LmW2pK9vRt4/sB1nDc6+A=="
    for text, secret in (
        ("aws_secret_access_key=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY x", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
        (f"AccountKey={b64};", b64),
        (f"?sig={key}&x=1", key),
        (f"a==={key}===", key + "==="),
        (f"blob_name_{b64} x", b64),
        (f"/srv/app_{key}-x/y", key),
    ):
        assert secret not in secrets.redact_text(text, every), text
        spans = [(a, b) for a, b, _ in secrets.find(text, every)[1]]
        assert any(secret in text[a:b] for a, b in spans), text
        assert not any(a <= c and d <= b for a, b in spans for c, d in spans if (a, b) != (c, d)), text
    assert secrets.find(f"x={key}", every)[1] == [(2, 26, "random_base62")]


def test_many_batteries_at_once_equal_one():
    rng = np.random.default_rng(1)
    runs = np.concatenate([rng.integers(0, 62, (20, 24)), np.zeros((1, 24), np.int64)])
    one = [-sum(np.log(max(p, 1e-300)) for p in secrets.battery(r.tolist(), 62)) for r in runs]
    assert secrets.distances(runs, 62) == pytest.approx(one)


def test_packing_is_exact_and_tight(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD[1:]
    e = packing.encoder(packing.default_tokenizer())
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    for text, ids in zip(texts, e(texts), strict=True):
        assert np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == ids
    out = packing.pack(docs(spark, texts + [None])).toPandas()
    assert out.groupby("sequence_id")["length"].sum().max() <= 4096
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 4096) + 1
    assert out[out["doc_id"] == len(texts)][["length", "piece"]].values.tolist() == [[1, 0]]
    assert packing.pack(docs(spark, [])).count() == 0
    same = packing.pack(spark.createDataFrame([(None, "one two")] * 900, "doc_id long, text string"), group=100).toPandas()
    assert len(same) == 900 and same.groupby("sequence_id")["length"].sum().max() <= 4096 and same["sequence_id"].nunique() <= 9
    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(1, 60) for _ in range(40)]
        bins = packing.pack_lengths(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(40)) and max(sum(lengths[i] for i in b) for b in bins) <= 100
        assert len(bins) <= -(-sum(lengths) // 100) + 1


def test_packing_ends_without_a_step_left():
    rng = random.Random(11)
    for _ in range(300):
        lengths = [rng.randint(20, 70) for _ in range(24)]
        bins = packing.pack_lengths(lengths, 100)
        fill = [sum(lengths[i] for i in b) for b in bins]
        if len(bins) > -(-sum(lengths) // 100):
            pairs = [(g, t) for g in range(len(bins)) for t in range(len(bins)) if g != t and fill[g] <= fill[t] < 100]
            assert not any(packing._step([list(b) for b in bins], list(fill), lengths, 100, g, t) for g, t in pairs)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(2)
    w = lambda n: " ".join(rng.choice(["aa", "bb", "Cc", "dd,", "é"]) for _ in range(n))
    items = [(1, w(12)), (2, w(3)), (10, w(30)), (None, w(4)), (5, None), (6, " ")]
    texts = [w(rng.randint(0, 60)) for _ in range(40)] + [items[0][1], "x " + items[2][1] + " y"]
    df = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    for most in (2 << 20, 60):
        got = {r["doc_id"]: r for r in D.decontaminate(docs(spark, texts), df, most_bytes=most).collect()}
        for i, t in enumerate(texts):
            words, hit, found = split(t), set(), set()
            for item, text in items:
                v = split(text)
                m = min(10, len(v))
                for a in range(len(v) - m + 1) if m else ():
                    for b in range(len(words) - m + 1):
                        if words[b : b + m] == v[a : a + m]:
                            hit |= set(range(b, b + m))
                            found |= {str(item)} - {"None"}
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(found))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r["contaminated"] == bool(hit)
    assert D.decontaminate(docs(spark, ODD), df.where("false")).where("contaminated").count() == 0


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé 🙂") for _ in range(n)) for n in (400, 300, 30, 5, 0, 200)]
    texts[1] = texts[0]
    got = FP.compare_with_next(docs(spark, [*texts, None])).orderBy("doc_id").toPandas()
    every = [*texts, ""]
    for i, t in enumerate(every):
        nxt = every[(i + 1) % len(every)]
        k = len(t) // 4
        assert got["n_chars"][i] == len(t) and got["edited_sha256"][i] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    assert got["fingerprint"][0] == got["fingerprint"][1] and got["near_next"][0] == 1 and got["near_next"][1] < 0.2 and 0.5 < got["near_edited"][0] < 1
    a, b = FP.Prefix(texts[0]), FP.Prefix("zz" + texts[0][:77] + "#")
    assert FP.common_extension(a, 0, b, 2) == 77 and FP.spans_equal(a, 5, b, 7, 50) and not FP.spans_equal(a, 0, b, 0, 3)
    assert len(FP.compare_with_next(docs(spark, ["only"])).collect()) == 1 and FP.compare_with_next(docs(spark, [])).count() == 0


def test_html_extraction(spark):
    page = "<body><header>Site</header><div id='menu'>a, b.</div><article><h1>T &amp; U</h1><p>One  <b>two</b>,\n three.<p>Four<script>if (a<b) {}</script>five.<div class='comments'><p>nice, one.</p></div></article><footer>f</footer>"
    assert H.extract(page) == "T & U\nOne two , three.\nFour\nfive." or H.extract(page) == "T & U\nOne two, three.\nFour\nfive."
    assert H.extract(None) == H.extract("") == H.extract("<nav>x</nav>") == ""
    df = spark.createDataFrame([(1, "u", None, "e"), (2, None, page, "e"), (2, None, page, "e")], "page_id long, url string, html string, text string")
    out = H.extract_pages(df).collect()
    assert len(out) == 3 and sorted(r["n_chars"] for r in out)[0] == 0


def test_html_path_ratios_decide_inside_and_outside_articles():
    prose = "A long sentence, with a comma, and another clause; it goes on for a while. Then it stops. " * 4
    links = "".join(f"<li><a href='/{i}'>Read more {i}</a></li>" for i in range(12))
    inside = H.extract(f"<body><article><h1>Title</h1><p>{prose}</p><p>{prose}</p><ul>{links}</ul></article></body>")
    assert "Read more 7" not in inside and inside.startswith("Title\n") and inside.count("A long sentence") == 8
    assert H.extract(f"<body><article><div class='article-header'><h1>Mill, river</h1></div><p>{prose}</p><p>{prose}</p></article></body>").startswith("Mill, river\n")
    marked = H.extract(f"<body><div>Home</div><div class='social-history'><p>{prose}</p><p>{prose}</p></div><ul>{links}</ul></body>")
    assert marked.count("A long sentence") == 8 and "Read more" not in marked
    ads = H.extract(f"<body><ul>{links}</ul><div class='ad'>Buy now.</div><div><p>{prose}</p><p>{prose}</p></div><div id='comments'><p>Nice, one. Really.</p></div></body>")
    assert ads.count("A long sentence") == 8 and "Buy" not in ads and "Nice" not in ads
    deep = H.extract("<div>" * 3000 + f"<p>{prose * 2000}</p>")
    assert deep.count("A long sentence") == 8000
    outside = H.extract(f"<body><article><h3><a href='/t'>Teaser</a></h3></article><div><p>{prose}</p><p>{prose}</p></div></body>")
    assert outside.count("A long sentence") == 8


def test_quality_classifier(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    even = lab.where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    out = quality.score(d, quality.train(d, even)).join(lab.select("doc_id", F.col("quality").alias("y")), "doc_id").join(even.select("doc_id"), "doc_id", "left_anti").toPandas()
    assert (out["quality"] == out["y"]).mean() > 0.85
    empty = quality.train(d, lab.where("false"))
    assert quality.score(docs(spark, ODD), empty).select("score").distinct().collect()[0]["score"] == 0.5
    assert quality.score(docs(spark, []), empty).count() == 0
    odd = quality.classify(docs(spark, ODD), lab).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    repeated = d.unionByName(d).unionByName(d.withColumn("doc_id", F.lit(None).cast("long")))
    assert quality.classify(repeated, even).groupBy("doc_id").agg(F.countDistinct("score").alias("n")).where("doc_id IS NOT NULL AND n > 1").count() == 0


def test_quality_features_and_exchange_equal_plain_ones(spark):
    texts = [None, "", "a b a", "x " * 3000, "Hello, wörld 42!"]
    dense = np.zeros((len(texts), quality.DIMS))
    for row, t in zip(dense, texts, strict=True):
        tokens = t.encode().split() if t else []
        for token in tokens:
            for slot in quality.token_slots(token):
                row[slot] += 10 / len(tokens)
    got = quality.features(docs(spark, texts)).orderBy("id").collect()
    some = quality.Features([r["n_tokens"] for r in got], *([bytes(r[c]) for r in got] for c in ("slots", "counts", "meta")))
    text, meta = some.dense()
    assert np.allclose(text, dense, rtol=1e-5)
    draw = np.random.default_rng(4)
    w, v = draw.normal(size=quality.DIMS + 1), draw.normal(size=quality.META + 1)
    a, b = some.logits(w, v)
    assert np.allclose(a, dense @ w[:-1] + w[-1], atol=1e-4) and np.allclose(b, meta @ v[:-1] + v[-1], atol=1e-4)
    # The exchange finds the surest rows of the whole corpus, each text once, none that is taken.
    d = spark.read.parquet(f"{SF}/documents.parquet")
    feats = quality.features(d.unionByName(d)).cache()
    rows = feats.dropDuplicates(["key"]).orderBy("key").toPandas()
    logits = quality.Features(rows["n_tokens"], *([bytes(x) for x in rows[c]] for c in ("slots", "counts", "meta"))).logits(w, v)
    keys = rows["key"].to_numpy()
    taken = keys[::7]
    found = quality.surest(feats, (w, v), taken, 5, 0.6)
    assert not found["key"].isin(taken).any()
    for view in (0, 1):
        for good in (False, True):
            m = logits[view] if good else -logits[view]
            want = [k for x, k in sorted(zip(-m, keys, strict=True)) if -x >= np.log(0.6 / 0.4) and k not in taken][:5]
            assert found[(found["view"] == view) & (found["good"] == good)]["key"].tolist()[:5] == want
    feats.unpersist()


def test_sketches_never_rule_out_similar_sets():
    draw, limit = np.random.default_rng(3), ngram_join.Threshold()
    for n in (2, 9, 40, 700, 9000):
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for share in (0.0, 0.5, 0.86, 0.95, 1.0):
            kept = a[: int(len(a) * share)]
            b = np.unique(np.concatenate([kept, draw.integers(0, 1 << 63, len(a) - len(kept), dtype=np.uint64)]))
            if limit.similar(a, b):
                assert ngram_join.may_be_similar(ngram_join.sketch(a), ngram_join.sketch(b), limit)


def test_word_hashes_follow_words():
    seen = {}
    for text in ("A b\x1c c\t", " x" * 3, "é É " + "q" * 70 + " " + "Q" * 70, "", "\n ", "\u3000a a"):
        words = text.encode().lower().split()
        hashes = ngram_join.word_hashes(text).tolist()
        assert len(words) == len(hashes)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (40, 40, 12, 9, 7, 120)]
    texts = []
    for b in base:
        for _ in range(12):
            v = list(b)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            texts.append(" ".join(v))
    texts += ["a b", "A B", "a c", *ODD]
    limit = ngram_join.Threshold()
    sets = [ngram_join.shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if limit.similar(sets[i], sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    first = {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    for boundary in (1, 8, 64):
        old, ngram_join.choose_boundary = ngram_join.choose_boundary, lambda *a, **k: boundary
        try:
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts), asks=(2,), long_list=2).collect()}
        finally:
            ngram_join.choose_boundary = old
        assert got == {i: (len(sets[i]), first[label[i]]) for i in range(len(texts))}


def test_ngram_join_links_rows_without_or_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:i], "z", *words[i + 1 :]]) for i in (0, 59)]
    rows = [(None, near[0]), (7, " ".join(words)), (7, near[1]), (9, "other words here"), (None, "other words here"), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in ngram_join.jaccard_components(df).collect())
    assert got == sorted([(0, 56, 7), (7, 56, 7), (7, 56, 7), (9, 1, 9), (0, 1, 9), (0, 0, 0), (0, 0, 0)])


def test_ngram_join_lists_with_the_same_members_are_read_once(spark):
    rows = [(s, c, 30 << 24 | p) for s, p in ((10, 0), (12, 1), (14, 2)) for c in (1, 2, 3)] + [(16, 1, 30 << 24 | 3), (16, 2, 30 << 24 | 3), (18, 3, 30 << 24)]
    lists = spark.createDataFrame(rows, "sig long, cls long, meta long")
    torn = ngram_join._torn(lists, spark.createDataFrame([(2, 1), (1, 1)], "node long, component long"), 12)
    assert sorted((r["sig"], r["cls"], r["members"]) for r in torn.collect()) == [(10, 1, 3), (10, 2, 3), (10, 3, 3)]


def test_licences(spark):
    t = "Some prose here.\nReleased under the MIT License!\nand  more"
    out = {r["doc_id"]: r for r in licenses.summarise(docs(spark, [t, "released under mit license terms of the people", *ODD, "x\n\nThis work is licensed under\nthe GNU General Public License,\nversion 3.\n\ny"])).collect()}
    assert (out[0]["n_matches"], out[0]["license_ids"], out[0]["dice"]) == (1, "MIT", 1.0)
    assert out[1]["n_matches"] == 0 and out[2]["license_id"] is None and out[2 + len(ODD)]["license_ids"] == "GPL-3.0"
    assert licenses.summarise(docs(spark, [])).count() == 0


def test_licences_with_neighbours_in_their_unit(spark):
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    prose = "words of no licence " * 40
    texts = [
        "This project is released under the MIT License.", "Copyright (c) 2020 Jane Doe. Licensed under the Apache License, Version 2.0.", gpl,
        f"{prose}Licensed under CC BY 4.0. {prose}Licensed under CC BY 4.0. Released under the MIT License. {prose}", "Released under the MIT License.\n" + prose + " Licensed under the MIT License.", prose,
    ]
    out = {r["doc_id"]: (r["n_matches"], r["license_ids"]) for r in licenses.summarise(docs(spark, texts)).collect()}
    assert (out[0], out[1], out[3], out[4], out[5]) == ((1, "MIT"), (1, "Apache-2.0"), (3, "CC-BY-4.0,MIT"), (2, "MIT"), (0, ""))
    assert "GPL-3.0" in out[2][1].split(",")


def test_warc_round_trip(spark):
    rng = random.Random(7)
    runs = [sorted(rng.choices(range(50), k=rng.randint(0, 9))) for _ in range(7)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
    long = "ü" * 80
    rows = [(3, "http://www.b.org/x?q#f", long), (1, "http://a.org:8080/", long), (2, None, "short"), (4, "bad:// [", "short"), (5, "http://a.org/", None), (6, "http://b.org/x?q", long), (6, "http://b.org/x?q", long)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string")
    index = warc.merge_index(warc.write(df), per_range=2)
    keys = [(r["url_key"], r["captured"]) for r in index.orderBy("part", "position").collect()]
    assert keys == sorted(keys) and len(keys) == len(rows)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc.read(index).collect())
    data = {p: (h or "").encode() for p, _, h in rows}
    refers = {3: 1, 6: 1}
    want = sorted((p, len(data[p]), hashlib.sha256(data[p]).hexdigest(), "revisit" if p in refers else "response", refers.get(p, 0)) for p, _, _ in rows)
    assert got == want
    assert warc.read(warc.merge_index(warc.write(df.where("false")))).count() == 0
    huge = [10**18, -(10**18), 2**63 - 1, -(2**63)]
    odd = spark.createDataFrame([(p, "http://a.org/", "x") for p in huge], "page_id long, url string, html string")
    assert sorted(r["page_id"] for r in warc.read(warc.merge_index(warc.write(odd))).collect()) == sorted(huge)


def test_pipeline_keeps_columns_and_takes_effect(spark):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        now = spark.createDataFrame(out.toPandas(), d.schema)
        if name == "ngram_jaccard_join":
            assert {r["doc_id"] for r in now.collect()} == {r["component_id"] for r in ngram_join.jaccard_components(d).collect()}
        if name == "benchmark_decontamination":
            assert not D.decontaminate(now, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
        if name == "secret_scans":
            assert secrets.detect(now, secrets.Limits({})).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] == 0
        d = now
    assert P.STAGES[-1][1](spark, d, SF).select("doc_id").distinct().count() == d.count()


def test_pipeline_edge_cases(spark, tmp_path):
    import corpus_pipeline as P

    extra = "score string, contaminated string, spans string, lang_pred string, n_words long, kept string, row long, component long"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    some = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and n_chars > 400").limit(6).collect()]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t), "a", "b", "c", "d", 1, "e", 2, 3) for i, t in enumerate(some)]
    rows += [(None, some[0], None, None, None, *[None] * 8), (None, "", None, None, 0, *[None] * 8), (50, None, *[None] * 11), rows[1], rows[1]]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for d in ("a", "b"):
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / d / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path / "a")).where("piece = 0")
    ids = [r["doc_id"] for r in out.collect()]
    assert None not in ids and len(ids) == len(set(ids)) and 50 not in ids and set(ids) <= set(range(6)) and 1 in ids
    assert P.run(spark, str(tmp_path / "b")).count() == 0
