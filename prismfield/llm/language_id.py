"""Language identification of mixed-language text.

Script ranges narrow each word's candidate languages, character-trigram models score every
word, and a Viterbi pass with a switching penalty labels spans.

Defined edge cases
- null text, empty text or text without letters: lang_pred `und`, score 0, no spans.
- letters in a script that no learned language uses: all learned languages stay candidates.
- ties between languages: the alphabetically first one.
- repeated rows each get their own, equal result; extra columns are ignored.
- no labelled rows at all: every text with letters is `und` with score 0, as nothing was learned.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, code_points, slices_of, with_fields

BUCKETS = 1 << 16
GRAIN = 1 << 40
#: Unicode block ranges by script (fixed values of the Unicode standard).
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x323AF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))
RESULT = (
    "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
)


@functools.lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: is it a letter, its one-character lower case, its script number."""
    size = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(size)), bool, size)
    lower = np.arange(size, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        c = chr(i).lower()
        if len(c) == 1:
            lower[i] = ord(c)
    script = np.zeros(size, np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return letter, lower, script


def _letters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter positions, trigram bucket of each letter (with its neighbours), first letter of each word."""
    letter, lower, _ = _tables()
    is_letter = letter[codes]
    at = np.flatnonzero(is_letter)
    low = np.where(is_letter, lower[codes], np.uint32(0))
    padded = np.concatenate([np.zeros(1, np.uint32), low, np.zeros(1, np.uint32)])
    h = padded[at] * np.uint32(0x9E3779B1) ^ padded[at + 1] * np.uint32(0x85EBCA77) ^ padded[at + 2] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = ((h >> np.uint32(13)) & np.uint32(BUCKETS - 1)).astype(np.int32)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return at, bucket, first


class Model:
    """Trigram log-probabilities [BUCKETS, languages] and the languages that use each script."""

    def __init__(self, langs: list[str], weights: np.ndarray, uses: np.ndarray, penalty: float, cap: float):
        self.langs, self.weights, self.uses, self.penalty, self.cap = langs, np.ascontiguousarray(weights.T), uses, penalty, cap


def fit(labelled: DataFrame, docs_per_lang: int = 5_000, penalty: float = 16.0, cap: float = 6.0, id_col: str = "doc_id") -> Model:
    """Learn from about `docs_per_lang` hash-sampled labelled rows of each language, all rows of rarer ones; what is collected is BUCKETS x languages."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    by_lang = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in by_lang)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool), penalty, cap)
    share = F.create_map(*(F.lit(x) for r in by_lang for x in (r["lang"], int(GRAIN * min(1.0, docs_per_lang / r["count"])))))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit("language id")), F.lit(GRAIN)) < share[F.col("lang")]
    sample = rows.where(drawn).select("text", "lang")

    def count(batches):
        names = {x: i for i, x in enumerate(langs)}
        found: dict[int, np.ndarray] = {}  # of the languages that the task meets
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if lang in names and text:
                    row = found.setdefault(names[lang], np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    codes = code_points(text)
                    at, bucket, _ = _letters(codes)
                    row += np.bincount(bucket, minlength=len(row))
                    row[BUCKETS:] += np.bincount(_tables()[2][codes[at]], minlength=len(SCRIPT_NAMES))
        for i, row in found.items():
            j = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i), pa.int32()), pa.array(j, pa.int32()), pa.array(row[j], pa.int64())], ["lang", "bucket", "n"])

    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    got = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts[got["lang"], got["bucket"]] = got["n"]
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    seen = max(1, int((grams.sum(0) > 0).sum()))
    weights = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * seen)).T.astype(np.float32)
    uses = (scripts >= 0.001 * np.maximum(scripts.sum(1, keepdims=True), 1)).T
    uses[~uses.any(1)] = True
    return Model(langs, weights, uses, penalty, cap)


def word_scores(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and capped log-score per language of each word."""
    at, bucket, first = _letters(codes)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(model.langs)))
    last = np.append(first[1:], len(at)) - 1
    scores = np.stack([np.add.reduceat(w[bucket], first) for w in model.weights], axis=1).astype(np.float64)
    allowed = model.uses[_tables()[2][codes[at[first]]]]
    scores = np.where(allowed, scores, -np.inf)
    scores = np.maximum(scores - scores.max(1, keepdims=True), -model.cap)
    scores[~allowed] = -2 * model.cap
    return at[first], at[last] + 1, scores


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word when a change of language costs `penalty`; ties stay, then take the first language."""
    n, k = scores.shape
    best, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(best)
        j, low = best.index(top), top - penalty
        back.append([i if best[i] >= low else j for i in range(k)])
        best = [(b if b >= low else low) + e for b, e in zip(best, row, strict=True)]
    path = np.empty(n, np.int64)
    state = best.index(max(best))
    path[-1] = state
    for i in range(n - 2, -1, -1):
        state = back[i][state]
        path[i] = state
    return path


def _labels(model: Model, scores: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Viterbi path of every document in a block.

    If no stretch of words gains more than half a penalty over the document's best single
    language, no path with k >= 1 switches can pay for them (at most k+1 stretches), so the
    constant path is the Viterbi path. Only the other documents run the dynamic program.
    """
    k = len(model.langs)
    totals = np.stack([np.bincount(doc, scores[:, i], n_docs) for i in range(k)], axis=1)
    base = totals.argmax(1)
    path = base[doc]
    own = scores[np.arange(len(doc)), path]
    big = 4.0 * model.cap * (np.bincount(doc, minlength=n_docs).max() + 2)
    gain = np.zeros(n_docs)
    for i in range(k):
        run = np.cumsum(scores[:, i] - own)
        before = np.concatenate([[0.0], run[:-1]])
        shift = doc * big
        lowest = np.minimum.accumulate(before - shift) + shift
        np.maximum.at(gain, doc, run - lowest)
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    for d in np.flatnonzero(gain > model.penalty / 2).tolist():
        a, b = bounds[d], bounds[d + 1]
        path[a:b] = viterbi(scores[a:b], model.penalty)
    return path


def label_block(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
    out: list[tuple[str, float, list[dict]]] = [("und", 0.0, [])] * len(texts)
    joined = "\n".join(t or "" for t in texts)
    if not model.langs or not joined:
        return out
    offsets = np.cumsum([0] + [len(t or "") + 1 for t in texts])
    start, end, scores = word_scores(model, code_points(joined))
    if not len(start):
        return out
    doc = np.searchsorted(offsets, start, side="right") - 1
    path = _labels(model, scores, doc, len(texts))
    size = end - start
    letters = np.stack([np.bincount(doc, size * (path == i), len(texts)) for i in range(len(model.langs))], axis=1)
    top = letters.argmax(1)
    total = letters.sum(1)
    change = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
    stop = np.append(change[1:], len(doc)) - 1
    spans: dict[int, list[dict]] = {}
    for d, a, b, lang in zip(doc[change].tolist(), (start[change] - offsets[doc[change]]).tolist(), (end[stop] - offsets[doc[change]]).tolist(), path[change].tolist(), strict=True):
        spans.setdefault(d, []).append({"start": a, "end": b, "lang": model.langs[lang]})
    for d in spans:
        out[d] = (model.langs[top[d]], float(letters[d, top[d]] / total[d]), spans[d])
    return out


def label(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` plus lang_pred, score (share of letters in spans of lang_pred) and spans.

    The model is a fixed-size table (BUCKETS x the learned languages) and travels as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col("text").alias("__text"))
    schema = with_fields(src.drop("__text").schema, RESULT)

    def run(batches):
        m = shared.value
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in slices_of(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            got = [x for a, b in blocks(texts) for x in label_block(m, texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], span)],
                [*keep, "lang_pred", "score", "spans"],
            )

    return src.mapInArrow(run, schema)


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string")) % 5 == 0
