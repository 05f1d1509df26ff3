"""Quality classifier by co-training of a text view and a metadata view.

Two logistic classifiers see different views of a document: the text view its hashed tokens,
the metadata view its language, source, length and layout figures. In each round both score
the whole corpus, and each adds the documents that it is surest of, with its own label, to the
other's training set. Both are calibrated on held-out labelled documents, their calibrated
log-odds are combined, and every document is scored.

Texts are read once: a table in the shared folder keeps each row's features (slot counts of its
tokens, a dozen figures), and the rounds and the last scoring run over that. Only the labelled rows
are a bounded sample (`max_labelled`); the number of pseudo-labels a round is the method's parameter
(`each`), and every document can be among them.

Defined edge cases
- null or empty text: its token view is neutral (zero features), the metadata view decides.
- null lang or source: a value of its own.
- a document with several labels: the smaller quality counts. Null labels are left out.
- an id with several texts: one of them, the same on every run, stands for it in training.
- documents with equal features count once among the pseudo-labels; ties go to the smaller feature hash.
- fewer than two classes among the labels: every score is the share of good labels (0.5 without labels).
- repeated rows get equal scores; an empty table gives no rows; very long texts are read whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, discard, materialize, sampled, slices_of

DIMS, SLOTS = 2048, 64
_ASCII_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?")
FIGURES = 12
META = FIGURES + 2 * SLOTS
FEATURES = "key long, n_tokens long, slots binary, counts binary, meta binary"


def token_slots(token: bytes) -> tuple[int, int, int]:
    """Slots of a token itself, of its last three bytes and of its shape."""
    shape = bytes((97 if c > 96 else 65 if c > 64 else 48 if 48 <= c < 58 else c) if c < 128 else 97 for c in token[:1] + token[-3:])
    return zlib.crc32(token) % DIMS, zlib.crc32(b"s" + token[-3:]) % DIMS, zlib.crc32(b"h" + shape) % DIMS


class _TokenRows(dict):
    """Row of each token in a table of its slots; begins anew beyond `most` tokens."""

    def __init__(self, most: int = 200_000):
        self.most, self.triples = most, []

    def __missing__(self, token: bytes) -> int:
        self.triples.append(token_slots(token))
        self[token] = row = len(self.triples) - 1
        return row

    def slots(self, tokens: list[bytes]) -> np.ndarray:
        """Slots of the tokens, three a row."""
        if len(self) > self.most:
            self.clear()
            self.triples = []
        rows = list(map(self.__getitem__, tokens))
        return np.array(self.triples, np.int64).reshape(-1, 3)[rows]


def slot_counts(texts: list[str | None], known: _TokenRows) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Tokens, slots and their counts of each text. A count above 255 is dealt over repeats of its slot."""
    tokens = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    sizes = [len(t) for t in tokens]
    slots = known.slots([t for some in tokens for t in some])
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount((owner[:, None] * DIMS + slots).ravel(), minlength=len(texts) * DIMS).reshape(len(texts), DIMS)
    out = []
    for n, row in zip(sizes, counts, strict=True):
        at = np.flatnonzero(row)
        c = row[at]
        repeats = (c + 254) // 255
        parts = np.full(repeats.sum(), 255, np.uint8)
        if len(at):
            parts[np.cumsum(repeats) - 1] = c - 255 * (repeats - 1)
        out.append((n, np.repeat(at, repeats).astype("<u2"), parts))
    return out


def meta_figures(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Length, layout and character-class shares, then the slots of language and source."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = len(b)
    lines = b.count(b"\n") + 1
    tokens = b.split()
    size = max(n, 1)
    share = lambda drop: (n - len(b.translate(None, drop))) / size
    return np.array((
        np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 8, share(_ASCII_LETTERS), share(b"0123456789"), share(_UPPER), 5 * share(_SYMBOLS),
        share(b".,;:"), len(set(tokens)) / max(len(tokens), 1), len(tokens) / size, 5 * share(b"|"), 5 * share(b"!?"),
        zlib.crc32(f"l{lang}".encode()) % SLOTS, zlib.crc32(f"s{source}".encode()) % SLOTS,
    ), "<f4")


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and the features of every row; equal features have equal keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known = _TokenRows()
        for batch in slices_of(batches, 250):
            texts, langs, sources = (batch.column(i).to_pylist() for i in range(1, 4))
            rows = []
            for start, end in blocks(texts):
                for i, (n, slots, counts) in zip(range(start, end), slot_counts(texts[start:end], known), strict=True):
                    parts = slots.tobytes(), counts.tobytes(), meta_figures(texts[i], langs[i], sources[i]).tobytes()
                    key = int.from_bytes(hashlib.blake2b(b"%d,%d," % (n, len(slots)) + b"".join(parts), digest_size=8).digest(), "little", signed=True)
                    rows.append((key, n, *parts))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["id", "key", "n_tokens", "slots", "counts", "meta"])

    return docs.select(F.col(id_col).alias("id"), "text", "lang", "source").mapInArrow(run, f"id {kind}, {FEATURES}")


class Features:
    """The features of some rows as flat arrays."""

    def __init__(self, n_tokens, slots, counts, meta):
        self.rows = len(n_tokens)
        self.share = 10.0 / np.maximum(np.asarray(n_tokens, float), 1)
        self.slots = np.frombuffer(b"".join(slots), "<u2").astype(np.int64)
        self.counts = np.frombuffer(b"".join(counts), np.uint8)
        self.owner = np.repeat(np.arange(self.rows), [len(c) for c in counts])
        self.figures = np.frombuffer(b"".join(meta), "<f4").reshape(-1, FIGURES + 2)

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Both views as matrices."""
        text = np.zeros((self.rows, DIMS), np.float32)
        np.add.at(text, (self.owner, self.slots), self.counts * self.share[self.owner])
        meta = np.zeros((self.rows, META), np.float32)
        meta[:, :FIGURES] = self.figures[:, :FIGURES]
        every = np.arange(self.rows)
        meta[every, FIGURES + self.figures[:, FIGURES].astype(int)] = 1
        meta[every, FIGURES + SLOTS + self.figures[:, FIGURES + 1].astype(int)] = 0.3
        return text, meta

    def logits(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of both views, without the matrices."""
        a = np.bincount(self.owner, weights=text[self.slots] * self.counts, minlength=self.rows) * self.share + text[-1]
        lang, source = (self.figures[:, FIGURES + i].astype(int) for i in range(2))
        # Summed row by row, so that equal rows get equal values wherever they stand.
        b = (self.figures[:, :FIGURES] * meta[:FIGURES]).sum(axis=1) + meta[FIGURES + lang] + 0.3 * meta[FIGURES + SLOTS + source] + meta[-1]
        return a, b


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 250) -> np.ndarray:
    """Weights with the intercept last, by Adam on the mean weighted log loss (deterministic)."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = weight.sum()
    for t in range(1, steps + 1):
        # In the type of x: a mixed product would copy x in every step.
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)))
        r = (p - y) * weight / total
        g = np.append(x.T @ r.astype(x.dtype), r.sum())
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights of both views, slope and intercept of each one's calibration, weights of the calibrated views."""

    def __init__(self, text=None, meta=None, calibrated=None, joint=None, constant: float = 0.5):
        self.text, self.meta, self.calibrated, self.joint, self.constant = text, meta, calibrated, joint, constant

    def predict(self, some: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: combined, by the text view, by the metadata view."""
        if self.text is None:
            return (np.full(some.rows, self.constant),) * 3
        views = [np.clip(x, -15, 15) * slope + shift for x, (slope, shift) in zip(some.logits(self.text, self.meta), self.calibrated, strict=True)]
        return _sigmoid(np.stack(views, axis=1) @ self.joint[:-1] + self.joint[-1]), _sigmoid(views[0]), _sigmoid(views[1])


def _balanced(y: np.ndarray) -> np.ndarray:
    good = max(y.sum(), 1)
    return np.where(y > 0, len(y) / (2 * good), len(y) / (2 * max(len(y) - y.sum(), 1)))


def surest(feats: DataFrame, weights: tuple[np.ndarray, np.ndarray], taken: np.ndarray, each: int, sure: float) -> pd.DataFrame:
    """view, good, margin, key: for each view and class at least the `each` surest rows of all that are not `taken`.

    Each task and then each of 64 shares of the keys passes on its own first `each`, so that what the driver
    gets (at most 4 x 64 x `each` numbers' rows) does not grow with the corpus.
    """
    limit = float(np.log(sure / (1 - sure)))
    shared = feats.sparkSession.sparkContext.broadcast((*weights, taken))
    empty = np.zeros(0), np.zeros(0, np.int64)

    def run(batches):
        text, meta, known = shared.value
        best = {(view, good): empty for view in (0, 1) for good in (False, True)}
        for batch in slices_of(batches):
            key = batch.column(0).to_numpy()
            fresh = ~np.isin(key, known)
            logits = Features(batch.column(1).to_numpy(), *(batch.column(i).to_pylist() for i in (2, 3, 4))).logits(text, meta)
            for (view, good), (margin, keys) in best.items():
                m = logits[view] if good else -logits[view]
                at = fresh & (m >= limit)
                if at.any():
                    keys, first = np.unique(np.concatenate([keys, key[at]]), return_index=True)
                    margin = np.concatenate([margin, m[at]])[first]
                    order = np.lexsort((keys, -margin))[:each]
                    best[view, good] = margin[order], keys[order]
        for (view, good), (margin, keys) in best.items():
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([view] * n, pa.int32()), pa.array([good] * n, pa.bool_()), pa.array(margin), pa.array(keys)], ["view", "good", "margin", "key"])

    found = feats.select("key", "n_tokens", "slots", "counts", "meta").mapInArrow(run, "view int, good boolean, margin double, key long")
    found = found.groupBy("view", "good", "key").agg(F.max("margin").alias("margin"))
    share = Window.partitionBy("view", "good", F.pmod("key", F.lit(64))).orderBy(F.desc("margin"), "key")
    got = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= each).drop("rank").toPandas()
    return got.sort_values(["view", "good", "margin", "key"], ascending=[True, False, False, True])


def _collected(rows: DataFrame) -> tuple[pd.DataFrame, tuple[np.ndarray, np.ndarray]]:
    got = rows.toPandas()
    return got, Features(got["n_tokens"], *([bytes(x) for x in got[c]] for c in ("slots", "counts", "meta"))).dense()


def co_train(feats: DataFrame, truth: DataFrame, rounds: int = 4, each: int = 50, sure: float = 0.95) -> Model:
    """Exchange confident pseudo-labels over the rows of `feats`, then calibrate and combine on every fifth labelled row.

    `truth` (id, y) is bounded. A row that two views or classes ask for goes to the first in the order of `surest`.
    """
    # One row an id: what the driver gets is bounded by the ids of `truth`.
    one = feats.join(F.broadcast(truth), "id").groupBy("id").agg(F.min(F.struct("key", "y", "n_tokens", "slots", "counts", "meta")).alias("r")).select("r.*")
    got, views = _collected(one.orderBy("key", "y"))
    y = got["y"].to_numpy(int)
    if len(y) < 10 or len(set(y.tolist())) < 2:
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    train = [[v[~held]] for v in views]
    labels = [[y[~held].astype(float)], [y[~held].astype(float)]]
    taken = np.unique(got["key"].to_numpy(np.int64))
    for turn in range(rounds + 1):
        fitted = [fit_logistic(np.concatenate(x), target, _balanced(target)) for x, target in ((train[k], np.concatenate(labels[k])) for k in range(2))]
        if turn == rounds:
            break
        asked = surest(feats, tuple(fitted), taken, each, sure)
        asked = asked.groupby(["view", "good"], sort=False).head(each).drop_duplicates("key")
        if not len(asked):
            break
        keys = feats.sparkSession.createDataFrame(asked[["key", "view", "good"]])
        # The broadcast side holds at most 4 x `each` keys.
        rows = feats.join(F.broadcast(keys), "key").groupBy("key").agg(F.min(F.struct("view", "good", "n_tokens", "slots", "counts", "meta")).alias("r")).select("key", "r.*")
        picked, picked_views = _collected(rows.orderBy("key"))
        for k in range(2):
            mine = (picked["view"] == k).to_numpy()
            train[1 - k].append(picked_views[1 - k][mine])
            labels[1 - k].append(picked["good"].to_numpy(float)[mine])
        taken = np.union1d(taken, picked["key"].to_numpy(np.int64))
    fold = held if held.any() else np.ones(len(y), bool)
    target = y[fold].astype(float)
    logits = [np.clip(v[fold] @ w[:-1] + w[-1], -15, 15) for v, w in zip(views, fitted, strict=True)]
    # Platt calibration of each view, then the weights of the calibrated log-odds.
    calibrated = [fit_logistic(x[:, None], target, np.ones(len(target)), l2=1e-2, steps=400) for x in logits]
    both = np.stack([x * slope + shift for x, (slope, shift) in zip(logits, calibrated, strict=True)], axis=1)
    joint = fit_logistic(both, target, np.ones(len(target)), l2=1e-2, steps=400)
    return Model(fitted[0], fitted[1], calibrated, joint)


def _truth(labels: DataFrame, max_labelled: int, id_col: str, label_col: str) -> DataFrame:
    """About `max_labelled` labelled ids, sampled by hash."""
    truth = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    return sampled(truth, "id", truth.count(), max_labelled, "quality labels")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, rounds: int = 4, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on at most about `max_labelled` labelled rows and the pseudo-labels of all documents."""
    feats = materialize(features(docs, id_col), "quality")
    model = co_train(feats, _truth(labels, max_labelled, id_col, label_col), rounds)
    discard(feats)
    return model


def _scored(feats: DataFrame, model: Model, id_col: str) -> DataFrame:
    shared = feats.sparkSession.sparkContext.broadcast(model)
    kind = feats.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in slices_of(batches):
            p, a, b = shared.value.predict(Features(batch.column(1).to_numpy(), *(batch.column(i).to_pylist() for i in (2, 3, 4))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(a), pa.array(b)], [id_col, "score", "quality", "text_score", "meta_score"])

    return feats.select("id", "n_tokens", "slots", "counts", "meta").mapInArrow(run, f"`{id_col}` {kind}, score double, quality int, text_score double, meta_score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id, score (probability of good quality), quality (0 or 1), text_score, meta_score (calibrated views) of every row."""
    return _scored(features(docs, id_col), model, id_col)


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = 3000, rounds: int = 4, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """`train` and `score` over one reading of the texts."""
    feats = materialize(features(docs, id_col), "quality")
    return _scored(feats, co_train(feats, _truth(labels, max_labelled, id_col, label_col), rounds), id_col)
