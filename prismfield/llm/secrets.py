"""Secret scans: fixed patterns plus a randomness test battery with false-discovery control.

Every run of token characters is scored under its inferred encoding by a chi-squared
uniformity test, a runs test and a lag-one serial-correlation test; the sum of the three
p-values' logarithms is its distance from random. What ordinary text reaches is not taken from
a formula: a character-pair model of all ordinary words of the corpus writes runs of the same
encoding and length, as they are and with capitals at word starts; the larger share of them
that look at least as random is the run's p-value.
Per length class, Benjamini-Hochberg at level `q` over all runs of the corpus decides which
ones are reported, so that of the reported ones at most the share `q` is ordinary text in
expectation. `=` ends a run, except as padding after it. A run that fits no encoding is scored
by its maximal sub-runs of each alphabet; of those found, the ones inside another are left out.

Defined edge cases
- null text counts as empty: no spans; the digest is that of the empty string.
- repeated rows get equal results; extra columns are ignored; an empty table gives no rows.
- runs shorter than `MIN_RUN` are left to the fixed patterns: no test tells them from words.
- runs that overlap a fixed-pattern span are not reported again; a very long run is one run.
- digits only: an encoding of its own; where the corpus' numbers look random, none is reported.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, slices_of

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
KINDS = ("assign", "access", "hex", "random_decimal", "random_hex", "random_base32", "random_base36", "random_base62", "random_base64")
#: Encodings from the narrowest alphabet to the widest; `=` padding is stripped first.
ALPHABETS = (
    ("random_decimal", "0123456789"),
    ("random_hex", "0123456789abcdef"),
    ("random_hex", "0123456789ABCDEF"),
    ("random_base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("random_base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("random_base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("random_base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("random_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("random_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
MIN_RUN = 16
_CLASSES = tuple((name, {c: i for i, c in enumerate(letters)}) for name, letters in ALPHABETS)
_SUB_RUNS = tuple(re.compile(f"[{re.escape(''.join(sorted(letters)))}]{{{MIN_RUN},}}(?:=+$)?") for _, letters in ALPHABETS)
_ONLY_RUNS = bytes(c if RUN.fullmatch(chr(c)) else 32 for c in range(128)) + b" " * 128
DRAWS = 10_000
#: Characters of the pair model; the last state is the border of a word.
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
STATES = len(_CHARS) + 1
_STATE = np.full(256, STATES - 1, np.uint8)
_STATE[[ord(c) for c in _CHARS]] = np.arange(STATES - 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three fixed patterns, leftmost and non-overlapping within each kind."""
    found = []
    low = text.lower()
    if ("=" in text or ":" in text) and any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found


def _p_normal(z: float, sides: int) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if sides == 2 else 0.5 * math.erfc(z / math.sqrt(2))


def battery(symbols: list[int], size: int) -> tuple[float, float, float]:
    """p-values of uniformity over `size` symbols, of runs about the middle and of serial correlation."""
    n = len(symbols)
    counts: dict[int, int] = {}
    for s in symbols:
        counts[s] = counts.get(s, 0) + 1
    chi = sum(c * c for c in counts.values()) * size / n - n
    p_chi = _p_normal((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n), 1)
    high = [s * 2 >= size for s in symbols]
    a = sum(high)
    b = n - a
    if not a or not b:
        p_runs = 2.0 ** (1 - n)
    else:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _p_normal((runs - mean) / math.sqrt(var), 2) if var > 0 else 1.0
    mid = sum(symbols) / n
    total = sum((s - mid) ** 2 for s in symbols)
    r = sum((x - mid) * (y - mid) for x, y in zip(symbols, symbols[1:], strict=False)) / total if total else 1.0
    return p_chi, p_runs, _p_normal((r + 1 / n) * math.sqrt(n), 2)


def distance(run: str) -> tuple[int, float] | None:
    """Number of the inferred encoding and distance from random (0: as random as can be); None for shorter runs and for none."""
    body = run.rstrip("=")
    if len(body) < MIN_RUN:
        return None
    for k, (_, index) in enumerate(_CLASSES):
        if all(c in index for c in body):
            return k, -sum(math.log(max(p, 1e-300)) for p in battery([index[c] for c in body], len(index)))
    return None


def candidates(text: str) -> list[tuple[int, int, int, float]]:
    """(start, end, encoding, distance from random) of each run, or of the sub-runs of one that fits no encoding."""
    out = []
    for m in RUN.finditer(text):
        if m.end() - m.start() < MIN_RUN:
            continue
        body = m[0].rstrip("=")
        if any(all(c in index for c in body) for _, index in _CLASSES):
            spans = [m.span()]
        else:
            spans = sorted({(m.start() + s.start(), m.start() + s.end()) for sub in _SUB_RUNS for s in sub.finditer(m[0])})
        out += [(a, b, *got) for a, b in spans if (got := distance(text[a:b]))]
    return out


#: Shortest length of each class; a class is tested as if all its runs had that length.
LENGTHS = (16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 512)


def length_class(n: int) -> int:
    return bisect.bisect_right(LENGTHS, n) - 1


def scan_text(text: str | None) -> tuple[list, list]:
    """Fixed-pattern spans, and (start, end, encoding, length class, distance from random) of every other candidate run."""
    if not text:
        return [], []
    base, runs = base_spans(text), []
    words = text.encode("utf-8", "surrogatepass").translate(_ONLY_RUNS).split()
    if max(map(len, words), default=0) >= MIN_RUN:
        base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]
        for start, end, code, far in candidates(text):
            if not any(a < end and start < b for a, b, _ in base):
                runs.append((start, end, code, length_class(len(text[start:end].rstrip("="))), far))
    base.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return base, runs


def pair_counts(text: str) -> np.ndarray:
    """Counts of character pairs inside ordinary words: the borders of runs and of words count as one state."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_ONLY_RUNS), np.uint8)
    state = np.concatenate([[STATES - 1], _STATE[raw], [STATES - 1]]).astype(np.int32)
    border = np.flatnonzero(state == STATES - 1)
    long = np.flatnonzero(np.diff(border) > MIN_RUN)
    pairs = state[:-1] * STATES + state[1:]
    keep = np.ones(len(pairs), bool)
    for k in long.tolist():  # candidates are what is tested, not what is ordinary
        keep[border[k] : border[k + 1]] = False
    return np.bincount(pairs[keep], minlength=STATES * STATES)


def camel_pairs(pairs: np.ndarray) -> np.ndarray:
    """The pairs of the same words when each begins with a capital and goes on in lower case."""
    m = pairs.reshape(STATES, STATES)
    low = np.arange(STATES)
    low[:26] += 26
    folded = np.zeros_like(m)
    np.add.at(folded, (low[:, None].repeat(STATES, 1), low[None, :].repeat(STATES, 0)), m)
    folded[:26] = folded[26:52]
    folded[-1, :26], folded[-1, 26:52] = folded[-1, 26:52].copy(), 0
    return folded.ravel()


def ordinary_runs(pairs: np.ndarray, code: int, length: int, draws: int = DRAWS) -> np.ndarray:
    """Distances from random, sorted, of runs that the pair model of ordinary words writes in an encoding.

    Words follow one another without a gap. Only transitions inside the alphabet are taken; in
    an alphabet of one case, letters of the other one count for it.
    """
    letters = list(_CLASSES[code][1])
    fold = not any(c.islower() for c in letters) or not any(c.isupper() for c in letters)
    own = {c: i for i, c in enumerate(letters)}
    of = [own.get(c, own.get(c.lower(), own.get(c.upper(), -1)) if fold else -1) for c in _CHARS]
    k = len(letters)
    at, known = np.array([*of, k]), np.flatnonzero(np.array([*of, k]) >= 0)
    table = np.zeros((k + 1, k + 1))
    np.add.at(table, (at[known][:, None].repeat(len(known), 1), at[known][None, :].repeat(len(known), 0)), pairs.reshape(STATES, STATES)[np.ix_(known, known)])
    start = table[k, :k] + 0.5
    start /= start.sum()
    # a word's end leads to the next word's first letter
    step = table[:k, :k] + 0.1 + table[:k, k:] * start[None, :]
    below = np.cumsum(step / step.sum(1, keepdims=True), 1)
    rng = np.random.default_rng(code * 10_007 + length)
    runs = np.empty((draws, length), np.int64)
    runs[:, 0] = np.minimum(np.searchsorted(np.cumsum(start), rng.random(draws)), k - 1)
    for i in range(1, length):
        runs[:, i] = np.minimum((below[runs[:, i - 1]] < rng.random(draws)[:, None]).sum(1), k - 1)
    return np.sort(distances(runs, k))


def distances(runs: np.ndarray, size: int) -> np.ndarray:
    """`battery` on many runs of one length at once: the sum of -log p."""
    draws, n = runs.shape
    counts = np.zeros((draws, size), np.int64)
    np.add.at(counts, (np.repeat(np.arange(draws), n), runs.ravel()), 1)
    chi = (counts**2).sum(1) * size / n - n
    half = np.vectorize(math.erfc, otypes=[float])
    p_chi = 0.5 * half((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n) / math.sqrt(2))
    high = runs * 2 >= size
    a = high.sum(1)
    b = n - a
    both = (a > 0) & (b > 0)
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    turns = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    p_runs = np.where(both, np.where(var > 0, half(np.abs(turns - mean) / np.sqrt(np.where(var > 0, var, 1)) / math.sqrt(2)), 1.0), 2.0 ** (1 - n))
    off = runs - runs.mean(1, keepdims=True)
    total = (off**2).sum(1)
    r = np.where(total > 0, (off[:, 1:] * off[:, :-1]).sum(1) / np.where(total > 0, total, 1), 1.0)
    p_r = half(np.abs((r + 1 / n) * math.sqrt(n)) / math.sqrt(2))
    return -(np.log(np.maximum(p_chi, 1e-300)) + np.log(np.maximum(p_runs, 1e-300)) + np.log(np.maximum(p_r, 1e-300)))


class Limits:
    """What ordinary runs of (encoding, length class) reach, and the largest p-value to report per length class."""

    def __init__(self, ordinary: dict[tuple[int, int], list[np.ndarray]], most: dict[int, float] | None = None):
        self.ordinary, self.most = ordinary, most or {}

    def p(self, code: int, size: int, far: float) -> float:
        """Share of ordinary runs that are at least as random, the largest one over the ways to write them."""
        return max(((1 + int(np.searchsorted(known, far, side="right"))) / (1 + len(known)) for known in self.ordinary.get((code, size), ())), default=1.0)


def thresholds(docs: DataFrame, q: float = 0.05, draws: int = DRAWS) -> Limits:
    """Model of ordinary text and Benjamini-Hochberg limits of the whole corpus.

    Two passes; what is collected is a table of character pairs and histograms of fixed size.
    """

    def learn(batches):
        pairs, seen = np.zeros(STATES * STATES, np.int64), set()
        for batch in slices_of(batches):
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts):
                pairs += pair_counts("\n".join(t for t in texts[a:b] if t))
            for text in texts:
                seen |= {(code, size) for _, _, code, size, _ in scan_text(text)[1]}
        at = np.flatnonzero(pairs)
        kinds = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(at) + [k[0] for k in kinds], pa.int32()), pa.array([*at.tolist(), *(k[1] for k in kinds)], pa.int32()), pa.array([*pairs[at].tolist(), *[1] * len(kinds)], pa.int64())], ["code", "at", "n"])

    found = docs.select("text").mapInArrow(learn, "code int, at int, n long").groupBy("code", "at").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(STATES * STATES, np.int64)
    for r in found:
        if r["code"] < 0:
            pairs[r["at"]] = r["n"]
    ways = (pairs, camel_pairs(pairs))
    limits = Limits({(r["code"], r["at"]): [ordinary_runs(way, r["code"], LENGTHS[r["at"]], draws) for way in ways] for r in found if r["code"] >= 0})
    if not limits.ordinary:
        return limits

    def count(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch in slices_of(batches):
            for text in batch.column(0).to_pylist():
                for _, _, code, size, far in scan_text(text)[1]:
                    key = (size, round(limits.p(code, size, far) * (1 + draws)))
                    seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["size", "rank", "n"])

    got = docs.select("text").mapInArrow(count, "size int, rank int, n long").groupBy("size", "rank").agg(F.sum("n").alias("n")).collect()
    for size in {r["size"] for r in got}:
        ranks = sorted((r["rank"], r["n"]) for r in got if r["size"] == size)
        total, k = sum(n for _, n in ranks), 0
        for rank, n in ranks:
            k += n
            if rank / (1 + draws) <= q * k / total:
                limits.most[size] = rank / (1 + draws)
    return limits


def find(text: str | None, limits: Limits) -> tuple[list, list]:
    """Fixed-pattern spans, and all spans in order."""
    base, runs = scan_text(text)
    extra, end = [], -1
    for a, b, code, size, far in sorted(runs, key=lambda r: (r[0], -r[1])):
        if b > end and limits.p(code, size, far) <= limits.most.get(size, -1.0):
            extra.append((a, b, _CLASSES[code][0]))
            end = b
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def _join(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def detect(docs: DataFrame, limits: Limits, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts by kind, digest of the fixed-pattern spans, all spans."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices_of(batches):
            rows = [find(t, limits) for t in batch.column(1).to_pylist()]
            counts = [[sum(s[2] == k for s in base) for base, _ in rows] for k in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in rows]),
                    pa.array([_join(every) for _, every in rows]),
                    pa.array([len(every) for _, every in rows], pa.int64()),
                ],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"],
            )

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long")


def redact_text(text: str | None, limits: Limits, mark: str = "[SECRET]") -> str | None:
    """Text with every found span, overlapping ones merged, replaced by `mark`; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in find(text, limits)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, limits: Limits) -> DataFrame:
    """All columns of `docs`, with secrets in `text` replaced."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in slices_of(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([redact_text(t, limits) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
