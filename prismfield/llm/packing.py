"""Best-fit packing of token sequences with a swap-based local search.

Documents become token ids, an end token and pieces of at most `capacity` tokens. Pieces are
dealt into groups of bounded size by hash. Each group packs best-fit decreasing, then a local
search moves one piece, exchanges one for one or two for one between underfull bins whenever
that raises the sum of squared fills, so that the emptiest bins run empty. Bins that stay
underfull are dissolved and packed again together, over a fixed number of levels.

Defined edge cases
- null or empty text: one piece that holds the end token alone.
- repeated rows (equal doc_id too) each give their own pieces; an empty table gives no rows.
- ties between bins: the earliest made; between pieces: the first in (length, id, piece) order.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, code_points, materialize, slices_of

PIECES = "piece int, start long, length long, ids_crc32 long"


_NEVER = np.int64(1 << 40)


class _Merges:
    """The tokenizer's byte-pair merges, applied to many words at once.

    Words are rows of a symbol matrix. Each turn merges, in every row, the leftmost pair of
    lowest rank; rows without a pair in the table are done.
    """

    def __init__(self, model: dict, byte_symbols: list[str]):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in byte_symbols], np.int64)
        self.final = np.array([vocab[c + end] for c in byte_symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[x] << 20 | vocab[y] for x, y in pairs], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        # rank and result in one number; the table is hashed twice, the few collisions go to the second
        value = np.arange(len(pairs), dtype=np.int64) << 20 | made
        self.tables = []
        bits = 20
        while len(key):
            slot = self._slot(key, bits, len(self.tables))
            keys, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NEVER, np.int64)
            keys[slot[::-1]], values[slot[::-1]] = key[::-1], value[::-1]
            lost = keys[slot] != key
            self.tables.append((bits, keys, values))
            key, value, bits = key[lost], value[lost], max(12, bits - 4)

    @staticmethod
    def _slot(key: np.ndarray, bits: int, turn: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED27 * turn)) >> np.uint64(64 - bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        out = np.full(key.shape, _NEVER, np.int64)
        for turn, (bits, keys, values) in enumerate(self.tables):
            slot = self._slot(key, bits, turn)
            out = np.where(keys[slot] == key, values[slot], out)
        return out

    def words(self, raw: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of words of n > 0 bytes each, which lie end to end in `raw`."""
        start = np.cumsum(n) - n
        order = np.argsort(n, kind="stable")
        parts, counts, a = [], [], 0
        while a < len(order):
            b = min(len(order), a + 20_000)
            while b - a > 1 and (b - a) * int(n[order[b - 1]]) > 600_000:
                b = a + (b - a + 1) // 2
            rows = order[a:b]
            size = n[rows]
            s = np.full((len(rows), int(size[-1]) + 1), -1, np.int32)
            at = np.repeat(np.arange(len(rows)), size)
            col = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            s[at, col] = self.inner[raw[np.repeat(start[rows], size) + col]]
            s[np.arange(len(rows)), size - 1] = self.final[raw[start[rows] + size - 1]]
            count, flat = self._merge(s)
            parts.append(flat)
            counts.append(count)
            a = b
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, count = np.concatenate(parts), np.concatenate(counts)
        # back to the order of the words
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return flat[_ranges((np.cumsum(count) - count)[place], count[place])], count[place]

    def _merge(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.look(s[:, :-1], s[:, 1:])
        rank[(s[:, 1:] < 0) | (s[:, :-1] < 0)] = _NEVER
        alive = np.arange(len(s))
        cur, r = s, rank
        columns = np.arange(s.shape[1])
        while True:
            j = r.argmin(1)
            best = r[np.arange(len(r)), j]
            go = best < _NEVER
            if not go.all():
                s[alive[~go], : cur.shape[1]] = cur[~go]
                alive, cur, r, j, best = alive[go], cur[go], r[go], j[go], best[go]
            if not len(alive):
                break
            width = cur.shape[1]
            k = np.arange(len(cur))
            step = columns[:width] + (columns[:width] > j[:, None])
            cur = np.concatenate([cur, np.full((len(cur), 1), -1, np.int32)], axis=1)
            cur = np.take_along_axis(cur, step, axis=1)
            cur[k, j] = best & 0xFFFFF
            r = np.concatenate([r, np.full((len(r), 1), _NEVER, np.int64)], axis=1)
            r = np.take_along_axis(r, step[:, : width - 1], axis=1)
            right = cur[k, np.minimum(j + 1, width - 1)]
            r[k, np.minimum(j, width - 2)] = np.where(right >= 0, self.look(cur[k, j], np.maximum(right, 0)), _NEVER)
            has = j > 0
            r[k[has], j[has] - 1] = self.look(cur[k[has], j[has] - 1], cur[k[has], j[has]])
        used = s >= 0
        return used.sum(1), s[used]


def _byte_symbols() -> list[str]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges [start, start + count), one after another."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


#: Code points below this one are handled here, but for two whose lower case or normal form is longer.
_PLAIN = 0x180
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@functools.lru_cache(1)
def _plain_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of plain code points; random 64-bit factors of byte values and of places."""
    import unicodedata

    kinds = np.array([_SPACE if chr(c) in " \t\n\x0b\x0c\r\x85\xa0" else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(_PLAIN)], np.uint8)
    lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_PLAIN)], np.uint32)
    draw = np.random.default_rng(4096).integers(1, 1 << 63, 256 + 1024, np.uint64)
    return kinds, lower, draw[:256], draw[256:] | np.uint64(1)


class _Encoder:
    """Token ids of many texts at once, as little-endian 32-bit bytes.

    Texts of Latin characters are cut into words by array operations, by the tokenizer's own
    rule (contractions, letters, single digits, other marks); each different word of a block is
    merged once. Texts with other characters, very long words or special tokens go to the tokenizer.
    """

    def __init__(self, path: str, most: int = 500_000):
        import json

        self.most = most

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        self.merges = _Merges(model["model"], _byte_symbols())
        self.special = [t["content"] for t in model["added_tokens"]]
        self.keys, self.known = np.zeros(1, np.uint64), (np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32))

    def _remember(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> tuple:
        """Known words with new ones: sorted keys, start and number of ids, ids. Full, it keeps what it has."""
        if not len(keys):
            return self.known
        old = self.known
        at = np.searchsorted(old[0], keys)
        start = len(old[3]) + np.cumsum(count) - count
        now = (np.insert(old[0], at, keys), np.insert(old[1], at, start), np.insert(old[2], at, count), np.concatenate([old[3], ids.astype(np.int32)]))
        if len(now[0]) <= self.most:
            self.keys, self.known = now[0], now
        return now

    def one(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        codes = code_points("\n".join(texts) + "\n")
        odd = codes >= _PLAIN
        odd |= (codes == 0x130) | (codes == 0x149)
        gaps = np.flatnonzero((codes == 32) | (codes == 10))
        far = np.flatnonzero(np.diff(gaps, prepend=-1) > 256)
        alone = np.unique(np.searchsorted(bounds, np.concatenate([np.flatnonzero(odd), gaps[far] - 1]), side="right") - 1).tolist()
        marked = {i for i, t in enumerate(texts) if any(m in t for m in self.special)}
        alone = sorted(marked.union(alone))
        if alone:
            codes = codes.copy()
            for i in alone:
                codes[bounds[i] : bounds[i + 1]] = 32
        out = self._plain(codes, bounds)
        for i in alone:
            out[i] = self.one(texts[i])
        return out

    def _plain(self, codes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        kinds, lower, byte_factor, place_factor = _plain_tables()
        kind, codes = kinds[codes], lower[codes]
        before = np.concatenate([[np.uint8(_SPACE)], kind[:-1]])
        first = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
        mark = np.flatnonzero((codes == 39) & (before != _OTHER))
        if len(mark):
            padded = np.concatenate([codes, np.zeros(3, np.uint32)])
            x, y = padded[mark + 1], padded[mark + 2]
            two = np.isin(x, [ord(c) for c in "stmd"])
            three = (x == ord("r")) & (y == ord("e")) | (x == ord("v")) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
            first[mark[two | three] + 1] = False
            after = np.concatenate([mark[two] + 2, mark[three & ~two] + 3])
            first[after] = kind[after] != _SPACE
        # UTF-8: plain code points have one byte or two
        wide = codes >= 128
        at = np.cumsum(wide) - wide + np.arange(len(codes))
        raw = np.empty(len(codes) + int(wide.sum()), np.uint8)
        raw[at] = np.where(wide, 0xC0 | codes >> 6, codes)
        raw[at[wide] + 1] = 0x80 | codes[wide] & 0x3F
        start = np.flatnonzero(first)
        if not len(start):
            return [b""] * (len(bounds) - 1)
        # A word ends where the next begins or before white space.
        space = np.flatnonzero(kind == _SPACE)
        end = np.minimum(space[np.searchsorted(space, start)], np.append(start[1:], len(codes)))
        size = at[end] - at[start]
        inside = _ranges(at[start], size)
        where = np.cumsum(size) - size
        place = np.arange(len(inside)) - np.repeat(where, size)
        h = np.add.reduceat(byte_factor[raw[inside]] * place_factor[place], where)
        keys, one, each = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys)
        begin, length = at[start[one[new]]], size[one[new]]
        ids, count = self.merges.words(raw[_ranges(begin, length)], length)
        known = self._remember(keys[new], ids, count)
        from_, count = known[1][(k := np.searchsorted(known[0], keys))], known[2][k]
        ids = known[3]
        flat = ids[_ranges(from_[each], count[each])].astype("<u4")
        total = np.concatenate([[0], np.cumsum(count[each])])
        cuts = total[np.searchsorted(start, bounds)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(4)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of each piece."""
    step = 4 * capacity
    return [(k, at // 4, len(part) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step)) if (part := ids[at : at + step])]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id") -> DataFrame:
    """One row per piece. `tokenizer` is a file that every executor has; null means the installed word BPE."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer or default_tokenizer())
        for batch in slices_of(batches):
            texts = batch.column(1).to_pylist()
            rows = [cut(ids + end, capacity) for a, b in blocks(texts) for ids in encode(texts[a:b])]
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            flat = [p for r in rows for p in r]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), *(pa.array([p[i] for p in flat], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices; `lengths` in any order, packed from the longest down."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        at = bisect.bisect_left(free, (n, -1))
        if at == len(free):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room, b = free.pop(at)
        bins[b].append(i)
        bisect.insort(free, (room - n, b))
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: move, exchange one for one, exchange two for one, while squared fill grows.

    The emptiest bin gives, fuller underfull bins take; every step makes the sum of squared
    fills larger, so the search ends: when no bin has a step left, or at the lower bound of the bin count.
    """
    bins = [list(b) for b in bins]
    least = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    stuck: dict[int, set[int]] = {}  # bins without a step, and the bins changed since they were tried
    while sum(f > 0 for f in fill) > least:
        open_bins = sorted((b for b, f in enumerate(fill) if 0 < f < capacity), key=lambda b: (fill[b], b))
        giver = next((b for b in open_bins if stuck.get(b, True)), None)
        if giver is None or len(open_bins) < 2:
            break
        again = stuck.get(giver)
        takers = (t for t in reversed(open_bins) if t != giver and fill[t] >= fill[giver] and (again is None or t in again))
        taker = next((t for t in takers if _step(bins, fill, lengths, capacity, giver, t)), None)
        if taker is None:
            stuck[giver] = set()
            continue
        for b in (giver, taker):
            stuck.pop(b, None)
        for changed in stuck.values():
            changed |= {giver, taker}
    return [b for b in bins if b]


def _step(bins, fill, lengths, capacity, giver, taker) -> bool:
    room = capacity - fill[taker]
    gives = sorted(bins[giver], key=lambda i: -lengths[i])

    def done(out: list[int], back: list[int]) -> bool:
        for i in out:
            bins[giver].remove(i)
            bins[taker].append(i)
        for i in back:
            bins[taker].remove(i)
            bins[giver].append(i)
        net = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
        fill[giver] -= net
        fill[taker] += net
        return True

    for i in gives:
        if lengths[i] <= room:
            return done([i], [])
    takes = sorted((lengths[i], i) for i in bins[taker])
    sizes = [n for n, _ in takes]
    for i in gives:
        at = bisect.bisect_left(sizes, lengths[i] - room)
        if at < len(takes) and sizes[at] < lengths[i]:
            return done([i], [takes[at][1]])
    for x, i in enumerate(gives):
        for j in gives[x + 1 :]:
            both = lengths[i] + lengths[j]
            at = bisect.bisect_left(sizes, both - room)
            if at < len(takes) and sizes[at] < both:
                return done([i, j], [takes[at][1]])
    return False


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, group: int = 4000, levels: int = 3, underfull: float = 0.995, id_col: str = "doc_id") -> DataFrame:
    """Pieces with sequence_id and offset. A group holds about `group` pieces, however many there are.

    Each level packs its groups, keeps bins filled to `underfull` and hands the rest to the
    next level; the last level keeps all. Only lengths and ids are shuffled, never texts.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    # Deals are by a hash of a stored row number: reruns of lost tasks agree, repeated rows spread.
    rest = materialize(pieces(docs, tokenizer, capacity, end_id, id_col).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    kind = rest.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {PIECES}, __row long, sequence_id long, offset long, fill long"
    order = [id_col, "piece", "start", "length", "ids_crc32", "__row"]
    out = []
    for level in range(levels):
        n = rest.count()
        if not n:
            break
        groups = max(1, round(n / group))

        dealt = rest.select(*order, F.pmod(F.xxhash64("__row", F.lit(level)), F.lit(groups)).alias("__group"))
        packed = dealt.groupBy("__group").applyInPandas(_packer(order, capacity, level), schema)
        if level + 1 < levels and groups > 1:
            packed = materialize(packed, f"packed{level}")
            out.append(packed.where(F.col("fill") >= int(capacity * underfull)).drop("fill"))
            rest = packed.where(F.col("fill") < int(capacity * underfull)).select(*order)
        else:
            out.append(packed.drop("fill"))
            break
    if not out:
        return rest.select(*order[:-1], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result.drop("__row")


def _packer(order: list[str], capacity: int, level: int):
    def run(key, pdf):
        pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
        lengths = pdf["length"].tolist()
        seq, off, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for b, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = (level << 60) | (int(key[0]) << 24) | b, at
                at += lengths[i]
            fill[members] = at
        return pdf[order].assign(sequence_id=seq, offset=off, fill=fill)

    return run
