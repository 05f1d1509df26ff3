"""WARC archives and their capture index.

Write: every page becomes one record, a gzip member of its own, in archives of bounded size;
of records with equal payloads of at least `least` bytes the one with the smallest page id is
a response and the others are revisits that refer to it. Each writing task also leaves a run of
index entries sorted by URL key and timestamp. Index: the runs are cut at sampled keys and each
key range merges its slices of all runs by a loser tree, which gives globally ordered capture
histories. Read: archives are read back record by record.

Defined edge cases
- null html is an empty payload; a null url is written without a target and has the empty URL key.
- rows that repeat a page id are written again, each with the same record type as its like.
- an empty table gives no archives, an empty index and no rows; extra columns are ignored.
- entries with equal URL key and timestamp are ordered by page id, then archive and offset.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

EPOCH = 1_600_000_000
#: Pages carry no capture time: theirs are spread over this many seconds by page id, so that any id has a date.
SPAN = 1_000_000_000
INDEX = "url_key string, captured long, page_id {kind}, archive string, start long, size long, record_type string"


def url_key(url: str | None) -> str:
    """Sort-friendly form: reversed host, then path and query, lower-cased host, no `www` or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + tail


def stamp(seconds: int) -> str:
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, captured: int) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but the digest and size of it."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {stamp(captured)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_records(data: bytes):
    """(headers, body) of each record of an archive of gzip members."""
    at = 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            chunk = data[at : at + 65536]
            if not chunk:
                raise ValueError("archive ends inside a record")
            parts.append(member.decompress(chunk))
            at += len(chunk) - len(member.unused_data)
        raw = b"".join(parts)
        while raw:
            head = raw.index(b"\r\n\r\n")
            lines = raw[:head].decode("utf-8", "surrogatepass").split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            end = head + 4 + int(headers["Content-Length"])
            yield headers, raw[head + 4 : end]
            raw = raw[end + 4 :]


def as_uri(path: str) -> str:
    if path.startswith("/"):
        return "file://" + path
    return re.sub(r"^file:/(?!//)/*", "file:///", path)


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, the root's winner goes out."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            if self.tree[node] == -1:  # the first to arrive waits for its opponent
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._replay(i)


def resolve(pages: DataFrame, least: int = 100, id_col: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Pages with payload_bytes and payload_digest; and the smallest id of each digest that occurs more than once.

    The groups are found from ids and digests alone. A group of one payload may hold a third
    of all rows: it is counted map-side first.
    """
    src = pages.select(F.col(id_col).alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    src = src.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    small = materialize(src.select("page_id", "payload_bytes", "payload_digest"), "digests")
    firsts = small.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return src, firsts


def write(pages: DataFrame, directory: str | None = None, least: int = 100, id_col: str = "page_id", most_bytes: int = 64 << 20) -> DataFrame:
    """Write archives; returns the index runs: one row per record, in run order within each archive.

    Only archives that a finished task reported are part of the result: a task writes under a
    new name each time it runs, so a lost or repeated attempt leaves a file that nothing refers to.
    """
    spark = pages.sparkSession
    directory = as_uri(directory or f"{shared_dir(spark)}/prismfield/warc-{uuid.uuid4().hex}")
    src, firsts = resolve(pages, least, id_col)
    # A hot digest makes a hot join key on the pages' side only, which adaptive execution splits.
    rows = src.join(firsts, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to")
    )
    kind = src.schema["page_id"].dataType.simpleString()

    def run(batches):
        from pyarrow import fs

        def opened():
            store, base = fs.FileSystem.from_uri(directory)
            store.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.gz"
            return f"{directory}/{name}", store.open_output_stream(f"{base}/{name}", compression=None)

        name, sink, at, entries = None, None, 0, []

        def run_of():
            entries.sort(key=lambda e: (e[0], e[1], e[2] is None, e[2], e[3], e[4]))
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], t) for i, t in enumerate((pa.string(), pa.int64(), id_type, pa.string(), pa.int64(), pa.int64(), pa.string()))], ["url_key", "captured", "page_id", "archive", "start", "size", "record_type"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for page, url, text, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if sink is None:
                    name, sink = opened()
                    at, entries = 0, []
                captured = EPOCH + (page or 0) % SPAN
                member = gzip_member(record(page, url, text.encode("utf-8", "surrogatepass"), digest, refers, captured))
                sink.write(member)
                entries.append((url_key(url), captured, page, name, at, len(member), "response" if refers is None else "revisit"))
                at += len(member)
                if at >= most_bytes:
                    sink.close()
                    sink = None
                    yield run_of()
        if sink is not None:
            sink.close()
            yield run_of()

    return materialize(rows.mapInArrow(run, INDEX.format(kind=kind)), "warc-runs")


def merge_index(runs: DataFrame, per_range: int = 100_000) -> DataFrame:
    """Globally ordered capture histories: `position` is the place of an entry in its range, `part` the range.

    The order of (part, position) is that of (url_key, captured, page_id). Spark samples the
    range bounds over the full key, so a URL with many captures is spread over ranges and
    nothing but its bounded sample reaches the driver. Each range holds slices of the sorted runs.
    """
    kind = runs.schema["page_id"].dataType
    parts = max(1, -(-runs.count() // per_range))
    fields = INDEX.format(kind=kind.simpleString())
    id_type = runs.sparkSession.createDataFrame([], f"x {kind.simpleString()}").toArrow().schema.field(0).type
    types = (pa.string(), pa.int64(), id_type, pa.string(), pa.int64(), pa.int64(), pa.string())

    def merge(batches):
        """Rows of a task come sorted by (archive, run order): slices of sorted runs."""
        import itertools

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True))
        slices = [[(r[0], r[1], r[2] is None, r[2], r[3], r[4], r[5], r[6]) for r in run] for _, run in itertools.groupby(rows, key=lambda r: r[3])]
        merged = iter(LoserTree(slices))
        at = 0
        while some := [(r[0], r[1], *r[3:]) for r in itertools.islice(merged, 10_000)]:
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in some], t) for i, t in enumerate(types)), pa.array([part] * len(some), pa.int32()), pa.array(range(at, at + len(some)), pa.int64())], ["url_key", "captured", "page_id", "archive", "start", "size", "record_type", "part", "position"])
            at += len(some)

    key = ["url_key", "captured", F.col("page_id").asc_nulls_last(), "archive", "start"]
    dealt = runs.repartitionByRange(parts, *key).sortWithinPartitions("archive", *key[:3], "start")
    return dealt.mapInArrow(merge, f"{fields}, part int, position long")


def read(index: DataFrame) -> DataFrame:
    """Records of the archives that an index names, parsed from the files themselves."""
    kind = index.schema["page_id"].dataType.simpleString()
    archives = index.select("archive").distinct()
    id_type = index.sparkSession.createDataFrame([], f"x {kind}").toArrow().schema.field(0).type

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                out = []
                for headers, body in read_records(data):
                    revisit = headers["WARC-Type"] == "revisit"
                    page = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                    digest = headers["WARC-Payload-Digest"].partition(":")[2]
                    if not revisit and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"damaged record {page} in {name}")
                    refers = headers.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                    out.append((None if page == "None" else int(page), headers.get("WARC-Target-URI"), int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], int(refers) if refers else None))
                types = (id_type, pa.string(), pa.int64(), pa.string(), pa.string(), id_type)
                for a in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[a : a + 10_000]], t) for i, t in enumerate(types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = max(1, archives.count())
    return archives.repartition(min(spread, 10_000)).mapInArrow(run, f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
