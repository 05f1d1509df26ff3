"""Recordings as a partitioned source and sink: `spark.read.format("recording")` and `df.write.format("recording")`.

A recording is a folder of splits, each an SQLite database of topics and messages of at most `messages` rows and, but for its last message, `bytes` of payload, as recorders cut long runs into files. Beside the splits lies a
list with one line a split: its file, recording, topics with their numbers of messages, first and last stamp, first id, and number of messages. A partition is one split, so a recording of any length is read
and written in parts of bounded size, by as many tasks as it has splits. Filters on recording, topic and stamp pass over whole splits by the list, and what is left of them
is asked of a split's database, not of Spark.
With the option `stride` every so-manieth message of a topic of a recording is read, from its first one: the list says how many came in the splits before, so no task needs more than its own split.

Writing streams: a task closes a split when it is full or the recording changes, and never holds more than one. A split is written under a name of its attempt; the
list, made when all tasks have reported, names only what counts, so a retried or speculative task adds nothing. Reporting is one line a split. Rows come in the order of the
task, so sort by recording and stamp before (`sorted_for_writing`).

Edge cases: a null recording, topic or stamp is refused when it is written; a null payload stays null; an empty table makes an empty list and reads as no rows; a folder without a list, a
split of another length than the list says and a topic asked for that no recording has are errors with their names. Stamps may repeat; equal rows stay apart.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "recording long, topic string, id long, stamp long, data binary"
FIELDS = ("recording", "topic", "id", "stamp", "data")
LIST = "splits.jsonl"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


@dataclass
class Split(InputPartition):
    path: str
    recording: int
    topics: list
    low: int
    high: int
    n: int
    first: int | None = None  # id of the first message
    counts: list | None = None  # messages of each topic
    before: dict | None = None  # messages of each topic in the recording's earlier splits, with a stride


class Conditions:
    """What is asked of (recording, topic, stamp): allowed values and a closed range of stamps."""

    def __init__(self) -> None:
        self.allowed: dict[str, set] = {}
        self.low = self.high = None

    def take(self, f) -> bool:
        """Whether the filter is answered here."""
        name = f.attribute[0] if len(f.attribute) == 1 else None
        if isinstance(f, EqualTo | In) and name in ("recording", "topic"):
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.allowed[name] = self.allowed.get(name, values) & values
            return True
        if name != "stamp" or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            low = f.value + isinstance(f, GreaterThan)
            self.low = low if self.low is None else max(self.low, low)
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            high = f.value - isinstance(f, LessThan)
            self.high = high if self.high is None else min(self.high, high)
        return True

    def may_hold(self, s: Split) -> bool:
        return (
            ("recording" not in self.allowed or s.recording in self.allowed["recording"])
            and ("topic" not in self.allowed or not self.allowed["topic"].isdisjoint(s.topics))
            and (self.low is None or s.high >= self.low)
            and (self.high is None or s.low <= self.high)
        )

    def where(self) -> tuple[str, list]:
        parts, values = ["1 = 1"], []
        if "topic" in self.allowed:
            topics = sorted(t for t in self.allowed["topic"] if t is not None)
            parts.append(f"name IN ({', '.join('?' * len(topics))})")
            values += topics
        for sign, bound in ((">=", self.low), ("<=", self.high)):
            if bound is not None:
                parts.append(f"timestamp {sign} ?")
                values.append(bound)
        return " AND ".join(parts), values


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.base = options["path"].rstrip("/")
        self.topics = [t for t in options.get("topics", "").split(",") if t]
        self.stride = int(options.get("stride", 1))
        self.asked = Conditions()
        if self.topics:
            self.asked.allowed["topic"] = set(self.topics)

    def pushFilters(self, filters):
        for f in filters:
            if not self.asked.take(f):
                yield f

    def partitions(self):
        store, folder = _store(self.base)
        try:
            with store.open_input_stream(f"{folder}/{LIST}") as f:
                lines = f.read().decode().splitlines()
        except FileNotFoundError:
            raise ValueError(f"no list of splits in {self.base}") from None
        splits = [Split(**json.loads(line)) for line in lines]
        if missing := set(self.topics) - {t for s in splits for t in s.topics}:
            raise ValueError(f"no topic {sorted(missing)} in {self.base}; it has {sorted({t for s in splits for t in s.topics})}")
        if self.stride > 1:
            self._count_before(splits)
        return [s for s in splits if self.asked.may_hold(s)] or [Split("", 0, [], 0, 0, 0)]

    def _count_before(self, splits: list[Split]) -> None:
        if any(s.counts is None for s in splits):
            raise ValueError(f"the list of {self.base} has no counts of topics, so it cannot be read by a stride")
        seen: dict[int, dict] = {}
        for s in sorted(splits, key=lambda s: (s.recording, s.low, s.high, s.first)):
            total = seen.setdefault(s.recording, {})
            s.before = {t: total.get(t, 0) for t in s.topics}
            for t, n in zip(s.topics, s.counts, strict=True):
                total[t] = total.get(t, 0) + n

    def read(self, split: Split):
        import pyarrow as pa

        if not split.path:
            return
        store, folder = _store(self.base)
        with store.open_input_stream(f"{folder}/{split.path}", compression=None) as f:
            db = sqlite3.connect(":memory:")
            db.deserialize(f.read())
        n = db.execute("SELECT count(*) FROM messages").fetchone()[0]
        if n != split.n:
            raise ValueError(f"{split.path} has {n} messages, its list says {split.n}")
        where, values = self.asked.where()
        source = "messages JOIN topics ON topics.id = topic_id"
        if self.stride > 1:
            db.execute("CREATE TEMP TABLE earlier (topic TEXT, n INTEGER)")
            db.executemany("INSERT INTO earlier VALUES (?, ?)", split.before.items())
            place = "n + row_number() OVER (PARTITION BY topic_id ORDER BY messages.id) - 1"
            source = f"(SELECT messages.id, name, number, timestamp, data, {place} AS place FROM {source} JOIN earlier ON topic = name) AS messages"
            where += f" AND place % {self.stride} = 0"
        rows = db.execute(f"SELECT ?, name, number, timestamp, data FROM {source} WHERE {where} ORDER BY messages.id", [split.recording, *values])
        kinds = pa.schema([("recording", pa.int64()), ("topic", pa.string()), ("id", pa.int64()), ("stamp", pa.int64()), ("data", pa.binary())])
        while part := rows.fetchmany(4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    splits: list


class Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool) -> None:
        self.base = options["path"].rstrip("/")
        self.most = int(options.get("messages", 100_000))
        self.most_bytes = int(options.get("bytes", 64 << 20))
        if not overwrite:
            raise ValueError("a folder of recordings is written as a whole: use mode('overwrite') and a new folder")

    def write(self, batches) -> Written:
        store, folder = _store(self.base)
        store.create_dir(folder, recursive=True)
        splits: list[dict] = []
        open_split: list = []

        def close():
            if not open_split:
                return
            db, names, recording, low, high, n, _, first, counts = open_split
            db.commit()
            path = f"{recording}-{uuid.uuid4().hex}.db3"
            with store.open_output_stream(f"{folder}/{path}", compression=None) as f:
                f.write(db.serialize())
            db.close()
            splits.append({"path": path, "recording": recording, "topics": sorted(names), "low": low, "high": high, "n": n, "first": first, "counts": [counts[t] for t in sorted(names)]})
            open_split.clear()

        for batch in batches:
            for recording, topic, number, stamp, data in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in FIELDS), strict=True):
                if recording is None or topic is None or stamp is None:
                    raise ValueError(f"message {number} without a recording, topic or stamp")
                if open_split and (open_split[2] != recording or open_split[5] >= self.most or open_split[6] >= self.most_bytes):
                    close()
                if not open_split:
                    db = sqlite3.connect(":memory:")
                    db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT)")
                    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, number INTEGER, timestamp INTEGER, data BLOB)")
                    open_split[:] = [db, {}, recording, stamp, stamp, 0, 0, number, {}]
                db, names, *_, counts = open_split
                if topic not in names:
                    names[topic] = len(names) + 1
                    db.execute("INSERT INTO topics VALUES (?, ?)", (names[topic], topic))
                db.execute("INSERT INTO messages (topic_id, number, timestamp, data) VALUES (?, ?, ?, ?)", (names[topic], number, stamp, data))
                counts[topic] = counts.get(topic, 0) + 1
                open_split[3:7] = [min(open_split[3], stamp), max(open_split[4], stamp), open_split[5] + 1, open_split[6] + len(data or b"")]
        close()
        return Written(splits)

    def commit(self, messages) -> None:
        store, folder = _store(self.base)
        store.create_dir(folder, recursive=True)
        lines = sorted(((s["recording"], s["low"], s["path"]), json.dumps(s)) for m in messages if m for s in m.splits)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft, compression=None) as f:
            f.write("".join(line + "\n" for _, line in lines).encode())
        store.move(draft, f"{folder}/{LIST}")

    def abort(self, messages) -> None:
        """Splits of a failed write stay unlisted."""


class RecordingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(RecordingSource)


def sorted_for_writing(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Messages ranged by (recording, stamp, id) over the tasks: a long recording is many tasks' and their splits follow each other in time."""
    key = ["recording", "stamp", "id"]
    ranged = df.select(*FIELDS).repartitionByRange(parts, *key) if parts else df.select(*FIELDS).repartitionByRange(*key)
    return ranged.sortWithinPartitions(*key)


def convert(spark: SparkSession, base: str, target: str, topics: list[str] | None, names: dict[str, str], messages: int = 100_000) -> None:
    """A recording's messages of some topics, written as another with topics renamed by prefix (the longest that fits); split by split, without a shuffle."""
    df = spark.read.format("recording").load(base)
    if topics is not None:
        df = df.where(F.col("topic").isin(topics))
    renamed = F.col("topic")
    for old, new in sorted(names.items(), key=lambda x: len(x[0])):
        renamed = F.when(F.col("topic").startswith(old), F.concat(F.lit(new), F.substr("topic", F.lit(len(old) + 1)))).otherwise(renamed)
    df.withColumn("topic", renamed).select(*FIELDS).write.format("recording").option("messages", messages).mode("overwrite").save(target)
