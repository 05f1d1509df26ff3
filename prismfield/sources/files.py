"""Readers of binary and text files: clouds, maps, documents, recordings.

Files come through Spark's `binaryFile` reader, so any store that Spark reads will do; a task
holds one file at a time. Damaged files raise with the file's name.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, FILES = 50_000, 256  # small files share a batch of about so many rows, of so many files at most


def read_files(spark: SparkSession, base: str, pattern: str, schema: str, parse: Callable[[str, bytes], pd.DataFrame]) -> DataFrame:
    """Rows that `parse` makes of each file below `base` whose name fits the pattern."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(base).select("path", "content")

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held.append(parse(path, content))
                if sum(map(len, held)) >= ROWS or len(held) >= FILES:
                    yield pd.concat(held)
                    held = []
        if held:
            yield pd.concat(held)

    return files.mapInPandas(run, schema)


def decode_rows(df: DataFrame, column: str, keep: list[str], schema: str, parse: Callable[[bytes], dict]) -> DataFrame:
    """Rows of the messages in a binary column, beside the columns `keep` of their message."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = pd.DataFrame(parse(row[-1]))
                for i, c in enumerate(keep):
                    out.insert(i, c, row[i])
                yield out

    return df.select(*keep, column).mapInPandas(run, f"{kinds}, {schema}")


def _number(path: str) -> int:
    return int(path.rsplit("/", 1)[1].split(".")[0])


def parse_cloud_file(path: str, data: bytes) -> pd.DataFrame:
    """Points of an ASCII or binary PLY or an ASCII PCD; an empty cloud is an error."""
    if data[:3] == b"ply":
        head, _, body = data.partition(b"end_header\n")
        n = int(head.split(b"element vertex ")[1].split(b"\n")[0])
        if b"binary_little_endian" in head:
            xyz = np.frombuffer(body, "<f4", 3 * n).reshape(n, 3).astype(float)
        else:
            xyz = np.loadtxt(io.BytesIO(body), ndmin=2, usecols=(0, 1, 2))
    else:
        body = data.partition(b"DATA ascii\n")[2]
        xyz = np.loadtxt(io.BytesIO(body), ndmin=2, usecols=(0, 1, 2))
    if not len(xyz):
        raise ValueError(f"empty cloud: {path}")
    return pd.DataFrame({"frame": _number(path), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})


def parse_map(path: str, data: bytes) -> pd.DataFrame:
    """Pixels (frame, r, c, v) of a 2-D map in `.npy` or `.csv`; unknown pixels are null."""
    values = np.load(io.BytesIO(data)) if path.endswith(".npy") else np.loadtxt(io.BytesIO(data), delimiter=",", ndmin=2)
    if values.ndim != 2:
        raise ValueError(f"not a 2-D map: {path}")
    r, c = np.indices(values.shape)
    v = values.ravel()
    return pd.DataFrame({"frame": _number(path), "r": r.ravel(), "c": c.ravel(), "v": pd.Series(v).where(~np.isnan(v), None)})


def parse_voxels(path: str, data: bytes) -> pd.DataFrame:
    z = np.load(io.BytesIO(data))
    return pd.DataFrame({"frame": _number(path), "cx": z["centers"][:, 0], "cy": z["centers"][:, 1], "cz": z["centers"][:, 2], "n": z["counts"], "depth": int(z["depth"])})


def parse_boxes(path: str, data: bytes) -> pd.DataFrame:
    """Boxes of a JSON document with a schema tag."""
    doc = json.loads(data)
    if doc.get("schema") != "boxes/1":
        raise ValueError(f"unknown schema: {path}")
    return pd.DataFrame([(doc["room"], b["id"], *b["min"], *b["max"]) for b in doc["boxes"]], columns=["room", "box", "x0", "y0", "x1", "y1"])


def parse_cloud_message(data: bytes) -> dict:
    """x, y, z of the finite points of a cloud message: the first 12 bytes of each point's step."""
    n, step = struct.unpack_from("<II", data, 12)
    if len(data) != 20 + n * step:
        raise ValueError("cloud message of another length than its header says")
    p = np.frombuffer(data, np.uint8, n * step, 20).reshape(n, step)[:, :12].copy().view("<f4")
    p = p[np.isfinite(p).all(1)].astype(float)
    return {"x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}


def parse_laser_message(data: bytes) -> dict:
    """Points of a laser message, read from its tail; the count before them must agree."""
    size = 20
    (name,) = struct.unpack_from("<I", data, 12)
    (n,) = struct.unpack_from("<I", data, 16 + name)
    if len(data) != 20 + name + n * size:
        raise ValueError("laser message of another length than its header says")
    rows = np.frombuffer(data, np.dtype([("offset", "<u4"), ("xyz", "<f4", 3), ("rest", "u1", 4)]), n, len(data) - n * size)
    return {"offset": rows["offset"].astype(np.int64), "x": rows["xyz"][:, 0].astype(float), "y": rows["xyz"][:, 1].astype(float), "z": rows["xyz"][:, 2].astype(float), "line": rows["rest"][:, 2].astype(np.int64)}


def parse_recording(path: str, data: bytes, topics: list[str] | None = None, stride: int = 1) -> pd.DataFrame:
    """Messages of an SQLite recording in order of their id, of the topics asked for, every `stride`-th of each.

    A topic that the recording lacks is an error that lists the ones it has.
    """
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    known = dict(db.execute("SELECT name, id FROM topics ORDER BY id"))
    if missing := [t for t in topics or () if t not in known]:
        raise ValueError(f"no topic {missing} in {path}; it has {sorted(known)}")
    rows = []
    for name in topics or known:
        got = db.execute("SELECT id, timestamp, data FROM messages WHERE topic_id = ? ORDER BY id", (known[name],)).fetchall()
        rows += [(_number(path), name, i, t, struct.unpack("<d", d)[0]) for i, t, d in got[::stride]]
    return pd.DataFrame(rows, columns=["recording", "topic", "id", "stamp", "value"])


def little_endian(raw: Column, at: int, size: int = 4) -> Column:
    """Unsigned number of `size` bytes from byte `at` (0 first), by columns alone: only this prefix of a message is looked at."""
    h = F.hex(F.substring(raw, at + 1, size))
    return F.conv(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(size)))), 16, 10).cast("long")
