"""One file per group, written by the executors to a folder that all share.

A file is written under another name and renamed when it is whole, so that a reader never sees
half of one and a retried task replaces what an earlier attempt left. A group is what one file
holds (a frame, a room), so its size is that of a file.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from prismfield.operators.kernels import each_group, whole_groups


def write_groups(df: DataFrame, key: str, base: str, suffix: str, encode: Callable[[int, pd.DataFrame], bytes]) -> DataFrame:
    """(key, path, n_bytes) of the files written; an action on the result writes them."""

    def run(pdf):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        rows = []
        for g in each_group(pdf, [key]):
            k = g[key].iloc[0]
            data = encode(k, g)
            path = f"{folder}/{k}{suffix}"
            with store.open_output_stream(draft := f"{folder}/.{uuid.uuid4().hex}", compression=None) as f:
                f.write(data)
            store.move(draft, path)
            rows.append((k, path, len(data)))
        return pd.DataFrame(rows, columns=["key", "path", "n_bytes"])

    return whole_groups(df, [key], "key long, path string, n_bytes long", run)


def ascii_ply(key, pdf: pd.DataFrame) -> bytes:
    """Points with colours: the intensity between its 5th and 95th percentile, clipped."""
    p = pdf.sort_values(["x", "y", "z", "v"])
    lo, hi = np.percentile(p["v"], [5, 95])
    red = np.round(np.clip((p["v"] - lo) / max(hi - lo, 1e-12), 0, 1) * 255).astype(int)
    head = f"ply\nformat ascii 1.0\nelement vertex {len(p)}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    return (head + "".join(f"{x:.6f} {y:.6f} {z:.6f} {r} 0 {255 - r}\n" for x, y, z, r in zip(p["x"], p["y"], p["z"], red, strict=True))).encode()


def binary_ply(key, pdf: pd.DataFrame) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(pdf)}\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    return head.encode() + pdf[["x", "y", "z"]].to_numpy("<f4").tobytes()


def ascii_pcd(key, pdf: pd.DataFrame) -> bytes:
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity label\nSIZE 4 4 4 4 4\nTYPE F F F F I\nCOUNT 1 1 1 1 1\nWIDTH {len(pdf)}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {len(pdf)}\nDATA ascii\n"
    return (head + "".join(f"{x:.6f} {y:.6f} {z:.6f} {v:.6f} {int(c)}\n" for x, y, z, v, c in zip(*(pdf[k] for k in ("x", "y", "z", "v", "c")), strict=True))).encode()


def voxel_npz(key, pdf: pd.DataFrame, size: float = 2.0) -> bytes:
    """Centres, counts, voxel size, origin and depth (-1: a metric grid)."""
    cells, counts = np.unique(np.floor(pdf[["x", "y", "z"]].to_numpy() / size).astype(np.int64), axis=0, return_counts=True)
    out = io.BytesIO()
    np.savez(out, centers=(cells + 0.5) * size, counts=counts, voxel_size=size, origin=np.zeros(3), depth=-1)
    return out.getvalue()


def map_npy(key, pdf: pd.DataFrame, shape: tuple[int, int] = (16, 16)) -> bytes:
    """A 2-D map of means by pixel (r, c); pixels without a value are NaN."""
    total, n = np.zeros(shape), np.zeros(shape)
    np.add.at(total, (pdf["r"], pdf["c"]), pdf["v"])
    np.add.at(n, (pdf["r"], pdf["c"]), 1)
    out = io.BytesIO()
    np.save(out, np.where(n > 0, total / np.maximum(n, 1), np.nan))
    return out.getvalue()


def boxes_json(key, pdf: pd.DataFrame) -> bytes:
    boxes = [{"id": int(i), "min": [x0, y0], "max": [x1, y1]} for i, x0, y0, x1, y1 in pdf.sort_values("box")[["box", "x0", "y0", "x1", "y1"]].itertuples(index=False)]
    return json.dumps({"schema": "boxes/1", "room": int(key), "boxes": boxes}).encode()


def cloud_message(points: np.ndarray, seconds: int, nanos: int, step: int = 16) -> bytes:
    """A serialised cloud: 4 bytes of encapsulation, the stamp, the number of points, then `step` bytes a point of which 12 are x, y, z."""
    body = np.zeros((len(points), step), np.uint8)
    body[:, :12] = np.ascontiguousarray(points, "<f4").view(np.uint8).reshape(len(points), 12)
    return b"\x00\x01\x00\x00" + struct.pack("<iIII", seconds, nanos, len(points), step) + body.tobytes()


_LASER = np.dtype([("offset", "<u4"), ("xyz", "<f4", 3), ("reflectivity", "u1"), ("tag", "u1"), ("line", "u1"), ("pad", "u1")])


def laser_message(points: np.ndarray, offsets: np.ndarray, lines: np.ndarray, seconds: int, frame_id: str) -> bytes:
    """A laser message with a text of any length before its points of 20 bytes."""
    rows = np.zeros(len(points), _LASER)
    rows["offset"], rows["xyz"], rows["line"] = offsets, points, lines
    name = frame_id.encode() + b"\0"
    return b"\x00\x01\x00\x00" + struct.pack("<iII", seconds, 0, len(name)) + name + struct.pack("<I", len(points)) + rows.tobytes()


def recording(key, pdf: pd.DataFrame) -> bytes:
    """A recording: an SQLite database of topics and messages (topic, stamp, payload)."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    names = sorted(pdf["topic"].unique())
    db.executemany("INSERT INTO topics VALUES (?, ?, ?)", [(i + 1, n, "value") for i, n in enumerate(names)])
    rows = pdf.sort_values(["stamp", "id"])
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", [(k + 1, names.index(t) + 1, int(s), struct.pack("<d", v)) for k, (t, s, v) in enumerate(zip(rows["topic"], rows["stamp"], rows["value"], strict=True))])
    db.commit()
    return db.serialize()
