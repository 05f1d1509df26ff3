"""Stateful streams with event-time timers: what is decided once the watermark has passed, and only then.

Both operators gather the rows of a key and a stretch of event time in state and settle the stretch by one timer, so that a key's state is
that of its open stretches; in the as-of a key that holds much of the stream is spread over as many states as it has stretches. Stretches are whole milliseconds. State lives in RocksDB beside the stream's checkpoint in the shared folder and
survives lost executors. Rows later than the watermark are dropped by Spark; stretches that the last watermark has not passed are not emitted.

Edge cases: rows with a null key or time are left out before the stream's state; equal times are settled by id; an empty stream emits nothing.
"""

from __future__ import annotations

from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SHARES = 4096  # states that a stretch's users are dealt into
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession):
    """Timers need the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Stretches(StatefulProcessor):
    """Rows of a (key, stretch) held until the timer at `until` (microseconds, the same for all its rows); then `settle` makes the rows to emit."""

    def __init__(self, schema: str, fields: list[str], settle):
        self.schema, self.fields, self.settle = schema, fields, settle

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        ends = None
        for batch in rows:
            if len(batch):
                ends = int(batch["until"].iloc[0])
                self.rows.appendList(list(batch[self.fields].itertuples(index=False, name=None)))
        if ends is not None:
            self.handle.registerTimer(-(-ends // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = pd.DataFrame(list(self.rows.get()), columns=self.fields)
        self.rows.clear()
        yield self.settle(key, held)

    def close(self) -> None:
        pass


def asof_when_closed(events: DataFrame, target: Column, sample: Column, reach_us: int, stretch_us: int, late: str, shares: int = SHARES) -> DataFrame:
    """(user_id, event_id, match_id, off_us): every target row with the nearest sample row of its user within `reach_us`, null where there is none; of equally near ones the
    earlier, then the smaller id. A target is emitted once the watermark has passed its stretch and the reach beyond it.

    A sample goes to the stretches that its reach touches, a target to its own. Users are dealt into `shares`; those of a share wait in one state a stretch, as a call for
    each user costs more than its rows.
    """
    e = events.withWatermark("event_time", late).where("user_id IS NOT NULL AND event_time IS NOT NULL")
    us = F.unix_micros("event_time")
    part = lambda t: F.floor(t / stretch_us)
    own = F.when(target, F.array(part(us))).otherwise(F.array().cast("array<bigint>"))
    near = F.when(sample, F.sequence(part(us - reach_us), part(us + reach_us))).otherwise(F.array().cast("array<bigint>"))
    roles = F.concat(F.transform(own, lambda s: F.struct(s.alias("stretch"), F.lit(True).alias("asks"))), F.transform(near, lambda s: F.struct(s.alias("stretch"), F.lit(False).alias("asks"))))
    rows = e.select("user_id", "event_time", F.col("event_id").cast("long").alias("event_id"), us.alias("us"), F.explode(roles).alias("r")).select("user_id", "event_time", "event_id", "us", "r.stretch", "r.asks")
    rows = rows.withColumn("until", (F.col("stretch") + 1) * stretch_us + reach_us).withColumn("share", F.pmod(F.xxhash64("user_id"), F.lit(shares)))

    def settle(key, held):
        asks = held[held["asks"]].sort_values(["user_id", "us", "event_id"])
        found = held[~held["asks"].astype(bool)].sort_values(["user_id", "us", "event_id"]).drop_duplicates(["user_id", "us"])
        out = pd.DataFrame({"user_id": asks["user_id"].to_numpy(np.int64), "event_id": asks["event_id"].to_numpy(np.int64)})
        if not len(found):
            return out.assign(match_id=pd.array([None] * len(out), "Int64"), off_us=pd.array([None] * len(out), "Int64"))
        # Users follow each other on one axis of time, farther apart than the reach, so that no one meets another's samples.
        users = np.unique(held["user_id"])
        first = held["us"].min()
        apart = int(held["us"].max() - first) + 2 * reach_us + 2
        t, s = (np.searchsorted(users, d["user_id"]) * apart + (d["us"].to_numpy(np.int64) - first) for d in (asks, found))
        after = np.searchsorted(s, t, "right")
        low, high = np.clip(after - 1, 0, None), np.clip(after, None, len(s) - 1)
        pick = np.where(np.abs(t - s[low]) <= np.abs(s[high] - t), low, high)
        off = np.abs(t - s[pick])
        far = off > reach_us
        return out.assign(match_id=pd.array(found["event_id"].to_numpy(np.int64)[pick], "Int64"), off_us=pd.array(off, "Int64")).mask(np.column_stack([np.zeros((len(t), 2), bool), far, far]))

    p = Stretches("user_id long, event_id long, us long, asks boolean", ["user_id", "event_id", "us", "asks"], settle)
    return rows.groupBy("share", "stretch").transformWithStateInPandas(p, "user_id long, event_id long, match_id long, off_us long", "append", "eventtime")


class Poses(StatefulProcessor):
    """Debounced states of the sensors of a share: rows wait in stretches for the watermark, are taken in order of (sensor, time, id), and of what is done only each sensor's open run stays.

    A moving run of at least `move` rows ends a pose; shorter ones are noise within it. A pose of at least `still` rows is emitted when it ends.
    """

    def __init__(self, stretch_us: int, move: int, still: int):
        self.stretch_us, self.move, self.still = stretch_us, move, still

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long, part long", "users array<long>, us array<long>, ids array<long>, moving array<boolean>")
        self.parts = handle.getMapState("parts", "stretch long", "n long")
        self.runs = handle.getValueState("runs", "users array<long>, n array<long>, first array<long>, last array<long>, pending array<long>, start_us array<long>, end_us array<long>, pending_us array<long>")

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            for stretch, part in batch.groupby("stretch"):
                at = (int(stretch),)
                n = self.parts.getValue(at)[0] if self.parts.containsKey(at) else 0
                self.waiting.updateValue((at[0], n), tuple(part[c].tolist() for c in ("user_id", "us", "event_id", "moving")))
                self.parts.updateValue(at, (n + 1,))
                self.handle.registerTimer(-(-(at[0] + 1) * self.stretch_us // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = (expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.stretch_us - 1,)
        rows: list[tuple] = []
        for k in range(self.parts.getValue(at)[0]):
            rows += zip(*self.waiting.getValue((at[0], k)), strict=True)
            self.waiting.removeKey((at[0], k))
        self.parts.removeKey(at)
        done: list[tuple] = []
        runs = {user: run for user, *run in zip(*self.runs.get(), strict=True)} if self.runs.exists() else {}
        for user, own in groupby(sorted(rows), key=lambda r: r[0]):
            runs[user] = self.walk(user, own, runs.get(user, (0,) * 7), done)
        self.runs.update(tuple(map(list, zip(*((user, *run) for user, run in runs.items()), strict=True))))
        yield pd.DataFrame(done, columns=["user_id", "first_n", "last_n", "length", "start_us", "end_us"])

    def walk(self, user: int, rows, run: tuple, done: list) -> tuple:
        """One sensor's rows after its open run; poses that end go to `done`."""
        n, first, last, pending, start, end, since = run
        for _, us, _, moving in rows:
            n += 1
            if moving:
                since = since if pending else us
                pending += 1
                if pending == self.move and first:
                    if last - first + 1 >= self.still:
                        done.append((user, first, last, last - first + 1, start, end))
                    first = 0
            else:
                if not first:  # a short move before the first still row of a stream is noise of its pose
                    noise = 0 < pending < self.move
                    first, start = (n - pending, since) if noise else (n, us)
                last, end, pending = n, us, 0
        return n, first, last, pending, start, end, since

    def close(self) -> None:
        pass


def poses_when_closed(events: DataFrame, moving: Column, stretch_us: int, late: str, move: int = 2, still: int = 3, shares: int = SHARES) -> DataFrame:
    """(user_id, first_n, last_n, length, start_us, end_us) of the poses that a move has ended, once the watermark has passed the stretch of that move.

    A sensor's runs are one key's, as each depends on the one before, and sensors are dealt into `shares`, each one state: what the watermark has not passed, and one open run a sensor, read and written together. A null `moving` counts as still.
    """
    us = F.unix_micros("event_time")
    e = events.withWatermark("event_time", late).where("user_id IS NOT NULL AND event_time IS NOT NULL")
    rows = e.select("user_id", "event_time", us.alias("us"), F.col("event_id").cast("long").alias("event_id"), F.coalesce(moving, F.lit(False)).alias("moving"), F.floor(us / stretch_us).alias("stretch"), F.pmod(F.xxhash64("user_id"), F.lit(shares)).alias("share"))
    p = Poses(stretch_us, move, still)
    return rows.groupBy("share").transformWithStateInPandas(p, "user_id long, first_n long, last_n long, length long, start_us long, end_us long", "append", "eventtime")
