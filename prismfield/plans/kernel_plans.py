"""Queries over grouped kernels and over streams; those that SQL cannot express are tested against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from prismfield.operators import kernels as K
from prismfield.sources import adapters as A

from .registry import query


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w(user_id, n, event_id, value, last, took) AS (SELECT user_id, n, event_id, value, value, true FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, e.value, CASE WHEN abs(e.value - w.last) >= 25 THEN e.value ELSE w.last END, abs(e.value - w.last) >= 25 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, value FROM w WHERE took""")
def keyframe_selection(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id", "value")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("event_id")
        return p.iloc[K.keyframes(p[["value"]].to_numpy(), 25.0)]

    return K.grouped(e, ["user_id"], "user_id long, event_id long, value double", run)


@query("""WITH RECURSIVE b AS (SELECT p_brand, p_partkey, (p_partkey * 7 % 100)::DOUBLE AS x, (p_partkey * 13 % 100)::DOUBLE AS y, p_size::DOUBLE AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
w(p_brand, n, kept) AS (SELECT p_brand, n, [{'id': p_partkey, 'x': x, 'y': y, 's': s}] FROM b WHERE n = 1 UNION ALL SELECT b.p_brand, b.n, CASE WHEN len(list_filter(w.kept, lambda k: greatest(0, least(k.x + k.s, b.x + b.s) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.s, b.y + b.s) - greatest(k.y, b.y)) >=
 0.5 * (k.s * k.s + b.s * b.s - greatest(0, least(k.x + k.s, b.x + b.s) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.s, b.y + b.s) - greatest(k.y, b.y))))) = 0 THEN list_append(w.kept, {'id': b.p_partkey, 'x': b.x, 'y': b.y, 's': b.s}) ELSE w.kept END FROM w JOIN b ON b.p_brand = w.p_brand AND b.n = w.n + 1),
l AS (SELECT p_brand, unnest(arg_max(kept, n)) AS k FROM w GROUP BY p_brand) SELECT p_brand, k.id AS p_partkey FROM l""")
def box_suppression(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("p_partkey")
        x, y = (g["p_partkey"] * 7 % 100).to_numpy(float), (g["p_partkey"] * 13 % 100).to_numpy(float)
        w = g["p_size"].to_numpy(float)
        return g.iloc[K.nms(np.stack([x, y, x + w, y + w], 1), g["p_retailprice"].to_numpy(), 0.5)][["p_brand", "p_partkey"]]

    return K.grouped(p, ["p_brand"], "p_brand string, p_partkey long", run)


@query()
def wall_bay_pitch(spark, sf_dir):
    e = A.table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor("l_quantity").cast("int").alias("bin")).groupBy("l_suppkey", "bin").agg(F.count("*").alias("n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        profile = np.zeros(51)
        profile[g["bin"].to_numpy()] = g["n"]
        return pd.DataFrame({"l_suppkey": [g["l_suppkey"].iloc[0]], "pitch": [round(K.autocorrelation_pitch(profile, 3, 20), 6)]})

    return K.grouped(e, ["l_suppkey"], "l_suppkey long, pitch double", run)


@query()
def plane_fits(spark, sf_dir):
    p = A.points(spark, sf_dir).select("frame", "x", "y", "z", "l_orderkey", "l_linenumber", "l_partkey")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["l_orderkey", "l_linenumber", "l_partkey"])
        xyz = g[["x", "y", "z"]].to_numpy(float)
        n, d, inside = K.ransac_plane(xyz, 1.0, 50, int(g["frame"].iloc[0])) if len(xyz) >= 3 else (np.zeros(3), 0.0, np.zeros(len(xyz), bool))
        return pd.DataFrame({"frame": [g["frame"].iloc[0]], "nx": [n[0]], "ny": [n[1]], "nz": [n[2]], "d": [d], "inliers": [int(inside.sum())], "points": [len(xyz)]})

    return K.grouped(p, ["frame"], "frame long, nx double, ny double, nz double, d double, inliers long, points long", run)


@query()
def room_tiling(spark, sf_dir):
    cells = A.points(spark, sf_dir).select((F.col("frame") % 20).alias("hall"), F.floor(F.col("x") / 2).cast("int").alias("i"), F.floor(F.col("y") / 4).cast("int").alias("j")).groupBy("hall", "i", "j").agg(F.count("*").alias("n")).where("n >= 2")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((g["i"].max() + 1, g["j"].max() + 1), bool)
        mask[g["i"], g["j"]] = True
        rows = K.rectangle_tiling(mask, 4, 20)
        return pd.DataFrame([(g["hall"].iloc[0], k, *r) for k, r in enumerate(rows)], columns=["hall", "box", "area", "top", "left", "bottom", "right"])

    return K.grouped(cells, ["hall"], "hall long, box long, area long, top long, left long, bottom long, right long", run)


@query("""WITH d AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM d)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def streaming_sessions(spark, sf_dir):
    """Closed event-time sessions per user from a file stream, emitted once the watermark has passed them."""
    from prismfield.streaming.sessions import closed_sessions

    micros = lambda c: F.unix_micros(c)
    return closed_sessions(spark, f"{sf_dir}/events.parquet").select("user_id", micros("start").alias("start_us"), micros("end").alias("end_us"), "n", "total")


@query("""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS s FROM events, generate_series(0, 3) g(k)) SELECT event_type, epoch_us(s) AS start_us, count(*) AS n, CASE WHEN max(value) - min(value) <= 50 THEN round(avg(value), 6) END AS consensus FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""")
def streaming_consensus(spark, sf_dir):
    """Sliding-window consensus of a stream, unknown where values spread too far; windows that the watermark closed."""
    from prismfield.streaming import sessions as R

    out = R.run_to_table(R.rolling_consensus(R.event_stream(spark, f"{sf_dir}/events.parquet")))
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n", F.round("consensus", 6).alias("consensus"))


@query("""WITH v AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id, event_id AS click_id, ts AS ct FROM events WHERE event_type = 'click') SELECT event_id, arg_min(click_id, (abs(epoch_us(ct) - epoch_us(ts)), ct)) AS click_id, min(abs(epoch_us(ct) - epoch_us(ts))) AS off_us FROM v JOIN c ON v.user_id = c.user_id AND ct BETWEEN ts - INTERVAL 12 HOUR AND ts + INTERVAL 12 HOUR GROUP BY event_id""")
def streaming_nearest(spark, sf_dir):
    """As-of on streams: both sides wait within their watermarks for partners in range; the nearest one is the match."""
    from prismfield.streaming import sessions as R

    return R.nearest_in_range(spark, f"{sf_dir}/events.parquet", "view", "click", "12 hours")


@query("""WITH d AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS dt FROM events) SELECT user_id, us - dt AS start_us, us AS end_us FROM d WHERE dt > 43200000000""")
def streaming_gaps(spark, sf_dir):
    """Gaps of each user's stream by a state that holds the last time seen."""
    from prismfield.streaming import sessions as R

    return R.stream_gaps(spark, f"{sf_dir}/events.parquet", 43_200_000_000)


@query("""WITH w AS (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 AS passed FROM events), v AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'), c AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click'),
b AS (SELECT v.user_id, v.event_id, arg_min(c.event_id, (abs(c.us - v.us), c.us, c.event_id)) AS match_id, min(abs(c.us - v.us)) AS off_us FROM v LEFT JOIN c ON v.user_id = c.user_id AND abs(c.us - v.us) <= 43200000000 WHERE (v.us // 604800000000 + 1) * 604800000000 + 43200000000 <= (SELECT passed FROM w) GROUP BY ALL)
SELECT user_id, event_id, match_id, off_us FROM b""")
def streaming_asof_closed(spark, sf_dir):
    """J2 on a stream: each target is emitted once, when the watermark has passed its stretch and its tolerance, with the nearest sample or none; a timer settles it and empties the state."""
    from prismfield.streaming import sessions as R
    from prismfield.streaming import timers as S

    out = S.asof_when_closed(R.event_stream(spark, f"{sf_dir}/events.parquet"), F.col("event_type") == "view", F.col("event_type") == "click", 43_200_000_000, 604_800_000_000, "1 hour")
    with S.rocks_state(spark):
        return R.run_to_table(out)


@query("""WITH w AS (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 AS passed FROM events), f AS (SELECT user_id, event_id, epoch_us(ts) AS us, coalesce(value > 40, false) AS moving, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, moving ORDER BY n) AS isl FROM f), r AS (SELECT *, count(*) OVER (PARTITION BY user_id, moving, isl) AS len FROM g), h AS (SELECT *, NOT (moving AND len >= 2) AS still FROM r),
k AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, still ORDER BY n) AS isl2 FROM h), p AS (SELECT user_id, min(n) AS first_n, max(n) AS last_n, count(*) AS length, min(us) AS start_us, max(us) AS end_us FROM k WHERE still GROUP BY user_id, isl2 HAVING count(*) >= 3)
SELECT p.* FROM p JOIN f ON f.user_id = p.user_id AND f.n = p.last_n + 2 WHERE (f.us // 604800000000 + 1) * 604800000000 <= (SELECT passed FROM w)""")
def streaming_poses(spark, sf_dir):
    """W4 on a stream: poses between moves, each emitted when the watermark has passed the stretch of the move that ended it."""
    from prismfield.streaming import sessions as R
    from prismfield.streaming import timers as S

    out = S.poses_when_closed(R.event_stream(spark, f"{sf_dir}/events.parquet"), F.col("value") > 40, 604_800_000_000, "1 hour")
    with S.rocks_state(spark):
        return R.run_to_table(out)
