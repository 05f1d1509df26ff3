"""Motion between camera frames from points of known and of unknown depth.

A sighting (graph, step, known, px, py, pz, bx, by, bz) is a point of the earlier frame and its unit bearing in the later one: with known depth p is the
point itself, else its unit bearing. The motion (R, t) takes points of the earlier frame to the later: y = R p + t. Known sightings give two angles between b and y,
unknown ones the distance of b from the plane of t and R p, free of the length of t. Sightings are dealt out by step once, and a task runs all rounds of its steps side by side,
with sums of the normal equations (28 numbers a step) over blocks of sightings. Steps of more than HEAVY sightings are no single task's: a round of theirs sums
within batches of sightings and then over them, followed by a small update of one row a step.

A first pass over all sightings is followed by one without those whose residual is beyond the median and three deviations (by the median) of its kind.
Rejection happens once: where a seventh of the sightings is off by a tenth to one side, a few of them stay and the motion remains off; of a fiftieth all go in most steps, not in all.
Every step starts from the same small forward motion, not from its predecessor's, as steps are solved side by side; where FEWEST sightings have a known depth,
these are met alone first, as sightings of unknown depth hold a short motion back (their direction turns the faster the shorter it is).

Edge cases: sightings with a null or infinite number are left out; steps with fewer than FEWEST sightings take the motion of the last solved step before them, or
the start where there is none, and say so; repeated sightings count each; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import whole_groups
from .posegraph import axis_angle, spin
from .quantiles import spread_quantiles
from .rows import finite

KEY = ["graph", "step"]
FEWEST = 8
SHORTEST = 5e-3  # below this length a motion has no direction to speak of
BLOCK = 1000
SALTS = 8
BUCKET = 1_000_000  # sightings of a bucket
HEAVY = 500_000  # a step of more sightings is no single task's
PART = 4096  # sightings worked on at once, so that they stay in a core's cache
SIGHT = ("px", "py", "pz", "bx", "by", "bz")
_PAIRS = [(i, j) for i in range(6) for j in range(i, 6)]
_STATE = "graph long, step long, n long, x array<double>, r array<double>, sums array<double>, damping double, trial array<double>, trial_r array<double>"


def residuals(d: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Residuals (two a sighting; the second is 0 for unknown depth) at the trial motion and their slopes by turn and shift."""
    r, t = np.stack(d["trial_r"]).reshape(-1, 3, 3), np.stack(d["trial"])[:, 3:]
    p, b = d[list(SIGHT[:3])].to_numpy(float), d[list(SIGHT[3:])].to_numpy(float)
    known = d["known"].to_numpy(bool)[:, None]
    m = np.einsum("nij,nj->ni", r, p)
    y = m + t
    size = np.maximum(np.sqrt((y * y).sum(1)), 1e-6)[:, None]
    length = np.sqrt((t * t).sum(1))[:, None]
    held = np.maximum(length, SHORTEST)
    zero = np.zeros(len(b))
    across, down = np.stack([b[:, 2], zero, -b[:, 0]], 1), np.stack([zero, b[:, 2], -b[:, 1]], 1)
    angle = lambda n: (n * y).sum(1, keepdims=True) / size
    plane = (b * np.cross(t, m)).sum(1, keepdims=True) / held
    one, two = np.where(known, angle(across), plane), np.where(known, angle(down), 0.0)
    slope = lambda n, e: n / size - e * y / size**2
    shift_plane = np.cross(m, b) / held - np.where(length >= SHORTEST, plane / held**2, 0.0) * t
    shift_one = np.where(known, slope(across, one), shift_plane)
    shift_two = np.where(known, slope(down, two), 0.0)
    turn_one = np.where(known, np.cross(m, shift_one), np.cross(m, np.cross(b, t)) / held)
    turn_two = np.cross(m, shift_two)
    return one[:, 0], two[:, 0], np.hstack([turn_one, shift_one]), np.hstack([turn_two, shift_two])


def _partial_sums(batches):
    """A batch's share of the normal equations of each of its steps: upper triangle of J'J, J'r and r'r."""
    for d in batches:
        if "limit_known" in d and len(d):
            d = d[_within(d)]
        if not len(d):
            continue
        e0, e1, j0, j1 = residuals(d)
        sums = np.stack([j0[:, i] * j0[:, k] + j1[:, i] * j1[:, k] for i, k in _PAIRS] + [j0[:, i] * e0 + j1[:, i] * e1 for i in range(6)] + [e0 * e0 + e1 * e1], 1)
        part = pd.DataFrame(sums).assign(graph=d["graph"].to_numpy(), step=d["step"].to_numpy(), n=1).groupby(KEY, sort=False).sum().reset_index()
        yield pd.DataFrame({"graph": part["graph"], "step": part["step"], "n": part["n"], "sums": list(part[list(range(28))].to_numpy())})


def _within(d: pd.DataFrame) -> np.ndarray:
    """Whether each sighting is within the limit of its kind at the base motion of its step."""
    one, two, _, _ = residuals(d[["known", *SIGHT]].assign(trial=d["base"], trial_r=d["base_r"]))
    return np.hypot(one, two) <= np.where(d["known"].to_numpy(bool), d["limit_known"].to_numpy(float), d["limit_unknown"].to_numpy(float))


def _normal_sums(d: DataFrame) -> DataFrame:
    """(graph, step, n, new_sums) at the trial motions: summed within batches, then by a partial aggregate."""
    parts = d.mapInPandas(_partial_sums, "graph long, step long, n long, sums array<double>")
    return parts.groupBy(*KEY).agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(28))).alias("new_sums"))


def _offs(batches):
    for d in batches:
        if len(d):
            one, two, _, _ = residuals(d)
            yield d[[*KEY, "known"]].assign(off=np.hypot(one, two))


def _next_trials(x: np.ndarray, sums: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """Damped steps from the motions x by their normal equations; the turn is composed from the left. A step that is not finite is not taken."""
    a = np.zeros((len(x), 6, 6))
    for k, (i, j) in enumerate(_PAIRS):
        a[:, i, j] = a[:, j, i] = sums[:, k]
    d = np.einsum("nii->ni", a)
    a = a + (damping[:, None] * d + 1e-12 * np.maximum(d.max(1, keepdims=True), 1e-300))[:, :, None] * np.eye(6)
    move = np.linalg.solve(a, -sums[:, 21:27, None])[:, :, 0]
    out = np.hstack([axis_angle(spin(move[:, :3]) @ spin(x[:, :3])), x[:, 3:] + move[:, 3:]])
    return np.where(np.isfinite(out).all(1, keepdims=True), out, x)


def _update(batches):
    """Take a trial that lowers the cost, or fall back to the best motion so far with more damping; then propose the next."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            x, r, sums, damping = row.x, row.r, row.sums, row.damping
            if sums is None or row.new_sums[27] <= sums[27]:
                x, r, sums, damping = row.trial, row.trial_r, row.new_sums, (damping / 10 if sums is not None else damping)
            else:
                damping = min(damping * 10, 1e12)
            trial = _next_trials(np.array([x], float), np.array([sums], float), np.array([damping]))[0]
            rows.append((row.graph, row.step, row.n, list(x), list(r), list(sums), damping, trial.tolist(), spin(trial[None, :3])[0].ravel().tolist()))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _STATE.split(", ")])


def _stored_by_step(rows: DataFrame, n: int) -> tuple[DataFrame, str]:
    """Sightings as a bucketed table by step and salt, ordered by step: each round joins them where they lie, only the states move.

    A step's sightings lie in SALTS buckets at most, so that a step with much of the data is not one task's.
    """
    spark, name = rows.sparkSession, f"sightings_{uuid.uuid4().hex}"
    parts = max(2 * spark.sparkContext.defaultParallelism, 1 + n // BUCKET)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*SIGHT), F.lit(SALTS))).repartition(parts, *KEY, "salt").sortWithinPartitions(*KEY)
    dealt.write.format("parquet").bucketBy(parts, *KEY, "salt").saveAsTable(name)
    return spark.table(name), name


def _beside(sightings: DataFrame, states: DataFrame) -> DataFrame:
    """Sightings with the row of `states` of their step; each salt gets a copy of it."""
    copies = states.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return sightings.join(copies.hint("shuffle_hash"), [*KEY, "salt"])


def _solve(sightings: DataFrame, states: DataFrame, rounds: int, cut, limits: DataFrame | None = None) -> DataFrame:
    """With `limits` (graph, step, base, base_r, limit_known, limit_unknown) only sightings whose residual at the base motion is within the limit of their kind count."""
    for _ in range(rounds):
        now = states.select(*KEY, "trial", "trial_r")
        found = _normal_sums(_beside(sightings, now if limits is None else now.join(limits, KEY)))
        both = states.select(*KEY, "x", "r", "sums", "damping", "trial", "trial_r").join(found, KEY)
        states = cut(both.mapInPandas(_update, _STATE), "motions")
    return states


def _fresh(states: DataFrame, motion: Column, turned: Column) -> DataFrame:
    none = F.lit(None).cast("array<double>")
    return states.select(*KEY, none.alias("x"), none.alias("r"), none.alias("sums"), F.lit(1e-4).alias("damping"), motion.alias("trial"), turned.alias("trial_r"))


def _known_terms(r, t, p, b):
    """Two residuals of sightings of known depth and their slopes by turn and shift; all arguments are lists of coordinates, one number a sighting each."""
    m = [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] for i in range(3)]
    y = [m[i] + t[i] for i in range(3)]
    size = 1 / np.maximum(np.sqrt(y[0] * y[0] + y[1] * y[1] + y[2] * y[2]), 1e-6)
    u = [c * size for c in y]
    for n in ([b[2], 0.0, -b[0]], [0.0, b[2], -b[1]]):
        e = n[0] * u[0] + n[1] * u[1] + n[2] * u[2]
        shift = [(n[i] - e * u[i]) * size for i in range(3)]
        yield e, [*_cross(m, shift), *shift]


def _unknown_terms(r, t, length, p, b):
    """The residual of sightings of unknown depth, likewise."""
    m = [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] for i in range(3)]
    held = 1 / np.maximum(length, SHORTEST)
    normal = _cross(t, m)
    e = (b[0] * normal[0] + b[1] * normal[1] + b[2] * normal[2]) * held
    back = np.where(length >= SHORTEST, e * held * held, 0.0)
    across = _cross(m, b)
    yield e, [*(c * held for c in _cross(m, _cross(b, t))), *(across[i] * held - back * t[i] for i in range(3))]


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _terms(known: bool, at: np.ndarray, group: np.ndarray, motion: np.ndarray, turned: np.ndarray):
    """Residuals and slopes of sightings of one kind; `at` has six rows of coordinates, `group` the place of each sighting's step in `motion` and `turned`."""
    r, t = turned.T[:, group], motion.T[3:, group]
    return _known_terms(r, t, at[:3], at[3:]) if known else _unknown_terms(r, t, np.sqrt((motion[:, 3:] ** 2).sum(1))[group], at[:3], at[3:])


def _group_sums(kinds, motion: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """The 28 sums of each step: over `kinds` (known, at, group) of sightings, whose groups rise."""
    out = np.zeros((len(motion), 28))
    for known, at, group in kinds:
        for a in range(0, len(group), PART):
            own = group[a : a + PART]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for e, j in _terms(known, at[:, a : a + PART], own, motion, turned):
                out[own[starts]] += np.add.reduceat(np.stack([j[i] * j[k] for i, k in _PAIRS] + [c * e for c in j] + [e * e]), starts, axis=1).T
    return out


def _offs_of(known: bool, at: np.ndarray, group: np.ndarray, motion: np.ndarray, turned: np.ndarray) -> np.ndarray:
    parts = [np.sqrt(sum(e * e for e, _ in _terms(known, at[:, a : a + PART], group[a : a + PART], motion, turned))) for a in range(0, len(group), PART)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _rounds(kinds, motion: np.ndarray, rounds: int) -> np.ndarray:
    """The best motion of each step after so many rounds from `motion`, as `_update` takes them."""
    trial, turned = motion, spin(motion[:, :3]).reshape(-1, 9)
    x, sums, damping = trial, np.full((len(motion), 28), np.inf), np.full(len(motion), 1e-4)
    for k in range(rounds):
        new = _group_sums(kinds, trial, turned)
        better = (new[:, 27] <= sums[:, 27]) | (k == 0)
        x, sums = np.where(better[:, None], trial, x), np.where(better[:, None], new, sums)
        damping = np.where(better, damping / (10 if k else 1), np.minimum(damping * 10, 1e12))
        trial = _next_trials(x, sums, damping)
        turned = spin(trial[:, :3]).reshape(-1, 9)
    return x


def _median(values: np.ndarray) -> float:
    half = (len(values) - 1) // 2
    low, high = np.partition(values, [half, len(values) // 2])[[half, len(values) // 2]]
    return low + (high - low) * 0.5


def _solve_whole(d: pd.DataFrame, rounds: int, start: tuple[float, ...], reach: float) -> pd.DataFrame:
    """Both passes for steps whose sightings are all in `d`, each step's together."""
    step = d[KEY].to_numpy(np.int64)
    starts = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]).any(1)])
    at = np.ascontiguousarray(d[list(SIGHT)].to_numpy(float).T)
    known = d["known"].eq(True).to_numpy(bool)
    fine = np.isfinite(at).all(0) & d["known"].notna().to_numpy(bool)
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(d)]))
    n = [np.bincount(group[fine & k], minlength=len(starts)) for k in (known, ~known)]
    out = pd.DataFrame(step[starts], columns=KEY).assign(known=n[0], unknown=n[1], own=None, kept=None)
    enough = n[0] + n[1] >= FEWEST
    place = np.where(enough, np.cumsum(enough) - 1, -1)
    if not enough.any():
        return out
    kinds = [(kind, np.ascontiguousarray(at[:, rows]), place[group[rows]]) for kind, rows in ((True, fine & known & enough[group]), (False, fine & ~known & enough[group]))]
    x = np.tile(np.array(start, float), (enough.sum(), 1))
    near = np.flatnonzero(n[0][enough] >= FEWEST)
    if len(near) and rounds // 2:
        back = np.full(len(x), -1)
        back[near] = np.arange(len(near))
        rows = back[kinds[0][2]] >= 0
        x[near] = _rounds([(True, kinds[0][1][:, rows], back[kinds[0][2][rows]])], x[near], rounds // 2)
    if rounds:
        x = _rounds(kinds, x, rounds)
    turned, kept = spin(x[:, :3]).reshape(-1, 9), []
    for kind, own, group in kinds:
        off = _offs_of(kind, own, group, x, turned)
        limit = np.zeros(len(x))
        bounds = np.searchsorted(group, np.arange(len(x) + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            part = off[bounds[k] : bounds[k + 1]]
            mid = _median(part)
            limit[k] = mid + reach * (1.4826 * _median(np.abs(part - mid)) + 2.3e-16)
        rows = off <= limit[group]
        kept.append((kind, np.ascontiguousarray(own[:, rows]), group[rows]))
    if rounds:
        x = _rounds(kept, x, rounds)
    out.loc[enough, "own"] = pd.Series(list(x), index=out.index[enough])
    out.loc[enough, "kept"] = sum(np.bincount(g, minlength=len(x)) for _, _, g in kept)
    return out


_SOLVED = "graph long, step long, known long, unknown long, own array<double>, kept long"


def _solve_spread(sightings: DataFrame, n: int, cut, rounds: int, start: tuple[float, ...], reach: float) -> DataFrame:
    """The same for steps of any size, round by round over stored sightings."""
    stored_rows, table = _stored_by_step(sightings, n)
    rows = finite(stored_rows, list(SIGHT)).where("known IS NOT NULL")
    counts = stored_rows.select(*KEY).distinct().join(rows.groupBy(*KEY).agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("unknown")), KEY, "left").fillna(0, ["known", "unknown"])
    counts = cut(counts, "sightings-by-step")
    enough = counts.where(F.col("known") + F.col("unknown") >= FEWEST).select(*KEY)
    seed, turned = np.array(start, float), spin(np.array([start[:3]], float))[0].ravel()
    states = _fresh(enough, F.array(*map(F.lit, seed.tolist())), F.array(*map(F.lit, turned.tolist())))
    near = _solve(rows.where("known"), states.join(counts.where(F.col("known") >= FEWEST).select(*KEY), KEY), rounds // 2, cut)
    begun = states.select(*KEY, "trial", "trial_r").join(near.select(*KEY, "x", "r"), KEY, "left")
    first = _solve(rows, cut(_fresh(begun, F.coalesce("x", "trial"), F.coalesce("r", "trial_r")), "motions"), rounds, cut)
    seen = _beside(rows, first.select(*KEY, F.col("x").alias("trial"), F.col("r").alias("trial_r")))
    seen = cut(seen.mapInPandas(_offs, "graph long, step long, known boolean, off double"), "residuals")
    kind = [*KEY, "known"]
    mid = spread_quantiles(seen, kind, "off", {"mid": 0.5})
    apart = seen.join(mid, kind).withColumn("apart", F.abs(F.col("off") - F.col("mid")))
    limit = F.col("mid") + reach * (1.4826 * F.col("spread") + 2.3e-16)
    limits = mid.join(spread_quantiles(apart, kind, "apart", {"spread": 0.5}), kind)
    limits = limits.groupBy(*KEY).agg(F.max(F.when(F.col("known"), limit)).alias("limit_known"), F.max(F.when(~F.col("known"), limit)).alias("limit_unknown"))
    limits = cut(limits.join(first.select(*KEY, F.col("x").alias("base"), F.col("r").alias("base_r")), KEY), "limits")
    last = _solve(rows, _fresh(first, F.col("x"), F.col("r")), rounds, cut, limits)
    sightings.sparkSession.sql(f"DROP TABLE {table}")
    return counts.join(last.select(*KEY, F.col("x").alias("own"), F.col("n").alias("kept")), KEY, "left").select(*KEY, "known", "unknown", "own", "kept")


def solve_motions(sightings: DataFrame, cut, rounds: int = 8, start: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0, 0.1), reach: float = 3.0) -> DataFrame:
    """(graph, step, motion, known, unknown, kept, solved): the motion (axis times angle, then t) of each step, its sightings by kind, those kept for the second pass."""
    # What is not finite is left out in the tasks: as a filter it would be pushed into the formulas that sightings are made by, and evaluate them many times.
    rows = sightings.where("graph IS NOT NULL AND step IS NOT NULL").select(*KEY, "known", *(F.col(c).cast("double").alias(c) for c in SIGHT))
    heavy = cut(rows.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > HEAVY), "heavy-steps")
    n = heavy.agg(F.sum("n")).first()[0]
    light = rows if n is None else rows.join(heavy.select(*KEY), KEY, "left_anti")
    done = whole_groups(light, KEY, _SOLVED, lambda d: _solve_whole(d, rounds, start, reach))
    if n is not None:
        done = done.unionByName(_solve_spread(rows.join(heavy.select(*KEY), KEY, "left_semi"), n, cut, rounds, start, reach))
    done = cut(done, "motions").withColumn("block", F.floor(F.col("step") / BLOCK))
    so_far = Window.partitionBy("graph", "block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ends = done.where("own IS NOT NULL").groupBy("graph", "block").agg(F.max_by("own", "step").alias("end"))
    all_blocks = done.select("graph", "block").distinct().join(ends, ["graph", "block"], "left")
    earlier = F.last("end", True).over(Window.partitionBy("graph").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    out = done.join(all_blocks.select("graph", "block", earlier.alias("earlier")), ["graph", "block"])
    motion = F.coalesce(F.last("own", True).over(so_far), "earlier", F.array(*map(F.lit, map(float, start))))
    return out.select(*KEY, motion.alias("motion"), "known", "unknown", F.coalesce("kept", F.lit(0)).alias("kept"), F.col("own").isNotNull().alias("solved"))
