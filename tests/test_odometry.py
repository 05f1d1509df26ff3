"""Exact quantiles of groups and motions between frames, against plain versions."""

import numpy as np
import pandas as pd
import pytest

from prismfield.operators import odometry as O
from prismfield.operators.posegraph import spin
from prismfield.operators.quantiles import spread_quantiles
from prismfield.sources.adapters import stored

SCHEMA = "graph long, step long, known boolean, px double, py double, pz double, bx double, by double, bz double"


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [0.0, 1e9, *range(50)], list(np.random.default_rng(3).normal(size=500))])
def test_quantiles_equal_numpy(spark, values):
    rows = [("a", float(v)) for v in values] + [(None, 5.0), ("a", None), ("a", float("nan")), ("empty", None)]
    got = {r["k"]: r for r in spread_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"low": 0.05, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == {"a", None} and got[None]["mid"] == 5.0
    assert np.allclose([got["a"][c] for c in ("low", "mid", "top")], np.quantile(values, [0.05, 0.5, 1.0]), rtol=0, atol=1e-9)


def _seen(seed, step, motion, n, wrong=0):
    rng = np.random.default_rng(seed)
    p = np.c_[rng.uniform(-4, 4, n), rng.uniform(-3, 3, n), rng.uniform(2, 20, n)]
    y = p @ spin(np.array([motion[:3]]))[0].T + motion[3:]
    y[:wrong] += rng.normal(size=(wrong, 3)) * 2
    b = y / np.linalg.norm(y, axis=1, keepdims=True)
    known = np.arange(n) % 2 == 0
    p = np.where(known[:, None], p, p / np.linalg.norm(p, axis=1, keepdims=True))
    return [(0, step, bool(k), *map(float, a), *map(float, c)) for k, a, c in zip(known, p, b, strict=True)]


def _plain(rows, motion, passes=2):
    """Gauss-Newton with differences for slopes, all in one place; then again without what is off."""
    known = np.array([r[2] for r in rows])
    p, b = np.array([r[3:6] for r in rows]), np.array([r[6:9] for r in rows])

    def errors(x, keep):
        m = p @ spin(x[None, :3])[0].T
        y = m + x[3:]
        size = np.linalg.norm(y, axis=1)
        one = np.where(known, (b[:, 2] * y[:, 0] - b[:, 0] * y[:, 2]) / size, (b * np.cross(x[3:], m)).sum(1) / max(np.linalg.norm(x[3:]), O.SHORTEST))
        two = np.where(known, (b[:, 2] * y[:, 1] - b[:, 1] * y[:, 2]) / size, 0)
        return np.r_[one[keep], two[keep]], np.hypot(one, two)

    x, keep = np.array(motion, float), np.ones(len(rows), bool)
    for _ in range(passes):
        for _ in range(40):
            e, _ = errors(x, keep)
            j = np.stack([(errors(x + h, keep)[0] - errors(x - h, keep)[0]) / 2e-6 for h in np.eye(6) * 1e-6], 1)
            x = x - np.linalg.lstsq(j, e, rcond=None)[0]
        off = errors(x, keep)[1]
        for kind in (True, False):
            own = off[known == kind]
            mid = np.median(own)
            keep[known == kind] = own <= mid + 3 * (1.4826 * np.median(np.abs(own - mid)) + 2.3e-16)
    return x


def test_motions_equal_a_plain_solve_and_short_steps_carry_on(spark):
    one, two = (0.02, -0.01, 0.03, 0.2, -0.1, 0.6), (-0.01, 0.02, 0.0, -0.1, 0.1, 0.4)
    seen = [_seen(1, 1, one, 80, 6), _seen(2, 3, two, 60, 0)]
    rows = seen[0] + seen[1] + _seen(4, 0, one, 5) + _seen(5, 2, two, 7) + [(0, 2, None, *[1.0] * 6), (0, 2, True, None, *[1.0] * 5), (0, 4, True, float("nan"), *[1.0] * 5)]
    got = {r["step"]: r for r in O.solve_motions(spark.createDataFrame(rows, SCHEMA), stored, rounds=8).collect()}
    assert [got[k]["solved"] for k in range(5)] == [False, True, False, True, False]
    assert got[0]["motion"] == [0.0, 0.0, 0.0, 0.0, 0.0, 0.1] and got[2]["motion"] == got[1]["motion"] and got[4]["motion"] == got[3]["motion"]
    assert (got[2]["known"] + got[2]["unknown"], got[4]["known"], got[4]["kept"]) == (7, 0, 0)
    assert np.allclose(got[3]["motion"], two, atol=1e-8) and np.allclose(got[1]["motion"], _plain(seen[0], one), atol=1e-7)
    assert np.allclose(got[1]["motion"], one, atol=0.02) and got[1]["kept"] <= 77


def test_no_sightings_give_no_motions(spark):
    assert O.solve_motions(spark.createDataFrame([], SCHEMA), stored, rounds=2).count() == 0


def test_slopes_of_residuals(spark):
    d = pd.DataFrame(_seen(7, 0, (0.1, 0.0, 0.0, 0.2, 0.0, 0.5), 20), columns=["graph", "step", "known", *O.SIGHT])
    x = np.array([0.08, 0.01, -0.02, 0.3, 0.1, 0.4])
    at = lambda x: O.residuals(d.assign(trial=[x] * 20, trial_r=[spin(x[None, :3])[0].ravel()] * 20))
    for k, h in enumerate(np.eye(6) * 1e-6):
        turned = lambda s: np.r_[O.axis_angle(spin(s * h[None, :3]) @ spin(x[None, :3]))[0], x[3:] + s * h[3:]]  # noqa: B023, E731
        for i in (0, 1):
            assert np.allclose((at(turned(1))[i] - at(turned(-1))[i]) / 2e-6, at(x)[i + 2][:, k], atol=1e-7)


@pytest.mark.parametrize("heavy", [10**6, 40])
def test_steps_of_any_size_get_the_same_motions(spark, monkeypatch, heavy):
    motions = [(0.02, -0.01, 0.03, 0.2, -0.1, 0.6), (-0.01, 0.02, 0.0, -0.1, 0.1, 0.4), (0.0, 0.01, 0.02, 0.1, 0.0, 0.5)]
    seen = [_seen(9 + k, k, m, 30 + 30 * k, 2 * k) for k, m in enumerate(motions)]
    monkeypatch.setattr(O, "HEAVY", heavy)
    monkeypatch.setattr(O, "PART", 7)
    got = {r["step"]: r for r in O.solve_motions(spark.createDataFrame(sum(seen, []), SCHEMA).repartition(5), stored, rounds=8).collect()}
    for k, m in enumerate(motions):
        assert np.allclose(got[k]["motion"], _plain(seen[k], m), atol=1e-7) and got[k]["known"] + got[k]["unknown"] == len(seen[k])
