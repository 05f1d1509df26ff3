import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismfield.functions import geometry as G
from prismfield.functions import radiometry as R
from prismfield.operators import kernels as K


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_transmittance_guards(spark):
    a, b, c = one(spark, R.transmittance(0.0, 50, 20), R.transmittance(-1.0, 50, 20), R.transmittance(10.0, 50, 20))
    assert a is None and b is None
    om = 0.5 * math.exp(1.5587 + 6.939e-2 * 20 - 2.7816e-4 * 400 + 6.8455e-7 * 8000)
    want = 1.9 * math.exp(-math.sqrt(10) * (0.006569 - 0.002276 * math.sqrt(om))) - 0.9 * math.exp(-math.sqrt(10) * (0.01262 - 0.00667 * math.sqrt(om)))
    assert c == pytest.approx(want)


def test_correction_is_identity_for_black_bodies(spark):
    a, b = one(spark, R.corrected(25.0, 1.0, 1.0, 20.0, 20.0), R.corrected(25.0, 0.0, 1.0, 20.0, 20.0))
    assert a == pytest.approx(25.0) and b is None


def test_u_values(spark):
    a, b, c, d = one(spark, R.u_value(29.0, 29.0, 36.9, 8.0), R.u_value(25.0, 20.0, 20.0, 8.0), R.u_sol_air(25.0, 29.0, F.lit(29.0), 8.0), R.film_ceiling(7.7, 25.0))
    assert a == 0 and b is None and c is None and round(d, 2) == 5.89


def test_construction_of_a_zero_bin_is_unphysical(spark):
    key, r, bad = one(spark, *R.construction(F.lit(0.01), 0.25, 7.7, 25.0, 0.001))
    assert (key, r, bad) == (0.0, 0.001, True)


def test_quaternions_and_projection(spark):
    s = math.sqrt(0.5)
    q = tuple(F.lit(v) for v in (0.0, 0.0, s, s))
    assert one(spark, *G.quaternion_rotate(q, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))) == pytest.approx((0, 1, 0), abs=1e-12)
    m = G.quaternion_matrix(tuple(F.lit(0.0) for _ in range(4)))
    assert one(spark, m[0][0], m[0][1]) == (1.0, 0.0)
    half = one(spark, *G.slerp([F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)], q, F.lit(0.5)))
    assert half == pytest.approx((0, 0, math.sin(math.pi / 8), math.cos(math.pi / 8)))
    k = dict.fromkeys(("k1", "k2", "p1", "p2", "k3"), 0.0) | {"fx": 100.0, "fy": 100.0, "cx": 50.0, "cy": 50.0}
    u, v, ok = one(spark, *G.project((F.lit(0.1), F.lit(0.2), F.lit(1.0)), k, 100, 100))
    assert (u, v, ok) == (60.0, 70.0, True)
    assert one(spark, G.project((F.lit(0.1), F.lit(0.2), F.lit(-1.0)), k, 100, 100)[2])[0] is False


def test_kernels_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((6, 7)) < 0.7
        best = max(((b - a) * (d - c) for a in range(6) for b in range(a + 1, 7) for c in range(7) for d in range(c + 1, 8) if mask[a:b, c:d].all()), default=0)
        assert K.largest_rectangle(mask)[0] == best
    boxes = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30]], float)
    assert K.nms(boxes, np.array([0.9, 0.95, 0.1]), 0.5).tolist() == [1, 2]
    assert K.monotone(np.array([1, 3, 2, 4])).tolist() == [True, True, False, True]
    assert K.keyframes(np.array([[0.0], [0.4], [1.1], [1.5]]), 1.0).tolist() == [0, 2]
    assert sum((c - a) * (d - b) for a, b, c, d in K.subtract((0, 0, 4, 4), [(1, 1, 2, 2), (3, 3, 9, 9)])) == 16 - 1 - 1
    assert K.autocorrelation_pitch(np.tile([5.0, 0, 0, 0], 10), 2, 10) == pytest.approx(4, abs=0.3)
    assert K.nearest_fill(np.array([0, 0]), np.array([0, 4]), np.array([1.0, 2.0]), (1, 5)).tolist() == [[1, 1, 1, 2, 2]]
    p = np.c_[rng.random((50, 2)), np.full(50, 3.0)]
    n, d, inside = K.ransac_plane(p, 0.01, 20, 0)
    assert abs(n[2]) == pytest.approx(1) and inside.all()
