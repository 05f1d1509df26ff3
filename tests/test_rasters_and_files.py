import numpy as np
import pandas as pd
import pytest

from prismfield.operators import kernels as K
from prismfield.operators import rasters as RS
from prismfield.operators import rows as R
from prismfield.sinks import files as W
from prismfield.sources import adapters as A
from prismfield.sources import files as S


def brute_components(mask, diagonal):
    cells = [tuple(c) for c in np.argwhere(mask)]
    label = {c: i for i, c in enumerate(cells)}
    near = lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 and (diagonal or abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1)
    for _ in cells:
        for a in cells:
            label[a] = min([label[b] for b in cells if near(a, b)] + [label[a]])
    return label


def test_components_and_voids_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(40):
        mask = rng.random((7, 8)) < 0.5
        for diagonal in (True, False):
            got, want = RS.components(mask, diagonal), brute_components(mask, diagonal)
            for a in want:
                assert all((got[a] == got[b]) == (want[a] == want[b]) for b in want)
        outside = {(i, j) for i, j in np.argwhere(~mask) if i in (0, 6) or j in (0, 7)}
        for _ in range(60):
            outside |= {(i, j) for i, j in map(tuple, np.argwhere(~mask)) if any((i + a, j + b) in outside for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
        assert {tuple(c) for c in np.argwhere(RS.voids(mask) > 0)} == {tuple(c) for c in np.argwhere(~mask)} - outside
        assert RS.without_small(mask, 1).sum() == mask.sum() and not RS.without_small(mask, 99).any()


def test_lattice_finds_a_planted_pitch():
    rng = np.random.default_rng(2)
    for pitch in (1.2, 2.5, 3.18):
        k = np.sort(rng.choice(20, 9, replace=False))
        p, c, rms = RS.lattice(0.4 + pitch * k + rng.normal(0, 1e-4, 9))
        ratio = pitch / p
        assert abs(ratio - round(ratio)) < 1e-2 or abs(1 / ratio - round(1 / ratio)) < 1e-2 or rms > 1e-3
    k = np.arange(8)
    assert RS.lattice(1.0 + 2.0 * k)[0] == pytest.approx(2.0)


def test_greedy_groups_follow_the_first_member():
    x = np.array([0.0, 0.9, 1.8, 5.0, 5.5, 0.2])
    assert RS.greedy_groups(np.abs(x[:, None] - x[None]) < 1).tolist() == [0, 0, 1, 2, 2, 0]


def test_knn_mean_equals_brute_force():
    p = np.random.default_rng(3).random((60, 3))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = [np.sort(np.delete(d[i], i))[:5].mean() for i in range(60)]
    assert K.knn_mean(p, 5, block=7) == pytest.approx(want)
    assert np.isnan(K.knn_mean(p[:1], 5)).all() and K.knn_mean(p[:2], 5) == pytest.approx([d[0, 1]] * 2)


def test_chains_do_not_commute():
    turns = np.stack([K.about_z(np.array([0.5]))[0], K.about_x(np.array([0.5]))[0], np.eye(3)])
    steps = np.ones((3, 3))
    want, r, t = [], np.eye(3), np.zeros(3)
    for a, s in zip(turns, steps, strict=True):
        t, r = t - r @ s, r @ a
        want.append(t)
    assert K.chain(turns, steps) == pytest.approx(np.array(want))
    assert not np.allclose(K.chain(turns[[1, 0, 2]], steps)[-1], want[-1])


def test_pitch_of_a_planted_profile():
    profile = np.zeros(60)
    profile[3::7] = 5
    assert K.autocorrelation_pitch(profile, 3, 20) == pytest.approx(7, abs=0.3)


def test_messages_and_files_round_trip_and_refuse_damage():
    p = np.array([[1.0, 2.0, 3.0], [np.nan, 0, 0], [4.5, -1.0, 0.25]])
    data = W.cloud_message(p, 5, 6)
    assert np.array_equal(np.stack(list(S.parse_cloud_message(data).values()), 1), p[[0, 2]])
    laser = W.laser_message(p[[0, 2]], np.array([1, 2]), np.array([3, 4]), 5, "any frame")
    assert S.parse_laser_message(laser)["line"].tolist() == [3, 4]
    for broken, parse in ((data[:-1], S.parse_cloud_message), (laser + b"x", S.parse_laser_message)):
        with pytest.raises(ValueError, match="another length"):
            parse(broken)
    cloud = pd.DataFrame({"x": [1.0, 2.0], "y": [0.5, 0.5], "z": [0.0, 1.0], "v": [1.0, 3.0], "c": [1, 2]})
    for encode in (W.binary_ply, W.ascii_ply):
        assert S.parse_cloud_file("/a/7.ply", encode(7, cloud))[["frame", "x"]].values.tolist() == [[7, 1.0], [7, 2.0]]
    assert len(S.parse_cloud_file("/a/7.pcd", W.ascii_pcd(7, cloud))) == 2
    with pytest.raises(ValueError, match="empty cloud"):
        S.parse_cloud_file("/a/7.ply", W.binary_ply(7, cloud.iloc[:0]))
    with pytest.raises(ValueError, match="not a 2-D map"):
        import io

        out = io.BytesIO()
        np.save(out, np.zeros(3))
        S.parse_map("/a/1.npy", out.getvalue())
    assert S.parse_map("/a/1.csv", b"1,2\n3,4\n")["v"].tolist() == [1, 2, 3, 4]
    db = W.recording(1, pd.DataFrame({"topic": ["b", "a"], "stamp": [2, 1], "id": [1, 2], "value": [0.5, 1.5]}))
    with pytest.raises(ValueError, match="no topic"):
        S.parse_recording("/a/1.db3", db, ["c"])
    assert S.parse_recording("/a/1.db3", db, ["a"])["value"].tolist() == [1.5]


def test_row_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (float("nan"), 0.0, 0.0), (float("inf"), 0.0, 0.0), (None, 0.0, 0.0), (2.0, 0.0, 0.0)], "x double, y double, z double")
    assert R.finite(df, ["x", "y", "z"]).count() == 2
    boxes = [(0, 0, 0, 2, 1, 1), (1.5, 0, 0, 3, 1, 1)]
    assert [r[0] for r in df.where("x < 3").select(R.box_label(("x", "y", "z"), boxes)).collect()] == [0, 1]
    with pytest.raises(ValueError, match="repeated"):
        A.checked_dimension(spark.createDataFrame([("a",), ("a",)], "k string"), "k", [])


def test_fused_rectangles_do_not_depend_on_order():
    draw = np.random.default_rng(11)
    near = RS.touching(0.1)
    for _ in range(60):
        low = draw.integers(0, 12, (9, 2))
        boxes = np.stack([low[:, 0], low[:, 0] + draw.integers(1, 4, 9), low[:, 1], low[:, 1] + draw.integers(1, 4, 9)], 1).astype(float)
        got, group = RS.fused(boxes, near)
        final = {g: tuple(got[g]) for g in group.tolist()}
        # Plainly: any near pair is replaced by its bounding box, in another order.
        plain = [tuple(b) for b in boxes[::-1]]
        while pair := next(((a, b) for i, a in enumerate(plain) for b in plain[:i] if near(a, b)), None):
            plain.remove(pair[0])
            plain.remove(pair[1])
            plain.append((min(pair[0][0], pair[1][0]), max(pair[0][1], pair[1][1]), min(pair[0][2], pair[1][2]), max(pair[0][3], pair[1][3])))
        assert sorted(final.values()) == sorted(plain)
        for b, g in zip(boxes, group.tolist(), strict=True):
            assert final[g][0] <= b[0] and b[1] <= final[g][1] and final[g][2] <= b[2] and b[3] <= final[g][3]
    assert not near((0, 1, 0, 1), (1, 2, 1, 2)) and near((0, 1, 0, 1), (1.05, 2, 0.5, 2)) and not near((0, 1, 0, 1), (1.2, 2, 0.5, 2))


def test_rooms_join_seeds_and_slivers():
    # Two agreeing halls, a taller one beside them, a sliver along two rooms, one behind the sliver, an island.
    rects = [(0, 3, 0, 3), (0, 3, 4, 7), (0, 3, 8, 11), (4, 4, 2, 9), (5, 5, 9, 9), (20, 20, 20, 20)]
    heights = np.array([(0, 2.5), (0, 2.6), (0, 4.0), (0, 1), (0, 1), (0, 1)], float)
    seed = np.array([True, True, True, False, False, False])
    assert RS.rooms(rects, heights, seed, 0.15).tolist() == [0, 0, 1, 0, 0, 2]
    assert RS.rooms(rects, heights, np.zeros(6, bool), 0.15).tolist() == [0, 1, 2, 3, 4, 5]
    assert RS.shared_edge(rects[0], rects[1]) == 4 and RS.shared_edge(rects[1], rects[3]) == 4 and RS.shared_edge(rects[3], rects[4]) == 1
    assert RS.shared_edge((0, 1, 0, 1), (2, 3, 2, 3)) == 0
    clash = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], bool)
    assert RS.first_without_clash(clash).tolist() == [True, False, True]
