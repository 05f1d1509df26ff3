import random

from pyspark.sql import functions as F

from prismfield.operators import space as S
from prismfield.operators import timeline as T
from prismfield.operators.components import connected_components
from prismfield.sources.adapters import cut


def test_asof_prefers_the_earlier_of_equally_near(spark):
    t = spark.createDataFrame([(1, 2.0), (2, -5.0), (3, 99.0)], "id int, t double")
    s = spark.createDataFrame([(0.0, 10), (4.0, 11)], "t double, v int")
    got = {r["id"]: r["match"]["v"] for r in T.asof_nearest(t, s, ["v"]).collect()}
    assert got == {1: 10, 2: 10, 3: 11}
    near = {r["id"]: r["match"] and r["match"]["v"] for r in T.asof_nearest(t, s, ["v"], 2.0).collect()}
    assert near == {1: 10, 2: None, 3: None}


def test_asof_across_buckets_equals_brute_force(spark):
    rng = random.Random(3)
    ts, ss = [rng.uniform(0, 1000) for _ in range(80)], sorted(rng.uniform(0, 1000) for _ in range(25))
    t = spark.createDataFrame(list(enumerate(ts)), "id int, t double")
    s = spark.createDataFrame([(x, i) for i, x in enumerate(ss)], "t double, v int")
    got = {r["id"]: r["match"]["v"] for r in T.asof_nearest(t, s, ["v"], width=10.0).collect()}
    assert got == {i: min(range(25), key=lambda k: (abs(ss[k] - x), ss[k])) for i, x in enumerate(ts)}


def test_radius_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(120)]
    df = spark.createDataFrame(pts, "id int, x double, y double, z double")
    got = {(r.a.id, r.b.id) for r in S.radius_pairs(df, df, 1.5).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if sum((p - q) ** 2 for p, q in zip(a[1:], b[1:], strict=True)) <= 2.25}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), cut).collect()}
    assert got == {x: root(x) for x in parent}


def test_octree_folds_the_far_face_and_levels_end_in_one_root(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (8.0, 8.0, 8.0), (1.0, 0.0, 0.0)], "x double, y double, z double")
    assert max(r["i"] for r in S.octree_cells(df, 3).collect()) == 7
    levels = {r["level"]: r["nodes"] for r in S.octree_levels(df, 3).collect()}
    assert levels[0] == 1 and levels[3] == 3


def test_ring_fill_of_a_chain(spark):
    tiles = spark.createDataFrame([(1, 5.0), (2, None), (3, None), (4, None)], "id int, value double")
    e = [(1, 2), (2, 3), (3, 4)]
    edges = spark.createDataFrame(e + [(b, a) for a, b in e], "src int, dst int")
    assert {r["id"]: (r["value"], r["ring"]) for r in S.ring_fill(tiles, edges, cut).collect()} == {1: (5.0, 0), 2: (5.0, 1), 3: (5.0, 2), 4: (5.0, 3)}


def test_ring_fill_has_no_last_ring_of_its_own(spark):
    e = [(i, i + 1) for i in range(1, 61)] + [(1, 101), (101, 102), (102, 3), (70, 71)]
    edges = spark.createDataFrame(e + [(b, a) for a, b in e], "src int, dst int")
    tiles = spark.createDataFrame([(1, 5.0), (61, None), (101, 8.0), (102, None), (70, None), (71, None)] + [(i, None) for i in range(2, 61)], "id int, value double")
    got = {r["id"]: (r["value"], r["ring"]) for r in S.ring_fill(tiles, edges, cut).collect()}
    assert got[2] == (5.0, 1) and got[102] == (8.0, 1) and got[3] == (6.5, 2) and got[61] == (6.5, 60) and got[70] == got[71] == (None, None) and len(got) == 65
    near = {r["id"]: r["ring"] for r in S.ring_fill(tiles, edges, cut, most_rings=2).collect()}
    assert near[3] == 2 and near[4] is None


def test_corner_contact_is_not_adjacent(spark):
    from prismfield.plans.space_plans import tile_edges

    t = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 1.0, 2.0, 1.0, 2.0), (3, 1.0, 2.0, 0.0, 1.0)], "id int, lo_x double, hi_x double, lo_y double, hi_y double")
    assert {(r.src, r.dst) for r in tile_edges(t).where("src < dst").collect()} == {(1, 3), (2, 3)}


def test_runs_and_sessions(spark):
    df = spark.createDataFrame([("a", float(t), v) for t, v in ((0, 1), (1, 1), (2, 0), (3, 1), (60, 1))], "k string, t double, v int")
    assert sorted(r["length"] for r in T.runs(df, ["k"], "t", F.col("v") == 1).collect()) == [2, 2]
    assert T.sessions(df, "k", 30.0).agg(F.max("session")).first()[0] == 1
    assert T.gaps(df, "k", 5.0, 10.0).collect()[0]["missing"] == 56


def test_range_join_broadcasts_no_spread_boxes(spark):
    p = spark.createDataFrame([(0.5, 0.5)], "x double, y double")
    boxes = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0)], "id int, lo_x double, hi_x double, lo_y double, hi_y double")
    near = S.range_join(p, boxes, ["x", "y"], [0.3, 0.3], [1.0, 1.0])
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString() and near.count() == 1


def test_places_within_a_radius_are_counted_once_for_all_copies(spark):
    rng = random.Random(6)
    a, b = ([(float(rng.randrange(5)), float(rng.randrange(5)), 0.0) for _ in range(30)] for _ in range(2))
    frame = lambda pts: spark.createDataFrame(pts, "x double, y double, z double")
    got = S.radius_places(frame(a * 4), frame(b * 3), 1.5).collect()
    assert len(got) == len({(p, q) for p in a for q in b if sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) <= 2.25})
    assert sum(r.a.n * r.b.n for r in got) == 12 * sum(sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) <= 2.25 for p in a for q in b)


def test_tile_edges_meet_by_stretches_of_a_line(spark):
    from prismfield.plans.space_plans import tile_edges

    rng = random.Random(7)
    rows = []
    for i in range(60):
        x, y = rng.randrange(6), rng.randrange(40)
        rows.append((i, float(x), x + 1.0, float(y), y + float(rng.choice([1, 1, 2, 30]))))
    edges = tile_edges(spark.createDataFrame(rows, "id int, lo_x double, hi_x double, lo_y double, hi_y double")).where("src < dst")
    touch = lambda a, b: (a[2] == b[1] or b[2] == a[1]) and min(a[4], b[4]) > max(a[3], b[3]) or (a[4] == b[3] or b[4] == a[3]) and min(a[2], b[2]) > max(a[1], b[1])
    assert {(r.src, r.dst) for r in edges.collect()} == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and touch(a, b)}
    joins = [line for line in edges._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in line]
    assert joins and all("cell" in line for line in joins)


def test_ring_fill_takes_few_jobs_and_is_the_same_in_any_blocks(spark):
    rng = random.Random(9)
    ids = range(400)
    e = [(i, i + 1) for i in range(399) if rng.random() < 0.97] + [tuple(sorted(rng.sample(ids, 2))) for _ in range(12)]
    tiles = [(i, float(rng.randrange(9)) if rng.random() < 0.01 or i == 0 else None) for i in ids]
    near = {i: [] for i in ids}
    for a, b in e:
        near[a].append(b)
        near[b].append(a)
    want = {i: (v, 0) for i, v in tiles if v is not None}
    for ring in range(1, 401):
        told = {i: [want[j][0] for j in near[i] if j in want] for i in ids if i not in want}
        want |= {i: (sum(v) / len(v), ring) for i, v in told.items() if v}
    t, edges = spark.createDataFrame(tiles, "id int, value double"), spark.createDataFrame(e + [(b, a) for a, b in e], "src int, dst int")
    for per_block in (1000, 60):
        cuts = []
        got = {r["id"]: (r["value"], r["ring"]) for r in S.ring_fill(t, edges, lambda df, label: cuts.append(label) or cut(df, label), per_block=per_block).collect()}
        assert {i: r for i, (_, r) in got.items() if r is not None} == {i: r for i, (_, r) in want.items()}
        assert all(abs(got[i][0] - v) < 1e-9 for i, (v, _) in want.items())
        assert len(cuts) < max(r for _, r in want.values())
