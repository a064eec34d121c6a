"""Seeded growth, sums by moments, components by contraction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubes.functions import storage
from nubes.operators import growth, moments, neighbors, segment

P = "point_id long, x double, y double, z double"
GRID = [(i * 0.02, j * 0.02) for i in range(20) for j in range(20)]
PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def test_crossing_planes_are_found_whole(spark):
    rows = [(k, x, y, 0.0) for k, (x, y) in enumerate(GRID)] + [(1000 + k, 0.21, y, x - 0.2) for k, (x, y) in enumerate(GRID)] + [(9000 + k, 50.0 + k, 0.0, 0.0) for k in range(10)]
    named, planes = growth.grow_planes(spark.createDataFrame(rows, P), epsilon=0.05, min_points=100)
    got = {r.point_id: r.region_id for r in named.collect()}
    first = [got[i] for i in range(400)]
    other = [got[1000 + i] for i in range(400)]
    assert first.count(0) >= 340 and set(first) <= {0, -1} | set(other) and other.count(max(other, key=other.count)) >= 340
    assert all(got[9000 + k] == -1 for k in range(10))
    found = {r.region_id: r for r in planes.collect()}
    assert len(found) == 2 and sorted(r.n for r in found.values()) == sorted(sum(v == k for v in got.values()) for k in found)
    assert abs(found[0].plane[2]) > 0.999
    for i, x, y, z in rows:
        if got[i] >= 0:
            r = found[got[i]]
            assert abs(np.dot(r.plane, [x - r.px, y - r.py, z - r.pz])) <= 0.15 + 1e-9


def test_ridges_oriented_normals_and_limits(spark):
    # two sheets that face away from each other, one cell apart
    rows = [(k, x, y, 0.0, [0.0, 0.0, 1.0]) for k, (x, y) in enumerate(GRID)] + [(1000 + k, x, y, 0.03, [0.0, 0.0, -1.0]) for k, (x, y) in enumerate(GRID)]
    p = spark.createDataFrame(rows, P + ", n array<double>")
    both = {r.point_id: r.region_id for r in growth.segment_planes(p, epsilon=0.05, min_points=100, normal="n").collect()}
    assert set(both.values()) == {0}
    apart = {r.point_id: r.region_id for r in growth.segment_planes(p, epsilon=0.05, min_points=100, normal="n", oriented=True).collect()}
    assert {apart[i] for i in range(400)} == {0} and {apart[1000 + i] for i in range(400)} == {1000}
    few = growth.grow_planes(p, epsilon=0.05, min_points=401, normal="n", oriented=True)
    assert few[0].where("region_id >= 0").count() == 0 and few[1].count() == 0
    assert growth.segment_planes(p.limit(0), epsilon=0.05).count() == 0


def test_failing_attempts_end_the_search(spark, monkeypatch):
    xyz = np.random.default_rng(4).uniform(0, 1, (300, 3))
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], P)
    tried = []
    monkeypatch.setattr(growth, "grow", lambda *a, f=growth.grow, **b: tried.append(1) or f(*a, **b))
    out = growth.segment_planes(p, epsilon=0.2, k=0.2, min_points=200, tracker_size=4, min_success_ratio=0.9)
    assert out.where("region_id >= 0").count() == 0 and len(tried) == 1


def test_chunks_take_normals_from_both_sides(spark):
    p = spark.createDataFrame([(k, x, y, 0.0) for k, (x, y) in enumerate(GRID)], P)
    got = growth.segment_chunked(p, 2, 1, 1, epsilon=0.05, min_points=60).collect()
    assert {(r.region_id, r.region_number) for r in got} == {(0, 0), (200, 1)} and {r.region_id for r in got if r.point_id >= 200} == {200}


def test_moments_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(moments, "CROWDED", 20)
    monkeypatch.setattr(moments, "LEAF", 30)
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.integers(-200, 400, (500, 3)), rng.integers(0, 60, (250, 3)) - 100, rng.integers(0, 3000, (200, 3)), np.full((150, 3), 777)]).astype(float)
    p = spark.createDataFrame([(i, *map(float, v), i % 2) for i, v in enumerate(xyz)], P + ", half long")
    for keys in ((), ("half",)):
        got = {r.q_id: tuple(r)[-7:] for r in neighbors.neighborhood_sums(p, p, 150.0, keys).select("q_id", "n", *neighbors.SIX).collect()}
        assert len(got) == len(xyz)
        for i, v in enumerate(xyz):
            d = (xyz[i % 2 :: 2] if keys else xyz) - v
            d = d[(d**2).sum(axis=1) <= 150**2]
            assert got[i] == (len(d), *(float((d[:, a] * d[:, b]).sum()) for a, b in PAIRS))
    some = p.where("point_id % 7 = 0")
    part = {r.q_id: r.n for r in neighbors.neighborhood_sums(some, p, 150.0).collect()}
    assert part == {i: int((((xyz - xyz[i]) ** 2).sum(axis=1) <= 150**2).sum()) for i in range(0, len(xyz), 7)}


def test_a_crowded_cell_makes_no_pairs(spark, monkeypatch):
    """20,000 points close together and as many spread: nothing is paired inside
    the crowd, which alone has 400 million pairs."""
    seen = []
    p = spark.range(40_000).selectExpr("id AS point_id", *(f"IF(id < 20000, 500D + pmod(xxhash64(id, {k}), 20), CAST(pmod(xxhash64(id, {k}), 4000) AS double)) AS {c}" for k, c in enumerate("xyz")))
    monkeypatch.setattr(moments, "materialise", lambda df, f=moments.materialise: seen.append(f(df)) or seen[-1])
    n = {r.q_id: r.n for r in neighbors.neighborhood_sums(p, p, 100.0).where("q_id % 4001 = 0").collect()}
    xyz = np.array([tuple(r) for r in p.orderBy("point_id").select("x", "y", "z").collect()])
    assert n == {i: int((((xyz - xyz[i]) ** 2).sum(axis=1) <= 100.0**2).sum()) for i in range(0, 40_000, 4001)}
    kinds = [t for t in seen if "kind" in t.columns]
    assert any(t.where("kind = 'in' AND qx = dx AND qy = dy AND qz = dz").count() for t in kinds)


def test_components_by_contraction(spark, monkeypatch):
    sizes = []

    def written(df, *a, f=storage.materialise):
        out = f(df, *a)
        if out.columns == ["x", "y"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(storage, "materialise", written)
    path = spark.range(20_000).selectExpr("id AS a", "id + 1 AS b")
    star = spark.range(1, 500).selectExpr("30000L AS a", "30000 + id AS b")
    got = storage.contract_components(path.unionAll(star)).groupBy("label").count().collect()
    assert sorted((r.label, r["count"]) for r in got) == [(0, 20_001), (30_000, 500)]
    assert all(b < 0.9 * a for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] == 0
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2))]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in storage.contract_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert storage.contract_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert [tuple(r) for r in storage.contract_components(spark.createDataFrame([(5, 5)], "a long, b long")).collect()] == [(5, 5)]


def test_blocks_are_bounded_and_their_regions_put_together(spark, monkeypatch):
    """F3 to F8: growth is dealt in blocks of bounded size; a plane over many
    blocks, more points than a block holds at one spot, and copies of places
    are one region, found in one round."""
    monkeypatch.setattr(growth, "BLOCK", 60)
    crowd = [(0.2 + 0.0001 * i, 0.2 + 0.0001 * j) for i in range(12) for j in range(12)]
    at = [*GRID, *crowd]
    p = spark.createDataFrame([(k, x, y, 0.0) for k, (x, y) in enumerate([*at, *at])], P)
    free = p.selectExpr("*", "array(0D, 0D, 1D) AS normal", "0D AS flat", "1L AS w", "0L AS tries")
    sizes = growth.blocks(free, 0.05, [], 1).groupBy("level", "bx", "by", "bz", "part").count().collect()
    assert sum(r["count"] for r in sizes) == 2 * len(at) and len(sizes) > 10 and max(r["count"] for r in sizes) <= 2 * 60
    tried = []
    monkeypatch.setattr(growth, "grow", lambda *a, f=growth.grow, **b: tried.append(1) or f(*a, **b))
    named, planes = growth.grow_planes(p, epsilon=0.05, min_points=100)
    assert {r.region_id for r in named.collect()} == {0} and [r.n for r in planes.collect()] == [2 * len(at)] and len(tried) == 1


def test_points_are_not_written(spark, monkeypatch):
    """F1 to F4: copies of places cost no disk; only places are written."""
    rows = []
    monkeypatch.setattr(storage, "materialise", lambda df, *a, f=storage.materialise: rows.append(f(df, *a)) or rows[-1])
    monkeypatch.setattr(growth, "materialise", storage.materialise)
    p = spark.createDataFrame([(400 * c + k, x, y, 0.0, k % 2) for c in range(30) for k, (x, y) in enumerate(GRID)], P + ", half long")
    monkeypatch.setattr(growth, "discard", lambda *a: None)
    got = growth.grow_planes(p, epsilon=0.05, min_points=100)[0]
    assert rows and all(t.count() <= 26 * 400 for t in rows if hasattr(t, "_written_to"))
    assert got.groupBy("region_id").count().collect() == [(0, 12_000)]
    halves = growth.segment_planes(p, epsilon=0.05, min_points=100, chunk="half")
    assert sorted(map(tuple, halves.groupBy("half", "region_id").count().collect())) == [(0, 0, 6000), (1, 1, 6000)]
