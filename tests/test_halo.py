"""Sums of clouds that are crowded all over, taken in blocks with a halo, and how they reach the points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubes.functions import storage
from nubes.operators import halo, moments, neighbors

P = "point_id long, x double, y double, z double"
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


def brute(q, d, w, r):
    out = []
    for v in q:
        o = d - v
        near = (o * o).sum(axis=1) <= r * r
        out.append((w[near].sum(), *((o[near, i] * o[near, j] * w[near]).sum() for i, j in PAIRS)))
    return np.array(out)


@pytest.mark.parametrize("filled", [2, 8, 10_000])
def test_block_sums_equal_brute_force(monkeypatch, filled):
    monkeypatch.setattr(halo, "FILLED", filled)
    monkeypatch.setattr(halo, "AT_ONCE", 64)
    monkeypatch.setattr(halo, "CELLS", 7)
    rng = np.random.default_rng(filled)
    flat = rng.integers(-300, 300, (700, 3)) * [1, 1, 0]
    d = np.unique(np.concatenate([flat, flat[:300] + [0, 0, 100], rng.integers(0, 12, (300, 3)), rng.integers(-300, 300, (200, 3))]), axis=0).astype(float)
    w = rng.integers(1, 5, len(d)).astype(float)
    q = np.concatenate([d[::3], rng.integers(-400, 400, (50, 3))])
    assert (halo.block_sums(q, d, w, 100.0) == brute(q, d, w, 100.0)).all()
    q, d = q / 7 + 1e3, d / 7 + 1e3
    assert np.allclose(halo.block_sums(q, d, w, 100.0 / 7), brute(q, d, w, 100.0 / 7), rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("room", [1 << 20, 900])
def test_crowded_all_over(spark, monkeypatch, room):
    """F7 to F10: no pair is shuffled, and cells too full for a block still count."""
    monkeypatch.setattr(neighbors, "SPREAD", 100)
    monkeypatch.setattr(moments, "CROWDED", 20)
    monkeypatch.setattr(halo, "ROOM", room)
    taken = []
    monkeypatch.setattr(neighbors, "halo_sums", lambda *a, f=halo.halo_sums: taken.append(f(*a)) or taken[-1])
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.integers(0, 500, (2500, 3)) * [1, 1, 0], rng.integers(-9, 9, (700, 3)) + 250, rng.integers(-3000, 3000, (300, 3))]).astype(float)
    p = spark.createDataFrame([(i, *map(float, v), i % 2) for i, v in enumerate(at)], P + ", half long")
    for keys in ((), ("half",)) if room > 900 else ((),):
        got = {r.q_id: tuple(r)[-7:] for r in neighbors.neighborhood_sums(p, p, 100.0, keys).select("q_id", "n", *neighbors.SIX).collect()}
        assert len(got) == len(at)
        for part in (0, 1) if keys else (slice(None),):
            ids = np.arange(len(at))[part::2] if keys else np.arange(len(at))
            want = brute(at[ids], at[ids], np.ones(len(ids)), 100.0)
            assert all(got[i] == tuple(v) for i, v in zip(ids, want, strict=True))
    assert all((over is not None) == (room == 900) for _, over in taken)
    some = p.where("point_id % 5 = 0")
    want = brute(at[::5], at, np.ones(len(at)), 100.0)
    assert {r.q_id: r.n for r in neighbors.neighbor_counts(some, p, 100.0).collect()} == {5 * i: int(v[0]) for i, v in enumerate(want)}
    assert len(taken) == (3 if room > 900 else 2)


@pytest.mark.parametrize("small", [1 << 17, 1500, 10])
def test_points_get_the_rows_of_their_place(spark, monkeypatch, small):
    """F7 to F10: points are not shuffled where places, or copies, are few."""
    monkeypatch.setattr(neighbors, "SMALL", small)
    p = spark.range(2000).selectExpr("id AS point_id", "IF(id < 1900, id, id % 3) * 1D AS x", "0D AS y", "0D AS z", "id % 2 AS k")
    out = neighbors.neighborhood_sums(p, p, 0.5, ("k",))
    at = p.groupBy("k", "x").count()
    want = {r.point_id: r["count"] for r in p.join(at, ["k", "x"]).collect()}
    assert {r.q_id: r.n for r in out.collect()} == want and out.count() == 2000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (small > 10)


def test_written_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    """files of a few bytes a row made Spark send long tables to the driver."""
    monkeypatch.setattr(storage, "SMALL", 100)
    many, few = storage.sized(spark.range(1000)), storage.sized(spark.range(100))
    assert (many._rows, few._rows) == (1000, 100)
    kind = lambda a, b: a.join(b.withColumn("v", F.col("id") * 2), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in kind(many, many) and "BroadcastHashJoin" in kind(few, few)
    assert many.join(few, "id").count() == 100
    storage.discard(many)
    assert not hasattr(many, "_written_to")
