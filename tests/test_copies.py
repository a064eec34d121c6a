"""Points that are copies of others: pairs are made of places, not of points."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from nubes.operators import neighbors, segment, select
from nubes.sources import documents

P = "point_id long, x double, y double, z double"
PLACES = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 2.0, 0.0), (9.0, 9.0, 9.0)]


@pytest.fixture
def copies(spark):
    """600 copies of each of four places, of which three are near each other."""
    return spark.createDataFrame([(4 * k + i, *v) for k in range(600) for i, v in enumerate(PLACES)], P)


@pytest.fixture
def few_pairs(monkeypatch):
    """What neighbor_pairs gave; none of it may have more rows than pairs of places."""
    made = []
    for m in (neighbors, segment):
        monkeypatch.setattr(m, "neighbor_pairs", lambda *a, f=neighbors.neighbor_pairs, **b: made.append(f(*a, **b)) or made[-1])
    yield
    assert made and all(df.count() <= 100 for df in made)


def test_sums_over_copies(copies, few_pairs):
    got = {r.q_id: r for r in neighbors.neighborhood_sums(copies, copies, 2.0).collect()}
    assert len(got) == 2400
    for i, (n, xx, yy) in enumerate([(1200, 600.0, 0.0), (1800, 600.0, 2400.0), (1200, 0.0, 2400.0), (600, 0.0, 0.0)]):
        assert {(got[k].n, got[k].xx, got[k].yy) for k in range(i, 2400, 4)} == {(n, xx, yy)}
    some = copies.where("point_id % 400 = 1")
    assert {(r.q_id, r.n) for r in neighbors.neighbor_counts(some, copies, 2.0).collect()} == {(k, 1800) for k in range(1, 2400, 400)}


def test_borders_of_copies(copies, few_pairs):
    regions = copies.select("point_id", F.expr("CASE WHEN point_id % 4 = 3 THEN -1 WHEN point_id % 4 = 0 THEN point_id div 4 % 3 ELSE 5 END").alias("region_id"))
    rows = segment.region_boundaries(copies, regions, 1.5).collect()
    want = {(min(r, o), max(r, o), 4 * k) for k in range(600) for r in [k % 3] for o in (0, 1, 2, 5) if o != r} | {(o, 5, 4 * k + 1) for k in range(600) for o in (0, 1, 2)}
    assert len(rows) == len(want) and {(r.src, r.dst, r.point_id) for r in rows} == want
    n = Counter(w[:2] for w in want)
    assert {(r.src, r.dst): r.n_boundary for r in segment.region_graph(copies, regions, 1.5).collect()} == dict(n)


def test_clean_up_of_copies(spark, few_pairs):
    flat = [(k, float(k % 20), float(k // 20 % 20), 0.0, 0) for k in range(400)] + [(k, float(k % 20), float(k // 20 % 20), 3.0, 1) for k in range(400, 800)]
    free = [(1000 + k, 4.0, 4.0, (1.0, 2.0, 9.0)[k % 3], -1) for k in range(900)]
    p = spark.createDataFrame(flat + free, P + ", region_id long")
    got = {r.point_id: r.region_id for r in segment.clean_up(p.drop("region_id"), p.select("point_id", "region_id"), 1.0, 3.0).collect()}
    assert got == {r[0]: r[4] for r in flat} | {1000 + k: (0, 1, -1)[k % 3] for k in range(900)}


def test_positions_read_the_points_once(spark):
    p = spark.range(1000, 0, -1).select(F.col("id").alias("point_id"), (F.col("id") % 7).alias("v"))
    got = select.with_position(p, 5)
    assert "Range (" not in got._jdf.queryExecution().toString()  # from the written table alone
    assert sorted(map(tuple, got.collect())) == [(k, k % 7, k - 1) for k in range(1, 1001)]


def test_export_writes_few_files(spark, tmp_path):
    p = spark.range(0, 4000, 1, 40).selectExpr("id AS point_id", "id % 2 AS chunk_id", "nullif(id % 3, 0) AS region_id", "id * 1D AS x")
    documents.export_regions(p, str(tmp_path / "out"), ("x",))
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= 12
    back = spark.read.parquet(str(tmp_path / "out")).groupBy("chunk_id", "region_id").count().collect()
    assert len(back) == 6 and sum(r["count"] for r in back) == 4000
