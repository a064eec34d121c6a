import itertools
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubes.functions.color import dark_text
from nubes.operators import fields, grid, growth, labels, neighbors, schema, segment, select
from nubes.sources import documents, toollog
from nubes.sources.npy import cloud_from_arrays, read_npy
from nubes.sources.ply import read_ply, write_ply

FOUR = [(0, 10.0, 10.0, 10.0), (1, 11.0, 10.0, 10.0), (2, 10.0, 11.0, 10.0), (3, 10.0, 10.0, 11.0)]
P = "point_id long, x double, y double, z double"


def ids(df, c="point_id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_four_points(spark):
    p = spark.createDataFrame(FOUR, P)
    assert grid.voxel_groups(p, 1.0).count() == 4
    assert ids(neighbors.radius_query(p, (10, 10, 10), 1.5)) == [0, 1, 2, 3]
    assert ids(neighbors.radius_query(p, (10, 10, 10), 0)) == []


def test_bad_shape(spark):
    with pytest.raises(ValueError, match=r"positive_coords must be a \(N,3\) float array"):
        cloud_from_arrays(spark, np.array([0.0, 1, 2]))


@pytest.mark.parametrize("shift", [0.0, -100.0])
def test_pairs_and_eigen_against_brute_force(spark, shift):
    rng = np.random.default_rng(3)
    xyz = rng.uniform(0, 3, (150, 3)) + shift
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], P)
    got = {(r.q_id, r.p_id) for r in neighbors.neighbor_pairs(p, p, 0.7).collect()}
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    assert got == {(i, j) for i, j in itertools.product(range(150), repeat=2) if d[i, j] <= 0.49}
    for r in neighbors.compute_features(p, 0.7).collect():
        off = xyz[d[r.point_id] <= 0.49] - xyz[r.point_id]
        w, v = np.linalg.eigh(off.T @ off)
        assert np.allclose(r.eigenvalues, np.maximum(w, 0), atol=1e-7)
        if r.normal is not None and w[1] - w[0] > 1e-3:
            assert abs(abs(np.dot(r.normal, v[:, 0])) - 1) < 1e-5


def test_isolated_point_has_no_ratios(spark):
    r = neighbors.compute_features(spark.createDataFrame(FOUR[:1], P), 0.5).first()
    assert r.n == 1 and r.planarity is None and r.sphericity is None and r.normal is None


def test_join_plan_is_an_equi_join_without_python(spark):
    p = spark.createDataFrame(FOUR, P)
    plan = neighbors.compute_features(p, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_selections(spark):
    a, b = (spark.createDataFrame([(i,) for i in v], "point_id long") for v in ((1, 2, 3), (3, 4)))
    want = {"UNION": [1, 2, 3, 4], "DIFFERENCE": [1, 2], "INTERSECTION": [3], "EXCLUSION": [1, 2, 4], "OVERWRITE": [3, 4]}
    for how, v in want.items():
        assert ids(select.combine(a, b, how)) == v


def test_polygon_notch(spark):
    p = spark.createDataFrame([(0, 1.0, 1.0, 0.0), (1, 2.0, 3.0, 0.0), (2, 5.0, 5.0, 0.0)], P)
    m = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    shape = [((x + 1) / 2 * 2, (y + 1) / 2 * 2) for x, y in ((0, 0), (4, 0), (4, 4), (2, 2), (0, 4))]
    assert ids(select.polygon_select(p, shape, m, 2, 2)) == [0]
    assert ids(select.polygon_select(p, shape, m, 2, 2, "out")) == [1, 2]
    assert ids(select.polygon_select(p, shape[:2], m, 2, 2)) == []


def test_visibility_and_positions(spark):
    p = spark.range(100).select(F.col("id").alias("point_id"), F.lit(None).cast("boolean").alias("visible"))
    s = p.where("point_id < 10").select("point_id")
    hidden = select.hide(p, s)
    assert select.visible_points(hidden).count() == 90
    assert select.visible_points(select.show_all(hidden)).count() == 100
    pos = select.with_position(select.visible_points(hidden), buckets=7)
    assert sorted((r.point_id, r.position) for r in pos.collect()) == [(i, i - 10) for i in range(10, 100)]
    assert select.counts(hidden, s).first() == (90, 100, 10)


def test_labels(spark):
    p = spark.createDataFrame([(0, -1, 0), (1, 0, 1), (2, 1, 3), (3, 5, 0)], "point_id long, sem int, inst int")
    assert labels.mex(p, "inst").first().mex == 2
    assert labels.mex(p.limit(0), "inst").first().mex == 0
    assert [r.sem for r in labels.remap(p, "sem", [(0, 1), (1, 0)]).orderBy("point_id").collect()] == [-1, 1, 0, 5]
    s = spark.createDataFrame([(3,)], "point_id long")
    r = labels.annotate(p, s, "sem", 4, "inst").orderBy("point_id").collect()
    assert (r[3].sem, r[3].inst) == (4, 2) and (r[0].sem, r[0].inst) == (-1, 0)
    assert {r.label for r in labels.flatten_labels(p, ["sem", "inst"]).collect()} == {0, 1, 2, 3}
    log = spark.createDataFrame([(1, 0, "sem", 7), (2, 0, "sem", 8), (3, 1, "sem", 9)], "edit_seq long, point_id long, field string, new int")
    assert [r.sem for r in labels.replay_edits(p, log, "sem", 2).orderBy("point_id").collect()] == [8, 0, 1, 5]


def test_schema_rules(spark):
    c = spark.createDataFrame([(-1, "_unlabeled", [1, 1, 1]), (0, "wall", [2, 2, 2]), (1, "floor", [3, 3, 3]), (3, "door", [4, 4, 4])], "id int, name string, color array<int>")
    assert [(r.rule, r.key) for r in schema.violations(c).collect()] == [("gap", "2")]
    assert {(r.old_id, r.new_id) for r in schema.reindex(c).collect()} == {(-1, -1), (0, 0), (1, 1), (3, 2)}
    assert {r.id for r in schema.add_class(c, "window", (9, 9, 9)).collect()} == {-1, 0, 1, 2, 3}
    one = c.agg(F.collect_list(F.struct("id", "name", "color")).alias("classes"))
    back = one.select(schema.schema_from_json(schema.schema_to_json(F.col("classes"))).alias("c")).first().c
    assert [x["id"] for x in back] == [-1, 0, 1, 3] and back[3]["name"] == "door"


def test_planes_components_cleanup(spark):
    g = [(i * 0.02, j * 0.02) for i in range(20) for j in range(20)]
    rows = [(k, x, y, 0.0) for k, (x, y) in enumerate(g)] + [(1000 + k, x + 5, 0.0, y) for k, (x, y) in enumerate(g)] + [(9000 + k, 50.0 + k, 0.0, 0.0) for k in range(10)]
    p = spark.createDataFrame(rows, P)
    r = growth.segment_planes(p, epsilon=0.05, min_points=100, max_rounds=1)
    got = {x.point_id: x.region_id for x in r.collect()}
    assert {got[i] for i in range(400)} == {0} and {got[1000 + i] for i in range(400)} == {1000} and {got[9000 + i] for i in range(10)} == {-1}
    part = r.withColumn("region_id", F.when(F.col("point_id") == 210, -1).otherwise(F.col("region_id")))
    assert segment.clean_up(p, part, 0.05).where("point_id = 210").first().region_id == 0
    assert segment.voxel_components(p, 0.05).select("component").distinct().count() == 12


def test_plane_rounds_go_on_until_none_finds_a_region(spark, monkeypatch):
    # one component of ever smaller flaps, each pair of them flat enough only once the larger ones are gone
    from nubes.plans import queries

    rows, x, z = [], 0.0, 0.0
    for f, (n, w) in enumerate([(40, 40), (2, 12), (16, 24), (2, 10), (10, 10), (2, 6), (6, 6)]):
        for i in range(n):
            rows += [(len(rows) + j, x, j * 0.32, z) for j in range(w)]
            x, z = x + 0.32 * np.cos(np.radians(20 * f)), z + 0.32 * np.sin(np.radians(20 * f))
    p = spark.createDataFrame([(i, float(x), y, float(z)) for i, x, y, z in rows], P)
    monkeypatch.setattr(queries, "points_e", lambda spark, d: p)
    got = {r.point_id: r.region_id for r in queries.segment_planes(spark, "").collect()}
    assert len({got[i] for i in got} - {-1}) >= 3 and all(got[i] >= 0 for i in range(len(rows) - 36, len(rows)))


def test_normals_of_all_points_against_brute_force(spark, monkeypatch):
    from nubes.plans import queries

    xyz = np.round(np.random.default_rng(5).uniform(0, 1.5, (150, 3)), 4)
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(xyz)], P).withColumn("inst", (F.col("point_id") % 7).cast("int"))
    monkeypatch.setattr(queries, "points_e", lambda spark, d: p)
    got = {r.point_id: (r.nx, r.ny, r.nz) for r in queries.normals_all(spark, "").collect()}
    assert sorted(got) == list(range(150))
    held = 0
    for i, v in enumerate(xyz):
        near = xyz[((xyz - v) ** 2).sum(axis=1) <= 0.25] - v
        if len(near) > 4:
            ev, vec = np.linalg.eigh(near.T @ near)
            if ev[1] > 1.3 * ev[0]:
                held += 1
                assert abs(np.dot(got[i], vec[:, 0])) > 0.97
    assert held > 75


def test_fields(spark):
    p = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 0.1, 0.2, 7)], "point_id long, X double, y double, Z double, nx double, nz double, label int")
    coords, targets = fields.auto_map([c for c in p.columns if c != "point_id"])
    m = fields.map_fields(p, coords, targets)
    assert [round(v, 3) for v in m.first().normals] == [0.1, 0.0, 0.2] and m.first().label == 7
    assert fields.get_fields(m, kind="NORMAL") == ["normals"] and fields.get_fields(m, kind="SEMANTIC") == ["label"]
    assert fields.remove_fields(m, kind="NORMAL").columns == ["point_id", "x", "y", "z", "label"]
    with pytest.raises(ValueError):
        fields.map_fields(p, {0: "X"}, [])
    with pytest.raises(ValueError):
        fields.add_field(m, "label")
    e = fields.edit_fields(m, [fields.Edit("label", "SEMANTIC", 1, "label"), fields.Edit("label_copy", "SEMANTIC", 1, "label"), fields.Edit("v", "SCALAR", 1, "label")])
    assert (e.first().label_copy, e.first().v) == (7, 0.0)
    assert fields.next_field_name(fields.add_field(m, "Field_0000")) == "Field_0001"
    rgb = fields.colorize(fields.add_field(m, "c", "COLOR", 3, 0.5), "c", "COLOR").first().rgb
    assert rgb == [127, 127, 127]
    assert spark.range(1).select(dark_text(F.array(F.lit(255), F.lit(255), F.lit(255))).alias("d")).first().d


def test_ply_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), i / 2, -1.0, i % 256) for i in range(1000)], "point_id long, x float, y float, z float, red short")
    write_ply(df.repartition(3), str(tmp_path / "out"))
    back = read_ply(spark, str(tmp_path / "out"), rowsPerPartition=100)
    assert back.count() == 1000 and sorted(r.x for r in back.collect()) == [float(i) for i in range(1000)]
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n1 2 3 4\n5 6 7 8\n")
    assert [tuple(r) for r in read_ply(spark, str(tmp_path / "a.ply")).orderBy("point_id").collect()] == [(0, 1.0, 2.0, 3.0, 4), (1, 5.0, 6.0, 7.0, 8)]
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 0\nproperty float x\nend_header\n")
    with pytest.raises(Exception, match="lacks"):
        read_ply(spark, str(tmp_path / "b.ply")).count()


def test_ascii_ply_is_read_in_splits(spark, tmp_path):
    rows = [(i, float(i), i / 2, -1.0, i % 256) for i in range(3000)]
    head = "ply\nformat ascii 1.0\ncomment made by hand\nelement vertex 3000\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_text(head + "".join(f"{x} {y}  {z} {r}\n" for _, x, y, z, r in rows) + "3 0 1 2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = read_ply(spark, str(tmp_path / "a.ply"))
        assert df.rdd.getNumPartitions() > 3
        assert sorted(tuple(r) for r in df.collect()) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_by_uri(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(10)], "point_id long, x float, y float, z float")
    write_ply(df, f"file://{tmp_path}/out")
    assert read_ply(spark, f"file://{tmp_path}/out").count() == 10
    np.save(tmp_path / "t.npy", np.arange(4))
    assert read_npy(spark, f"file://{tmp_path}/t.npy").count() == 4
    with pytest.raises(FileNotFoundError):
        read_ply(spark, str(tmp_path / "none" / "*.ply"))


def test_npy(spark, tmp_path):
    np.save(tmp_path / "normals.npy", np.arange(6.0).reshape(2, 3))
    assert [tuple(r) for r in read_npy(spark, str(tmp_path / "normals.npy")).orderBy("point_id").collect()] == [(0, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 5.0)]
    np.save(tmp_path / "t.npy", np.zeros(3, np.int32))
    assert read_npy(spark, str(tmp_path / "t.npy")).columns == ["point_id", "t"]
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="dimensional"):
        read_npy(spark, str(tmp_path / "cube.npy")).count()


def test_documents_and_log(spark, tmp_path):
    p = spark.createDataFrame([("a", "PCD_0001", 0, 1.0, 2), ("b", "PCD_0001", 0, 2.0, 3)], "doc_name string, cloud_id string, point_id long, x double, sem int")
    documents.write_documents(p, str(tmp_path / "d"), {"sem": ("s", '{"2":{"name":"n","color":[1,2,3]}}')})
    assert ids(documents.list_documents(spark, str(tmp_path / "d")), "doc_name") == ["a", "b"]
    assert documents.read_documents(spark, str(tmp_path / "d"), "b").first().x == 2.0
    assert documents.item_id("PointCloudData", 1) == "PCD_0001"
    e = spark.createDataFrame([("lasso", "apply", "u", "2024-05-01T00:00:00")], "tool string, action string, user string, timestamp string")
    toollog.append_tool_log(e, str(tmp_path / "log"), enabled=True)
    assert toollog.read_tool_log(spark, str(tmp_path / "log")).first().tool == "lasso"


def test_documents_are_not_saved_twice(spark, tmp_path):
    p = spark.createDataFrame([("a", "PCD_0001", 0, 1.0)], "doc_name string, cloud_id string, point_id long, x double")
    documents.write_documents(p, str(tmp_path / "d"))
    with pytest.raises(ValueError, match="document a exists"):
        documents.write_documents(p, str(tmp_path / "d"))
    assert documents.read_documents(spark, str(tmp_path / "d")).count() == 1
    assert documents.read_log(spark, str(tmp_path / "d")).count() == 0
    assert documents.list_documents(spark, str(tmp_path / "nothing")).count() == 0
    newer = spark.read.parquet(str(tmp_path / "d/documents")).drop("save").withColumn("format_version", F.lit(9))
    shutil.copytree(tmp_path / "d", tmp_path / "e")
    newer.write.mode("overwrite").parquet(str(next((tmp_path / "e/documents").iterdir())))
    with pytest.raises(Exception, match="format version 9"):
        documents.list_documents(spark, str(tmp_path / "e")).collect()
    with pytest.raises(ValueError, match="exists"):
        documents.add_cloud(p, p, "PCD_0001")


def test_cells_of_any_range(spark):
    utm = [(i, 500_000 + 0.01 * i, 5_500_000.0, 100.0) for i in range(5)] + [(9, 500_000.0, 5_621_000.0, 100.0), (10, -4e9, 4e9, 0.0)]
    p = spark.createDataFrame(utm, P)
    got = {r.point_id: r.component for r in segment.voxel_components(p, 0.05).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9, 10: 10}
    far = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 20_971.52, 0.0, 0.0)], P)
    assert grid.voxel_groups(far, 0.01).count() == 2 and grid.occupied_cells(far, 0.01).first().n_cells == 2
    two = segment.voxel_components(p.withColumn("k", F.col("point_id") % 2), 0.05, ("k",))
    assert {(r.k, r.point_id): r.component for r in two.collect()}[(1, 3)] == 1


def test_positions_of_uneven_ids(spark):
    ids_ = [0, 1, 2, 3, 10**15, 10**15 + 1, *range(10**17, 10**17 + 300)]
    p = spark.createDataFrame([(i,) for i in ids_], "point_id long").repartition(3)
    for n in (1, 2, 16, None):
        assert sorted((r.point_id, r.position) for r in select.with_position(p, n).collect()) == [(v, k) for k, v in enumerate(ids_)]
    assert select.with_position(p.limit(0)).count() == 0


def test_widths_rows_and_masks(spark):
    p = spark.createDataFrame([(0, 1.0, 1.0, 1.0, [1.0, 2.0, 3.0]), (1, 1.0, 1.0, 1.0, [4.0, 5.0, 6.0])], "point_id long, x double, y double, z double, v array<float>")
    same, wider = (fields.edit_fields(p, [fields.Edit("v", "VECTOR", n, "v")]).orderBy("point_id").first().v for n in (3, 4))
    assert same == [1.0, 2.0, 3.0] and wider == [0.0] * 4
    for bad in ([(0, 1.0)], [(0, 1.0), (1, 1.0), (1, 2.0)], [(0, 1.0), (1, 1.0), (2, 1.0)]):
        with pytest.raises(ValueError, match="one row"):
            fields.add_field(p, "w", data=spark.createDataFrame(bad, "point_id long, value double"))
    with pytest.raises(ValueError):
        fields.import_fields(p, p.limit(1), {0: "x", 1: "y", 2: "z"}, [])
    with pytest.raises(KeyError):
        fields.field(p, "nothing")
    mask = spark.createDataFrame([(0, True), (0, False), (7, True)], "point_id long, visible boolean")
    assert {(r.point_id, r.rule) for r in select.invalid_mask(p, mask).collect()} == {(0, "repeated"), (1, "missing"), (7, "unknown")}


def test_clouds_from_arrays(spark):
    r = cloud_from_arrays(spark, np.arange(6.0).reshape(2, 3), np.full((2, 3), 255, np.uint8)).orderBy("point_id").collect()
    assert (r[1].x, r[1].z, r[1].colors) == (3.0, 5.0, [255, 255, 255])
    with pytest.raises(ValueError):
        cloud_from_arrays(spark, np.zeros((2, 3)), np.zeros((3, 3)))


def test_schema_edits(spark):
    c = spark.createDataFrame([(0, "a"), (1, "b")], "id int, name string")
    left = c.where("id = 1").withColumn("original_id", F.col("id"))
    assert {(r.old_id, r.new_id) for r in schema.schema_diff(c, left, {0: 4}).collect()} == {(0, 4), (1, 1)}
    with pytest.raises(Exception, match="no target for removed class 0"):
        schema.schema_diff(c, left).collect()
    assert schema.violations(c, name="s", known=spark.createDataFrame([("t",)], "schema_name string"), derived_from="t").count() == 0
    with pytest.raises(ValueError):
        schema.add_class(c, "a", (1, 1, 1))


def test_a_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from nubes.functions import storage

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.work_dir(away)
    t = storage.materialise(spark.range(3))
    path = t._written_to.removeprefix("file:")
    assert t.count() == 3 and len(list(__import__("pathlib").Path(path).glob("*.parquet")))
    storage.discard(t, None, spark.range(1))
    assert not __import__("pathlib").Path(path).exists()


def test_components_of_a_long_path(spark):
    from nubes.functions.storage import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 5), (7, None)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_segments_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(0, 4, [255.0, 0.0]), (1, 9, [0.5, 1.0])], "point_id long, sem int, c array<double>")
    documents.split_by_label(p, "sem", str(tmp_path / "s"))
    r = documents.join_segments(spark, str(tmp_path / "s"), "c").orderBy("point_id").collect()
    assert [x.labels for x in r] == [0, 1] and r[0].c == [1.0, 0.0] and r[1].c == [0.5, 1.0]
