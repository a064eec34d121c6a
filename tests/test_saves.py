"""Document sets: saves that are whole or not at all, edits in place, files
that queries pass over; arrays and PLY files without silent change."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nubes.model import typed
from nubes.operators import neighbors, select
from nubes.sources import documents, manifest
from nubes.sources.npy import read_npy
from nubes.sources.ply import read_ply, write_ply

DOC = "doc_name string, cloud_id string, point_id long, x double, sem int"
SCHEMA = '{"0":{"name":"wall","color":[1,2,3]}}'


def cloud(spark, *names):
    df = spark.createDataFrame([(n, "PCD_0001", i, float(i), i % 3) for n in names for i in range(6)], DOC)
    return df.withColumn("sem", typed(F.col("sem"), "sem", "SEMANTIC"))


def state(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in pathlib.Path(root).rglob("*.parquet")}


@pytest.mark.parametrize("step", ["points", "field_catalog", "tool_log", "documents", "manifest"])
def test_a_failed_save_leaves_nothing_visible(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "set")
    documents.write_documents(cloud(spark, "a"), root)
    log = spark.createDataFrame([("b", "{}")], "doc_name string, entry string")
    if step == "manifest":
        monkeypatch.setattr(documents, "commit", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
    else:
        from pyspark.sql import DataFrameWriter

        def parquet(self, path, *a, f=DataFrameWriter.parquet, **b):
            if f"/{step}/" in path:
                raise OSError("disk full")
            return f(self, path, *a, **b)

        monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    with pytest.raises(OSError, match="disk full"):
        documents.write_documents(cloud(spark, "b"), root, log=log)
    monkeypatch.undo()
    assert {r.doc_name for r in documents.list_documents(spark, root).collect()} == {"a"}
    assert documents.read_documents(spark, root).count() == 6 and documents.read_log(spark, root).count() == 0
    assert {r.doc_name for r in documents.read_catalog(spark, root).collect()} == {"a"}
    documents.write_documents(cloud(spark, "b"), root, log=log)
    assert documents.read_documents(spark, root).count() == 12 and documents.read_log(spark, root).count() == 1


def test_an_edit_writes_only_its_documents(spark, tmp_path):
    root = str(tmp_path / "set")
    documents.write_documents(cloud(spark, "a", "b"), root, {"sem": ("s", SCHEMA)})
    documents.write_documents(cloud(spark, "c"), root, {"sem": ("t", SCHEMA)})
    before = state(root)
    old = F.array(F.struct(F.lit(0).alias("id"), F.lit("wall").alias("name"), F.array(*map(F.lit, (1, 2, 3))).alias("color")))
    pairs = spark.createDataFrame([(0, 7, 1)], "old int, new int, seq int")
    new = SCHEMA.replace('"0"', '"7"')
    assert documents.update_documents(spark, root, "sem", "s", old, new, pairs) == 3
    after = state(root)
    assert before.items() <= after.items()
    added = [p for p in after if p not in before and p.startswith("points")]
    assert added and all("doc_name=a" in p or "doc_name=b" in p for p in added)
    now = {(r.doc_name, r.sem) for r in documents.read_documents(spark, root).collect()}
    assert now == {(n, k) for n in "ab" for k in (7, 1, 2)} | {("c", k) for k in range(3)}
    assert documents.read_documents(spark, root).count() == 18
    assert {r.sem for r in documents.read_documents(spark, root, "a", version=2).collect()} == {0, 1, 2}
    keys = {r.key: r.schema_json for r in documents.scan_schemas(spark, root).collect()}
    assert keys == {"a/PCD_0001/sem/s": new, "b/PCD_0001/sem/s": new, "c/PCD_0001/sem/t": SCHEMA}
    assert documents.update_documents(spark, root, "sem", "none", old, new, pairs) == 3 and state(root) == after
    with pytest.raises(ValueError, match="no version 9"):
        documents.read_documents(spark, root, version=9)


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "set")
    documents.write_documents(cloud(spark, "a"), root)
    with pytest.raises(RuntimeError, match="another writer"):
        manifest.commit(spark, root, 0, [])
    assert documents.read_documents(spark, root).count() == 6


def test_fields_of_saves_and_names_like_numbers(spark, tmp_path):
    root = str(tmp_path / "set")
    documents.write_documents(cloud(spark, "007"), root)
    documents.write_documents(cloud(spark, "8").withColumn("extra", F.lit(1.5)).drop("sem"), root)
    got = documents.read_documents(spark, root)
    assert {(r.doc_name, r.cloud_id, r.extra) for r in got.collect()} == {("007", "PCD_0001", None), ("8", "PCD_0001", 1.5)}
    documents.write_documents(cloud(spark, "9").withColumn("sem", F.lit("text")), root)
    with pytest.raises(ValueError, match="field sem is int in one save and string"):
        documents.read_documents(spark, root)


def test_many_sets_are_listed_in_one_plan(spark, tmp_path):
    for i in range(6):
        documents.write_documents(cloud(spark, f"d{i}", "same"), f"{tmp_path}/r{i % 2}/s{i}")
    documents.write_documents(cloud(spark, "same"), f"{tmp_path}/r1")
    df = documents.list_documents(spark, f"{tmp_path}/r0", f"file://{tmp_path}/r1")
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan parquet") + df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 2
    got = {r.doc_name: r.root for r in df.collect()}
    assert set(got) == {f"d{i}" for i in range(6)} | {"same"} and got["same"].endswith("/r1") and got["d3"].endswith("/r1/s3")


def test_unique_names_share_out_free_numbers(spark):
    files = [f"p/scan.ply/{i}/scan.ply" for i in range(7)] + ["q/new.npy", "q/odd_001.ply"]
    known = ["scan", "scan_000", "scan_002", "scan_005", "scan_1000", "odd_001"]
    from nubes.sources.documents import unique_names

    got = {r.path: r.doc_name for r in unique_names(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([(k,) for k in known], "doc_name string")).collect()}
    assert [got[f] for f in files] == ["scan_001", "scan_003", "scan_004", "scan_006", "scan_007", "scan_008", "scan_009", "new", "odd_001_000"]


def test_a_saved_curve_lets_queries_pass_over_rows(spark, tmp_path):
    xyz = np.random.default_rng(0).uniform(0, 100, (4000, 3))
    p = spark.createDataFrame([("a", "PCD_0001", i, *map(float, v)) for i, v in enumerate(xyz)], "doc_name string, cloud_id string, point_id long, x double, y double, z double")

    def scanned(root, **options):
        documents.write_documents(p, root, **options)
        q = neighbors.radius_query(documents.read_documents(spark, root), (20.0, 30.0, 70.0), 8.0)
        got = {r.point_id for r in q.collect()}
        assert got == {int(i) for i in np.flatnonzero(((xyz - (20, 30, 70)) ** 2).sum(axis=1) <= 64)}
        box = select.bbox_filter(spark.read.parquet(f"{root}/points"), (12, 22, 62), (28, 38, 78))
        box.collect()
        plan = box._jdf.queryExecution().executedPlan()
        while plan.children().size():
            plan = plan.children().apply(0)
        return plan.metrics().apply("numOutputRows").value()

    whole, pruned = scanned(str(tmp_path / "plain")), scanned(str(tmp_path / "curve"), cluster=64)
    assert whole == 4000 and pruned < 800


def test_selection_log_and_undo(spark):
    ops = [(1, "union", {1, 2, 3}), (2, "EXCLUSION", {3, 4}), (3, "INTERSECTION", {2, 4, 9}), (4, "UNION", {5}), (5, "OVERWRITE", {7, 8}), (6, "DIFFERENCE", {8}), (7, "EXCLUSION", {7, 2})]
    table = spark.createDataFrame([(s, h) for s, h, _ in ops], "seq long, how string")
    log = spark.createDataFrame([(s, p) for s, _, x in ops for p in [*x, min(x)]], "seq long, point_id long")
    now: set[int] = set()
    for seq, how, x in ops:
        now = {"UNION": now | x, "EXCLUSION": now ^ x, "INTERSECTION": now & x, "OVERWRITE": x, "DIFFERENCE": now - x}[how.upper()]
        assert {r.point_id for r in select.replay_selections(log, table, seq).collect()} == now
    assert select.replay_selections(log, table).count() == len(now) == 1
    assert select.replay_selections(log, table, 0).count() == 0
    with pytest.raises(Exception, match="unknown operation SWAP"):
        select.replay_selections(log, spark.createDataFrame([(1, "SWAP")], "seq long, how string")).collect()


@pytest.mark.parametrize("code", ["?", "i1", "u1", "<i2", ">u2", "<i4", "<u4", "<i8", "u8", "<f2", ">f4", "f8"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_arrays_of_any_type_and_order(spark, tmp_path, monkeypatch, code, order):
    from nubes.sources import npy

    monkeypatch.setattr(npy, "BYTES", 40)
    kind = np.dtype(code)
    top = 1 if kind.kind in "bf" else np.iinfo(kind).max
    a = np.array([[0, 1, top], [1, 0, top // 2], [top, top, 1], [0, 0, 0], [1, top, 0]]).astype(kind) if kind.kind != "f" else np.array([[0.5, -1, 2.25]] * 5, kind)
    np.save(tmp_path / "v.npy", np.asarray(a, order=order))
    rows = read_npy(spark, str(tmp_path / "v.npy")).orderBy("point_id").collect()
    assert [r.point_id for r in rows] == list(range(5))
    assert [[r.v_0, r.v_1, r.v_2] for r in rows] == [[v.item() for v in row] for row in a]


def test_arrays_that_no_column_holds(spark, tmp_path):
    np.save(tmp_path / "c.npy", np.zeros(3, complex))
    with pytest.raises(Exception, match="which no column holds"):
        read_npy(spark, str(tmp_path / "c.npy")).count()


def test_ply_is_written_without_silent_change(spark, tmp_path):
    p = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 255, -300, 1 << 31, 0.1)], "point_id long, x float, y float, z double, red short, k short, n long, w double")
    write_ply(p, str(tmp_path / "a"))
    r = read_ply(spark, str(tmp_path / "a")).first()
    assert (r.red, r.k, r.n, r.w, r.z) == (255, -300, 1 << 31, 0.1, 3.0)
    for bad, why in (("CAST(300 AS short) AS red", "beyond uchar"), ("CAST(-1 AS bigint) AS n", "beyond uint"), ("CAST(NULL AS double) AS w", "has nulls")):
        with pytest.raises(Exception, match=why):
            write_ply(p.selectExpr("point_id", "x", "y", "z", bad), str(tmp_path / "b"))
    with pytest.raises(Exception, match="no PLY type"):
        write_ply(p.withColumn("t", F.lit("x")), str(tmp_path / "b"))


def test_ply_elements_before_the_vertices(spark, tmp_path):
    head = "ply\nformat {}\nelement camera 2\nproperty float f\nproperty uchar g\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii 1.0") + "9 1\n8 2\n1 2 3\n4 5 6\n")
    body = np.array([(9, 1), (8, 2)], "<f4,u1").tobytes() + np.arange(1, 7, dtype="<f4").tobytes()
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + body)
    for name in "ab":
        assert sorted(tuple(r) for r in read_ply(spark, f"{tmp_path}/{name}.ply").collect()) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
