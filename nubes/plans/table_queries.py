"""Registered queries of fields, clouds, documents, files and schemas."""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import work_dir
from ..model import typed
from ..operators import fields, grid, labels, neighbors, schema, segment, select
from ..sources import documents, files, toollog
from ..sources.npy import read_npy
from ..sources.ply import read_ply, write_ply
from ..streaming.toollog import stream_tool_log
from .queries import _BOX, _CATALOG, _CLASSES, _COMBOS, _catalog, _classes, _plane_sql, query
from .views import E_SQL, L_SQL, V_SQL, points_e, points_l, points_v

# ------------------------------------------------------------------------ fields


def _typed_points(spark, d):
    p = points_e(spark, d)
    return p.select("point_id", *"xyz", *(typed(F.col(c), c, k) for c, k in (("sem", "SEMANTIC"), ("inst", "INSTANCE"), ("intensity", "INTENSITY"))))


@query(f"WITH {E_SQL} SELECT point_id, CAST(CASE WHEN inst = 0 THEN 0 ELSE sem * 2 + inst END AS FLOAT) AS extra, -1 AS class, CAST(0.5 AS FLOAT) AS weight FROM points_e")
def add_field(spark, d):
    p = points_e(spark, d)
    data = p.select("point_id", F.when(F.col("inst") != 0, F.col("sem") * 2 + F.col("inst")).alias("value"))
    out = fields.add_field(p.select("point_id", *"xyz"), "extra", data=data)
    return fields.add_field(fields.add_field(out, "class", "SEMANTIC"), "weight", fill=0.5).select("point_id", "extra", "class", "weight")


@query(f"WITH {E_SQL} SELECT point_id, x, y, z, sem, intensity FROM points_e")
def remove_fields(spark, d):
    return fields.remove_fields(_typed_points(spark, d), kind="INSTANCE")


@query(f"WITH {E_SQL} SELECT point_id, intensity FROM points_e")
def first_intensity(spark, d):
    p = _typed_points(spark, d)
    return fields.field(p, fields.get_fields(p, kind="INTENSITY", index=0)[0])


@query(f'WITH {E_SQL} SELECT point_id, sem AS "Field_0000", inst AS "Field_0001", sem AS "Field_0003", intensity AS "Field_0002" FROM points_e')
def next_field_name(spark, d):
    p = points_e(spark, d).select("point_id", F.col("sem").alias("Field_0000"), "inst", F.col("sem").alias("Field_0003"), "intensity")
    p = p.withColumnRenamed("inst", fields.next_field_name(p))
    return p.withColumnRenamed("intensity", fields.next_field_name(p))


@query(
    f"WITH {E_SQL} SELECT point_id, x, y, z, CAST(x AS FLOAT) AS d0, CAST(y AS FLOAT) AS d1, CAST(z AS FLOAT) AS d2, CAST(0 AS FLOAT) AS w0, CAST(0 AS FLOAT) AS w3, 4 AS n_w, sem AS label, sem AS label_copy, CAST(0 AS FLOAT) AS reset FROM points_e"
)
def edit_fields(spark, d):
    """Renamed, resized (and so reset), duplicated, retyped (and so reset)."""
    p = _typed_points(spark, d).withColumn("v", typed(F.array(*"xyz").cast("array<float>"), "v", "VECTOR"))
    e = fields.Edit
    out = fields.edit_fields(p, [e("dir", "VECTOR", 3, "v"), e("wide", "VECTOR", 4, "v"), e("label", "SEMANTIC", 1, "sem"), e("label_copy", "SEMANTIC", 1, "sem"), e("reset", "SCALAR", 1, "sem")])
    at = lambda c, i: F.get(c, F.lit(i)).cast("float")
    return out.select("point_id", *"xyz", *(at("dir", i).alias(f"d{i}") for i in range(3)), at("wide", 0).alias("w0"), at("wide", 3).alias("w3"), F.size("wide").alias("n_w"), "label", "label_copy", "reset")


@query(f"WITH {E_SQL} SELECT point_id, x, sem AS label, CAST(intensity AS FLOAT) AS intensity FROM points_e")
def import_fields(spark, d):
    p = points_e(spark, d)
    new = p.select("point_id", F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"), F.col("sem").alias("label"), F.col("intensity").alias("Luminance"))
    coords, targets = fields.auto_map([c for c in new.columns if c != "point_id"])
    return fields.import_fields(p.select("point_id", *"xyz"), new, coords, targets).select("point_id", "x", "label", "intensity")


@query(
    f"WITH {V_SQL}, o AS (SELECT * FROM points_v WHERE point_id = 10) SELECT 'coords' AS field, 'X' AS component, printf('%.4f', x) AS value FROM o UNION ALL SELECT 'coords', 'Y', printf('%.4f', y) FROM o UNION ALL SELECT 'coords', 'Z', printf('%.4f', z) FROM o "
    "UNION ALL SELECT 'sem', '', CAST(sem AS VARCHAR) FROM o UNION ALL SELECT 'vec', CAST(i - 1 AS VARCHAR), printf('%.4f', CAST(vec[i] AS DOUBLE)) FROM (SELECT vec, unnest(range(1, len(vec) + 1)) AS i FROM o)"
)
def inspect_vector(spark, d):
    """One point with all components of its vector."""
    return fields.inspect_point(points_v(spark, d), 10, expand=True)


_FOLD = {2: "inst = 1 OR sem = 2", 3: "(inst = 1 OR sem = 2) AND x < 15", 4: "((inst = 1 OR sem = 2) AND x < 15) <> (sem = 0)", 5: "(((inst = 1 OR sem = 2) AND x < 15) <> (sem = 0)) AND inst <> 3"}


@query(f"WITH {E_SQL} " + " UNION ALL ".join(f"SELECT {k} AS as_of, point_id FROM points_e WHERE {w}" for k, w in _FOLD.items()))
def selection_replay(spark, d):
    """Five set operations as a log, after two to five of them."""
    p = points_e(spark, d)
    sets = (("OVERWRITE", "inst = 1"), ("UNION", "sem = 2"), ("INTERSECTION", "x < 15"), ("EXCLUSION", "sem = 0"), ("DIFFERENCE", "inst = 3"))
    ops = spark.createDataFrame([(i + 1, how) for i, (how, _) in enumerate(sets)], "seq long, how string")
    log = p.select(F.explode(F.array(*(F.when(F.expr(w), F.lit(i + 1)) for i, (_, w) in enumerate(sets)))).alias("seq"), "point_id").where("seq IS NOT NULL")
    parts = [select.replay_selections(log, ops, k).select(F.lit(k).alias("as_of"), "point_id") for k in _FOLD]
    return functools.reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- clouds, documents


def _clouds(spark, d):
    p = points_e(spark, d).withColumn("cloud_id", F.lit(documents.item_id("PointCloudData", 1)))
    return documents.add_cloud(p, p.where("inst = 1").select("point_id", *"xyz"), documents.item_id("PointCloudData", 2))


@query(f"WITH {E_SQL} SELECT 'PCD_0001' AS cloud_id, count(*) AS n, count(sem) AS n_sem FROM points_e UNION ALL SELECT 'PCD_0002', count(*), 0 FROM points_e WHERE inst = 1")
def add_cloud(spark, d):
    return _clouds(spark, d).groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), F.count("sem").alias("n_sem"))


@query(f"WITH {E_SQL} SELECT point_id, 'PCD_0002' AS cloud_id FROM points_e WHERE inst = 1")
def remove_cloud(spark, d):
    return documents.remove_cloud(_clouds(spark, d), "PCD_0001").select("point_id", "cloud_id")


@query(f"WITH {E_SQL} SELECT DISTINCT inst, concat('IS_', printf('%04d', inst)) AS item_id FROM points_e")
def item_ids(spark, d):
    return points_e(spark, d).select("inst", documents.item_id_of(F.lit("InstanceSegmentation"), F.col("inst")).alias("item_id")).distinct()


@query(f"WITH {E_SQL} SELECT DISTINCT concat('scan_', inst) AS doc_name FROM points_e WHERE inst % 2 = 0")
def new_documents(spark, d):
    """Names found that the set does not have."""
    p = points_e(spark, d).select(F.concat(F.lit("scan_"), F.col("inst")).alias("doc_name"), "inst").distinct()
    return documents.new_documents(p, p.where("inst % 2 = 1")).select("doc_name")


@query(f"WITH {E_SQL} SELECT concat('scan_', inst % 5) AS doc_name, count(*) AS n FROM (SELECT DISTINCT inst FROM points_e) GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, d):
    p = points_e(spark, d).select("inst").distinct()
    return documents.duplicate_names(p.select(F.concat(F.lit("scan_"), F.col("inst") % 5).alias("doc_name")))


def _named(spark, d):
    return _typed_points(spark, d).withColumns({"doc_name": F.concat(F.lit("scan_"), F.col("inst")), "cloud_id": F.lit("PCD_0001")})


_OLD = '{"0":{"name":"wall","color":[1,2,3]},"1":{"name":"floor","color":[4,5,6]}}'
_NEW = '{"1":{"name":"floor","color":[4,5,6]},"5":{"name":"front","color":[1,2,3]}}'


def _two_schemas(spark, d):
    """A set whose odd documents use the schema odd, the others even."""
    root, p = work_dir(spark), _named(spark, d)
    for name, own in (("odd", p.where("inst % 2 = 1")), ("even", p.where("inst % 2 = 0"))):
        documents.write_documents(own, root, {"sem": (name, _OLD)})
    return root


@query(f"WITH {E_SQL} SELECT DISTINCT concat('scan_', inst, '/PCD_0001/sem/', CASE WHEN inst % 2 = 1 THEN 'odd' ELSE 'even' END) AS key, CASE WHEN inst % 2 = 1 THEN 'odd' ELSE 'even' END AS schema_name, 2 AS n_classes FROM points_e")
def scan_schemas(spark, d):
    s = documents.scan_schemas(spark, _two_schemas(spark, d))
    return s.select("key", "schema_name", F.size(schema.schema_from_json(F.col("schema_json"))).alias("n_classes"))


@query(f"WITH {E_SQL} SELECT point_id, CASE WHEN inst % 2 = 1 AND sem = 0 THEN 5 ELSE sem END AS sem, CASE WHEN inst % 2 = 1 THEN 5 ELSE 1 END AS last_id FROM points_e")
def update_documents(spark, d):
    """A schema edited in a whole set: labels remapped and classes replaced in
    the documents that use it, the others unchanged."""
    root = _two_schemas(spark, d)
    old = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.array(*map(F.lit, c)).alias("color")) for i, n, c in ((0, "wall", (1, 2, 3)), (1, "floor", (4, 5, 6)))))
    documents.update_documents(spark, root, "sem", "odd", old, _NEW, spark.createDataFrame([(0, 5, 1)], "old int, new int, seq int"))
    last = documents.scan_schemas(spark, root).select("doc_name", F.array_max(F.transform(schema.schema_from_json(F.col("schema_json")), lambda c: c["id"])).alias("last_id"))
    return documents.read_documents(spark, root).join(F.broadcast(last), "doc_name").select("point_id", "sem", "last_id")


@query(f"WITH {E_SQL} SELECT 1 AS version, point_id, sem FROM points_e WHERE inst = 1 UNION ALL SELECT 3, point_id, CASE WHEN sem = 0 THEN 5 ELSE sem END FROM points_e WHERE inst = 1")
def document_versions(spark, d):
    """A document before and after an edit of its schema."""
    root = _two_schemas(spark, d)
    old = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.array(*map(F.lit, c)).alias("color")) for i, n, c in ((0, "wall", (1, 2, 3)), (1, "floor", (4, 5, 6)))))
    last = documents.update_documents(spark, root, "sem", "odd", old, _NEW, spark.createDataFrame([(0, 5, 1)], "old int, new int, seq int"))
    one = [documents.read_documents(spark, root, "scan_1", version=v).select(F.lit(v).alias("version"), "point_id", "sem") for v in (1, last)]
    return one[0].unionByName(one[1])


@query(f"WITH {E_SQL} SELECT point_id, (x - 15) * (x - 15) + (y - 2) * (y - 2) + (z - 5) * (z - 5) AS d2 FROM points_e WHERE (x - 15) * (x - 15) + (y - 2) * (y - 2) + (z - 5) * (z - 5) <= 9.0")
def radius_query_saved(spark, d):
    """A radius query over a set saved along a space-filling curve."""
    root = work_dir(spark)
    documents.write_documents(_named(spark, d), root, cluster=16)
    return neighbors.radius_query(documents.read_documents(spark, root), (15.0, 2.0, 5.0), 3.0)


@query(f"WITH {E_SQL} SELECT DISTINCT concat('scan_', inst) AS doc_name, CASE WHEN inst < 3 THEN 'top' WHEN inst < 5 THEN 'a' ELSE 'b' END AS place FROM points_e")
def list_documents(spark, d):
    """Sets at a root and below it, with names that several have: the root's
    wins, then the first folder's."""
    root, p = work_dir(spark), _named(spark, d)
    for at, own in ((root, "inst < 3"), (f"{root}/a", "inst < 5"), (f"{root}/b", "inst > 1")):
        documents.write_documents(p.where(own), at)
    name = F.regexp_extract("root", "/([ab])$", 1)
    return documents.list_documents(spark, root).select("doc_name", F.when(name == "", "top").otherwise(name).alias("place"))


@query(f"WITH {E_SQL} SELECT concat('scan_', inst) AS doc_name, concat('t', sem) AS tool, count(*) AS n FROM points_e GROUP BY inst, sem")
def document_log(spark, d):
    """Documents saved with their tool log, which is read back and parsed."""
    root, p = work_dir(spark), _named(spark, d)
    entry = F.to_json(F.struct(F.concat(F.lit("t"), F.col("sem")).alias("tool"), F.col("point_id").cast("string").alias("action")))
    documents.write_documents(p, root, log=p.select("doc_name", entry.alias("entry")))
    log = documents.read_log(spark, root)
    return log.select("doc_name", F.from_json("entry", toollog.ENTRY)["tool"].alias("tool")).groupBy("doc_name", "tool").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {L_SQL}, {_BOX} SELECT CAST(floor((x - lx) / ((hx - lx) / 4)) * 3 * 2 + floor((y - ly) / ((hy - ly) / 3)) * 2 + floor((z - lz) / ((hz - lz) / 2)) AS BIGINT) AS chunk_id,
  CASE WHEN point_id % 7 = 0 THEN -1 ELSE point_id % 7 END AS region_id, count(*) AS n, min(x) AS min_x FROM points_l, b GROUP BY 1, 2"""
)
def export_regions(spark, d):
    path = work_dir(spark)
    p = grid.chunk_by_number(points_l(spark, d), 4, 3, 2).withColumn("region_id", F.when(F.col("point_id") % 7 != 0, F.col("point_id") % 7))
    documents.export_regions(p, path, ("x", "y", "z"))
    back = spark.read.parquet(path)
    return back.groupBy(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("region_id").cast("long").alias("region_id")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"))


@query(f"WITH {E_SQL} SELECT point_id, CAST(dense_rank() OVER (ORDER BY sem) - 1 AS INT) AS labels, CASE WHEN sem = 3 THEN intensity / 255 ELSE 0.25 END AS shade FROM points_e")
def split_and_join(spark, d):
    """One folder for each label, read back with the folder's ordinal; colours
    of segments that go beyond 1 are scaled."""
    path = work_dir(spark)
    p = points_e(spark, d).withColumn("c", F.array(F.when(F.col("sem") == 3, F.col("intensity")).otherwise(0.25), F.when(F.col("sem") == 3, 200.0).otherwise(0.5)))
    documents.split_by_label(p, "sem", path)
    return documents.join_segments(spark, path, "c").select("point_id", "labels", F.get("c", F.lit(0)).alias("shade"))


@query(f"WITH {E_SQL}, {_COMBOS} SELECT point_id, combo_id AS labels FROM points_e p JOIN co ON p.sem = co.sem AND p.inst = co.inst")
def flatten_and_join(spark, d):
    """All label columns as one, exported a folder each and joined again."""
    path = work_dir(spark)
    documents.split_by_label(labels.flatten_labels(points_e(spark, d), ["sem", "inst"]), "label", path)
    return documents.join_segments(spark, path).select("point_id", "labels")


# ------------------------------------------------------------------------- files


@query(f"WITH {E_SQL} SELECT CAST(point_id AS INT) AS id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(inst AS SMALLINT) AS red, intensity FROM points_e")
def ply_round_trip(spark, d):
    """Written as binary PLY, a file a partition, and read in row ranges."""
    path = work_dir(spark)
    p = points_e(spark, d).select("point_id", *(F.col(c).cast("float") for c in "xyz"), F.col("inst").cast("short").alias("red"), "intensity", F.col("point_id").cast("int").alias("id"))
    write_ply(p, path)
    return read_ply(spark, path, rowsPerPartition=50_000).select("id", "x", "y", "z", "red", "intensity")


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[2] AS DOUBLE) AS e1, CAST(embedding[3] AS DOUBLE) AS e2 FROM embeddings")
def npy_round_trip(spark, d):
    """Vectors written as NPY arrays, a file a task, and read as one table."""
    path = work_dir(spark) + "/v"
    e = points_v(spark, d).select("point_id", *(F.element_at("vec", i + 1).cast("double").alias(f"e{i}") for i in range(3)))

    def save(batches):
        for b in batches:
            to = f"{path}/{uuid.uuid4().hex}.npy"
            a = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(4)], axis=1)
            with files.create_file(to) as f:
                np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(a))
                f.write(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([to])], names=["file"])

    e.mapInArrow(save, "file string").write.format("noop").mode("overwrite").save()
    return read_npy(spark, path).select(F.col("v_0").cast("long").alias("vec_id"), F.col("v_1").alias("e0"), F.col("v_2").alias("e1"), F.col("v_3").alias("e2"))


@query("SELECT event_type AS tool, CAST(event_id AS VARCHAR) AS action, CAST(user_id AS VARCHAR) AS user FROM events")
def tool_log_stream(spark, d):
    """The log appended, then read as a stream to its end."""
    path = work_dir(spark)
    ev = spark.read.parquet(f"{d}/events.parquet")
    toollog.append_tool_log(ev.select(F.col("event_type").alias("tool"), F.col("event_id").cast("string").alias("action"), F.col("user_id").cast("string").alias("user"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")), f"{path}/log", enabled=True)
    out = stream_tool_log(spark, f"{path}/log").writeStream.format("parquet").option("path", f"{path}/parsed").option("checkpointLocation", f"{path}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/parsed").select("tool", "action", "user")


# ----------------------------------------------------------------------- schemas


@query(f"WITH {E_SQL}, {_CLASSES} SELECT id, name, CAST(cr AS INT) AS r, CAST(cg AS INT) AS g, cb AS b FROM cl")
def schema_json(spark, d):
    """A schema as JSON, parsed again to a row a class."""
    one = _classes(spark, d).agg(F.collect_list(F.struct("id", "name", "color")).alias("classes"))
    back = one.select(F.inline(schema.schema_from_json(schema.schema_to_json(F.col("classes")))))
    return back.select("id", "name", *(F.get("color", F.lit(i)).alias(c) for i, c in enumerate("rgb")))


@query(f"WITH {E_SQL}, {_CATALOG} SELECT count(*) AS n_fields, coalesce(string_agg(key, ',' ORDER BY key), '') AS keys FROM ct WHERE schema_name = 's1' AND sig = (SELECT sig FROM ct WHERE doc_name = 'doc1')")
def schema_impact(spark, d):
    c = _catalog(spark, d)
    one = c.where("doc_name = 'doc1'").select(F.col("classes").alias("wanted"))
    return schema.impact(c.crossJoin(F.broadcast(one)), "s1", F.col("wanted")).select("n_fields", F.array_join("keys", ",").alias("keys"))


@query(f"WITH {E_SQL}, {_CATALOG} SELECT key, CASE WHEN doc_name IN ('doc1', 'doc2') THEN 'edited' ELSE schema_name END AS schema_name FROM ct UNION ALL SELECT concat(key, '_2'), 'edited' FROM ct WHERE doc_name = 'doc2'")
def merge_schemas(spark, d):
    """Saved schemas with the session's, which win."""
    c = _catalog(spark, d)
    session = c.where("doc_name IN ('doc1', 'doc2')").withColumn("schema_name", F.lit("edited"))
    more = c.where("doc_name = 'doc2'").withColumns({"schema_name": F.lit("edited"), "key": F.concat("key", F.lit("_2"))})
    return schema.merge_schemas(c, session.unionByName(more)).select("key", "schema_name")


@query(f"WITH {E_SQL}, {_CATALOG} SELECT doc_name, 'PCD_0001' AS cloud_id, 'sem' AS field_name, concat(schema_name, '/x') AS schema_name FROM ct")
def split_keys(spark, d):
    c = _catalog(spark, d)
    return c.select(schema.split_key(F.concat("key", F.lit("/x"))).alias("k")).select("k.*")


@query(f"WITH {E_SQL}, {_CLASSES} SELECT id AS old_id, CAST(CASE WHEN id < 0 THEN id ELSE row_number() OVER (PARTITION BY id < 0 ORDER BY CASE WHEN id = 0 THEN 'zero' ELSE lower(name) END, id) - 1 END AS INT) AS new_id FROM cl")
def reindex_by_name(spark, d):
    c = _classes(spark, d).withColumn("name", F.when(F.col("id") == 0, "ZERO").otherwise(F.initcap("name")))
    return schema.reindex(c, by_name=True).select("old_id", "new_id")


@query(f"WITH {E_SQL}, {_CLASSES} SELECT id AS old_id, CASE id WHEN 0 THEN 7 WHEN 1 THEN -1 ELSE id END AS new_id FROM cl")
def schema_diff_targets(spark, d):
    """Removed classes: one with a target, one without."""
    c = _classes(spark, d)
    return schema.schema_diff(c, c.where("id NOT IN (0, 1)").select(F.col("id").alias("original_id"), "id"), {0: 7})


@query(f"WITH {E_SQL}, {_CLASSES} SELECT id AS old_id, CASE WHEN id = 0 THEN 13 ELSE id + 10 END AS new_id FROM cl WHERE id >= 0")
def schema_diff_without_unlabelled(spark, d):
    """No class -1 on either side: the removed class needs its target."""
    c = _classes(spark, d).where("id >= 0")
    return schema.schema_diff(c, c.where("id <> 0").select(F.col("id").alias("original_id"), (F.col("id") + 10).alias("id")), {0: 13})


@query(f"WITH {E_SQL}, {_CLASSES} SELECT id FROM cl WHERE id <> 0 UNION ALL SELECT 0")
def edit_classes(spark, d):
    """A class removed, and one added under the least free id."""
    c = _classes(spark, d).where("id <> 1").select("id", "name", "color")
    one = _classes(spark, d).where("id = 1").select("id", "name", "color")
    return schema.add_class(schema.remove_class(c.unionByName(one), 0), "window", (9, 9, 9)).select("id")


@query(f"WITH {E_SQL}, {_CATALOG} SELECT 'used_name' AS rule, 's1' AS key WHERE EXISTS (SELECT 1 FROM ct WHERE schema_name = 's1') UNION ALL SELECT 'same_name', 's1'")
def schema_name_violations(spark, d):
    c = _classes(spark, d).where("id < 0")
    return schema.violations(c, name="s1", known=_catalog(spark, d), derived_from="s1")


@query(f"WITH {E_SQL}, i AS (SELECT *, inst AS region_id FROM points_e), {_plane_sql()} SELECT i.region_id, count(*) AS n, count(CASE WHEN abs((x - px) * ux + (y - py) * uy + (z - pz) * uz) > 1.5 THEN 1 END) AS n_far FROM i LEFT JOIN pl ON i.region_id = pl.region_id GROUP BY i.region_id")
def plane_fits(spark, d):
    """Members of each region, and how many lie off its plane."""
    p = points_e(spark, d)
    return segment.plane_fits(p, p.select("point_id", F.col("inst").alias("region_id")), 0.5, 3.0)
