"""Semantic schemas as class tables (id, name, color array<int>) and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .labels import mex, remap_by, required_ids

JSON_TYPE = "map<string,struct<name:string,color:array<int>>>"


def schema_to_json(classes: Column) -> Column:
    """JSON {"id": {name, color}} of an array of struct<id, name, color>, by id."""
    ordered = F.array_sort(classes)
    return F.to_json(F.map_from_entries(F.transform(ordered, lambda c: F.struct(c["id"].cast("string"), F.struct(c["name"].alias("name"), c["color"].alias("color"))))))


def schema_from_json(text: Column) -> Column:
    entries = F.map_entries(F.from_json(text, JSON_TYPE))
    return F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].cast("int").alias("id"), e["value"]["name"].alias("name"), e["value"]["color"].alias("color"))))


def schema_from_labels(points: DataFrame, cols: list[str]) -> DataFrame:
    """A default class for each id that occurs, and -1 for no label."""
    name = F.when(F.col("id") == -1, "_unlabeled").otherwise(F.concat(F.lit("class_"), F.col("id")))
    return required_ids(points, cols).select("id", name.alias("name"))


def schema_diff(old: DataFrame, edited: DataFrame, targets: dict[int, int] | None = None) -> DataFrame:
    """``old_id, new_id``: edited rows carry ``original_id``; a removed class
    goes to its target if one is given, else to -1 if the edited schema has -1,
    else it is an error."""
    new = edited.select(F.col("original_id").alias("old_id"), F.col("id").alias("new_id"))
    rest = F.when(F.col("unlabeled"), F.lit(-1)).otherwise(F.raise_error(F.concat(F.lit("no target for removed class "), F.col("old_id"))).cast("int"))
    if targets:
        goal = F.create_map(*(F.lit(v) for kv in targets.items() for v in kv))
        rest = F.when(goal[F.col("old_id")].isNotNull(), goal[F.col("old_id")]).otherwise(rest)
    has = edited.agg(F.coalesce(F.bool_or(F.col("id") == -1), F.lit(False)).alias("unlabeled"))
    both = old.select(F.col("id").alias("old_id")).join(new, "old_id", "left").crossJoin(F.broadcast(has))
    return both.select("old_id", F.when(F.col("new_id").isNull(), rest).otherwise(F.col("new_id")).alias("new_id"))


def reindex(classes: DataFrame, by_name: bool = False) -> DataFrame:
    """``old_id, new_id, name``: consecutive ids from 0 in id order, or in
    case-insensitive name order; -1 stays."""
    order = [F.lower("name"), F.col("id")] if by_name else [F.col("id")]
    rank = F.row_number().over(Window.orderBy(*order)) - 1
    pos = classes.where("id >= 0").select(F.col("id").alias("old_id"), rank.cast("int").alias("new_id"), "name")
    return pos.unionByName(classes.where("id < 0").select(F.col("id").alias("old_id"), F.col("id").alias("new_id"), "name"))


def add_class(classes: DataFrame, name: str, color: tuple[int, int, int]) -> DataFrame:
    if classes.where(F.col("name") == name).limit(1).count():
        raise ValueError(f"class {name} exists")
    row = mex(classes, "id").select(F.col("mex").alias("id"), F.lit(name).alias("name"), F.array(*map(F.lit, color)).alias("color"))
    return classes.unionByName(row)


def remove_class(classes: DataFrame, class_id: int) -> DataFrame:
    return classes.where(F.col("id") != class_id)


def violations(classes: DataFrame, required: DataFrame | None = None, name: str | None = None, known: DataFrame | None = None, derived_from: str | None = None) -> DataFrame:
    """``rule, key`` of each broken rule; empty means valid. With ``name``, the
    schema's own: it must not be among the ``known`` ones (schema_name), and a
    schema derived from another needs another name."""
    key = lambda rule, df, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("key"))
    out = key("duplicate_id", classes.groupBy("id").count().where("count > 1"), "id")
    out = out.union(key("bad_name", classes.where((F.length("name") > 256) | F.col("name").rlike(r"[^\x00-\x7F]") | F.col("name").isNull()), "id"))
    ids = classes.where("id >= 0").select("id").distinct()
    prev = F.coalesce(F.lag("id").over(Window.orderBy("id")), F.lit(-1))
    out = out.union(key("gap", ids.withColumn("prev", prev).where("id > prev + 1").withColumn("at", F.col("prev") + 1), "at"))
    if required is not None:
        out = out.union(key("missing", required.join(classes, "id", "left_anti"), "id"))
    if name is not None and known is not None:
        out = out.union(key("used_name", known.where(F.col("schema_name") == name).select("schema_name").distinct(), "schema_name"))
    if name is not None and name == derived_from:
        out = out.union(classes.sparkSession.range(1).select(F.lit("same_name").alias("rule"), F.lit(name).alias("key")))
    return out


def signature(classes: Column) -> Column:
    """Equal for schemas with the same ordered (id, name, color)."""
    return F.sha2(schema_to_json(classes), 256)


def unique_schemas(catalog: DataFrame) -> DataFrame:
    """The first field (by key) of each signature in a catalogue (key, schema_name, classes)."""
    sig = catalog.withColumn("signature", signature(F.col("classes")))
    return sig.groupBy("signature").agg(F.min_by(F.struct("key", "schema_name"), "key").alias("f"), F.count(F.lit(1)).alias("n_fields")).select(F.col("f.key").alias("key"), F.col("f.schema_name").alias("schema_name"), "n_fields")


def matching_fields(catalog: DataFrame, name: str, classes: Column) -> DataFrame:
    """Catalogue rows whose schema has the given name and classes."""
    return catalog.where((F.col("schema_name") == name) & (signature(F.col("classes")) == signature(classes)))


def impact(catalog: DataFrame, name: str, classes: Column) -> DataFrame:
    """One row: ``n_fields`` that an edit of the schema would touch, and their
    ``keys`` in order. A catalogue has a row a field, not a point."""
    hit = matching_fields(catalog, name, classes)
    return hit.agg(F.count(F.lit(1)).alias("n_fields"), F.array_sort(F.collect_list("key")).alias("keys"))


def merge_schemas(saved: DataFrame, session: DataFrame) -> DataFrame:
    """Union of two catalogues by ``key``; of one key the session's row stays."""
    return saved.join(session.select("key"), "key", "left_anti").unionByName(session)


def split_key(key: Column) -> Column:
    """struct<doc_name, cloud_id, field_name, schema_name> of a key; a schema's
    name may hold slashes."""
    part = F.split(key, "/", 4)
    return F.struct(*(F.get(part, F.lit(i)).alias(n) for i, n in enumerate(("doc_name", "cloud_id", "field_name", "schema_name"))))


def build_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def update_schema(points: DataFrame, catalog: DataFrame, name: str, old: Column, pairs: DataFrame, field: str) -> DataFrame:
    """Points of the documents whose field uses the old schema, remapped by a
    table (old, new, seq); documents that don't use it are not read."""
    docs = matching_fields(catalog, name, old).select("doc_name").distinct()
    return remap_by(points.join(docs, "doc_name", "left_semi"), field, pairs)
