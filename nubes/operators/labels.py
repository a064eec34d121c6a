"""Labels: lookup, remap, free ids, annotation and the edit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import GREY_204
from ..functions.storage import materialise

ID = "point_id"


def class_lookup(points: DataFrame, field: str, classes: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``class_name`` and ``rgb`` from a class table (id, name, color);
    unknown ids are grey, or an error when strict. Ids below -1 count as -1."""
    c = classes.select(F.col("id").alias("_id"), F.col("name").alias("class_name"), F.col("color").alias("rgb"))
    j = points.withColumn("_id", F.greatest(F.col(field), F.lit(-1))).join(c, "_id", "left")
    grey = F.array(*map(F.lit, GREY_204))
    if strict:
        grey = F.when(F.col("class_name").isNotNull(), grey).otherwise(F.raise_error(F.concat(F.lit("unknown class "), F.col("_id"))).cast("array<int>"))
    return j.withColumn("rgb", F.coalesce("rgb", grey)).drop("_id")


def remap(points: DataFrame, field: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """Replace ids simultaneously; the last pair for an id wins."""
    if not pairs:
        return points
    m = F.create_map(*(F.lit(v) for kv in dict(pairs).items() for v in kv))
    return points.withColumn(field, F.coalesce(m[F.col(field)], F.col(field)).cast("int"))


def remap_by(points: DataFrame, field: str, pairs: DataFrame) -> DataFrame:
    """As ``remap`` for large maps: a table (old, new, seq), joined."""
    last = pairs.groupBy("old").agg(F.max_by("new", "seq").alias("_new"))
    return points.join(last, points[field] == last["old"], "left").withColumn(field, F.coalesce("_new", field).cast("int")).drop("old", "_new")


def classes_present(points: DataFrame, field: str, classes: DataFrame) -> DataFrame:
    return classes.join(points.select(F.col(field).alias("id")).distinct(), "id", "left_semi")


def label_combinations(points: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct combinations with ``n``, ``first_id`` and a dense ``combo_id``.
    Only the distinct combinations are numbered, in range partitions: each row's
    place in its partition plus the rows of the partitions before it."""
    combos = points.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.min(ID).alias("first_id"))
    parts = materialise(combos.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*cols)) - 1
    return parts.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("combo_id", (F.col("_place") + F.col("_before")).cast("int")).drop("_part", "_place", "_before")


def flatten_labels(points: DataFrame, cols: list[str], name: str = "label") -> DataFrame:
    """Add one dense label for each combination of label columns."""
    combos = label_combinations(points, cols).select(*(F.col(c).alias("_" + c) for c in cols), F.col("combo_id").alias(name))
    cond = [F.col(c).eqNullSafe(F.col("_" + c)) for c in cols]
    return points.join(combos, cond, "left").select(*points.columns, name)


def mex(df: DataFrame, col: str, name: str = "mex") -> DataFrame:
    """One row: the smallest non-negative integer that does not occur. It is 0
    or follows a value that occurs: the least of these that does not occur."""
    v = df.select(F.col(col).cast("long").alias("v")).where("v >= 0").distinct()
    after = v.select((F.col("v") + 1).alias("v")).unionAll(df.sparkSession.range(1).select(F.col("id").alias("v")))
    return after.join(v, "v", "left_anti").agg(F.min("v").cast("int").alias(name))


def required_ids(points: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct ids of the label columns and -1."""
    out = points.select(F.lit(-1).alias("id"))
    for c in cols:
        out = out.union(points.select(F.col(c).cast("int")))
    return out.where("id is not null").distinct()


def annotate(points: DataFrame, selection: DataFrame, sem: str | None = None, class_id: int | None = None, inst: str | None = None) -> DataFrame:
    """Set a class and/or a fresh instance id on the selection."""
    if sem is None and inst is None:
        raise ValueError("a semantic or an instance field is needed")
    s = selection.select(ID).distinct().withColumn("_in", F.lit(True))
    out = points.join(s, ID, "left")
    if sem is not None:
        out = out.withColumn(sem, F.when(F.col("_in"), F.lit(class_id).cast("int")).otherwise(F.col(sem)))
    if inst is not None:
        out = out.crossJoin(F.broadcast(mex(points, inst, "_new"))).withColumn(inst, F.when(F.col("_in"), F.col("_new")).otherwise(F.col(inst))).drop("_new")
    return out.drop("_in").select(points.columns)


def replay_edits(points: DataFrame, log: DataFrame, field: str, as_of: int | None = None) -> DataFrame:
    """Apply a log (edit_seq, point_id, field, new): the latest edit of a point
    wins; undo and redo are a smaller or larger ``as_of``."""
    use = log.where(F.col("field") == field)
    if as_of is not None:
        use = use.where(F.col("edit_seq") <= as_of)
    last = use.groupBy(ID).agg(F.max_by("new", "edit_seq").alias("_new"))
    return points.join(last, ID, "left").withColumn(field, F.coalesce("_new", field).cast("int")).drop("_new").select(points.columns)
