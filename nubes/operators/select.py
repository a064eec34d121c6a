"""Selections (tables of ``point_id``), set operations, visibility, picking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import in_polygon, project
from ..functions.storage import materialise

ID = "point_id"


def polygon_select(points: DataFrame, polygon, matrix, w: float, h: float, mode: str = "in") -> DataFrame:
    """Points whose projection lies in the polygon, or all others (``out``)."""
    if len(polygon) < 3:
        return points.select(ID).limit(0)
    sx, sy, _ = project(F.col("x"), F.col("y"), F.col("z"), matrix, w, h)
    inside = in_polygon(sx, sy, polygon)
    return points.where(inside if mode == "in" else ~inside).select(ID)


def similar_select(points: DataFrame, field: str, picked: int, tol: float) -> DataFrame:
    """Points whose field lies within ``tol`` of the picked point's (strictly);
    scalars by difference, vectors by Euclidean distance. One row is broadcast."""
    one = F.broadcast(points.where(F.col(ID) == picked).select(F.col(field).alias("_v")).limit(1))
    if points.schema[field].dataType.typeName() == "array":
        apart = F.sqrt(F.aggregate(F.zip_with(field, "_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    else:
        apart = F.abs(F.col(field) - F.col("_v"))
    return points.crossJoin(one).where(apart < tol).select(ID)


def class_select(points: DataFrame, classes: dict[str, list[int]]) -> DataFrame:
    """Points whose label is among the ids in any of the fields."""
    hit = F.lit(False)
    for field, ids in classes.items():
        hit = hit | F.coalesce(F.col(field).isin(ids), F.lit(False))
    return points.where(hit).select(ID).distinct()


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """UNION, DIFFERENCE, INTERSECTION, EXCLUSION or OVERWRITE of selections."""
    if how == "UNION":
        return a.union(b).distinct()
    if how == "DIFFERENCE":
        return a.subtract(b)
    if how == "INTERSECTION":
        return a.intersect(b)
    if how == "EXCLUSION":
        sides = a.select(ID, F.lit(1).alias("s")).union(b.select(ID, F.lit(2).alias("s")))
        return sides.groupBy(ID).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo = hi").select(ID)
    if how == "OVERWRITE":
        return b.distinct()
    raise ValueError(f"unknown operation {how}")


def replay_selections(log: DataFrame, ops: DataFrame, as_of: int | None = None) -> DataFrame:
    """The selection after a log of set operations: ``ops`` has ``seq, how``,
    ``log`` the operands' rows ``seq, point_id``. Undo and redo are a smaller or
    larger ``as_of``; nothing is selected before the first operation.

    Each point's bit is folded over the operations that name it. INTERSECTION
    and OVERWRITE clear the bit of points that they don't name: whether one lies
    between two operations of a point is told by running counts over the table
    of operations, a row each, so the log is shuffled once, by point."""
    if as_of is not None:
        ops, log = ops.where(F.col("seq") <= as_of), log.where(F.col("seq") <= as_of)
    how = F.upper("how")
    known = F.when(how.isin("UNION", "DIFFERENCE", "INTERSECTION", "EXCLUSION", "OVERWRITE"), how).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("how", F.lit("null")))))
    clears = F.expr("CAST(how IN ('INTERSECTION', 'OVERWRITE') AS int)")
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ops = ops.withColumn("how", known).select("seq", "how", F.sum(clears).over(w).alias("upto"), clears.alias("clear"))
    rows = log.select("seq", ID).distinct().join(ops, "seq")
    each = rows.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("seq", "how", "upto", "clear"))).alias("s"))
    step = """aggregate(s, named_struct('bit', false, 'seen', 0L), (a, e) -> named_struct('bit', CASE e.how WHEN 'UNION' THEN true WHEN 'OVERWRITE' THEN true WHEN 'DIFFERENCE' THEN false
      WHEN 'INTERSECTION' THEN a.bit AND e.upto - e.clear = a.seen ELSE NOT (a.bit AND e.upto - e.clear = a.seen) END, 'seen', e.upto))"""
    last = ops.agg(F.max("upto").alias("all"))
    return each.select(ID, F.expr(step).alias("f")).crossJoin(F.broadcast(last)).where("f.bit AND f.seen = all").select(ID)


def deselect(points: DataFrame) -> DataFrame:
    return points.select(ID).limit(0)


def invalid_selection(points: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected ids that are no points: empty if the selection is valid."""
    return selection.join(points, ID, "left_anti")


def invalid_mask(points: DataFrame, mask: DataFrame) -> DataFrame:
    """``point_id, rule``: points without a value in the mask (point_id,
    visible), ids that are no points, and ids with several values; empty if the
    mask is valid."""
    own = mask.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.count("visible").alias("set"))
    both = points.select(ID, F.lit(True).alias("known")).join(own, ID, "full")
    rule = F.when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(F.coalesce("set", F.lit(0)) == 0, "missing")
    return both.select(ID, rule.alias("rule")).where("rule is not null")


def _flagged(points: DataFrame, selection: DataFrame) -> DataFrame:
    return points.join(selection.select(ID).distinct().withColumn("_in", F.lit(True)), ID, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def _shown() -> F.Column:
    return F.coalesce(F.col("visible"), F.lit(True))


def hide(points: DataFrame, selection: DataFrame) -> DataFrame:
    return _flagged(points, selection).withColumn("visible", _shown() & ~F.col("_in")).drop("_in")


def isolate(points: DataFrame, selection: DataFrame) -> DataFrame:
    return _flagged(points, selection).withColumn("visible", F.col("_in")).drop("_in")


def show_all(points: DataFrame) -> DataFrame:
    return points.withColumn("visible", F.lit(True))


def visible_points(points: DataFrame) -> DataFrame:
    return points.where(_shown())


def counts(points: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: ``n_visible, n_total, n_selected``."""
    f = _flagged(points, selection)
    return f.agg(F.count_if(_shown()).alias("n_visible"), F.count(F.lit(1)).alias("n_total"), F.count_if("_in").alias("n_selected"))


def bbox_filter(points: DataFrame, low, high) -> DataFrame:
    for c, a, b in zip("xyz", low, high, strict=True):
        points = points.where(F.col(c).between(a, b))
    return points


def with_position(points: DataFrame, buckets: int | None = None, name: str = "position") -> DataFrame:
    """Number the rows from 0 by point id without one task seeing all: ranges of
    ids, alike in size however the ids are spread, are sorted and written once;
    a row's place within its range is added to the counts before it. ``buckets``
    is the number of shuffle partitions unless given, 1000 at most."""
    n = min(1000, buckets or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = materialise(points.repartitionByRange(n, ID).sortWithinPartitions(ID).withColumn("_m", F.monotonically_increasing_id()))
    cut = cut.withColumn("_b", F.shiftright("_m", 33))  # the range above, the place within it below
    sizes = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return cut.join(F.broadcast(before), "_b").withColumn(name, (place + F.col("_before")).cast("long")).drop("_b", "_m", "_before")


def every_kth(points: DataFrame, k: int = 100) -> DataFrame:
    """A coarse level of detail: every k-th point by id."""
    return with_position(points).where(F.col("position") % k == 0).drop("position")


def pick(points: DataFrame, px: float, py: float, matrix, w: float, h: float, radius: float = 1.0) -> DataFrame:
    """The front-most visible point in a square of pixels: one row or none."""
    sx, sy, depth = project(F.col("x"), F.col("y"), F.col("z"), matrix, w, h)
    seen = visible_points(points).select(ID, sx.alias("sx"), sy.alias("sy"), depth.alias("depth"))
    return seen.where((F.abs(F.col("sx") - px) <= radius) & (F.abs(F.col("sy") - py) <= radius)).orderBy("depth", ID).limit(1)
