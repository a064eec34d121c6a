"""Voxel cells, bounding boxes, chunks, plane fits per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import flatten_index
from .neighbors import eigen_features

AXES = ("x", "y", "z")
PAD = 1e-3


def bounding_box(points: DataFrame, pad: float = PAD) -> DataFrame:
    """One row: padded minimum and maximum of each axis."""
    return points.agg(*((F.min(c) - pad).alias(f"min_{c}") for c in AXES), *((F.max(c) + pad).alias(f"max_{c}") for c in AXES))


def to_positive(points: DataFrame) -> DataFrame:
    """Coordinates shifted by their minima (one broadcast row)."""
    low = points.agg(*(F.min(c).alias("_" + c) for c in AXES))
    return points.crossJoin(F.broadcast(low)).withColumns({c: F.col(c) - F.col("_" + c) for c in AXES}).drop(*("_" + c for c in AXES))


CELL = ("cx", "cy", "cz")


def with_cell(points: DataFrame, size: float) -> DataFrame:
    """Add the cell of positive coordinates as three columns, of any range."""
    return points.withColumns({"c" + c: F.floor(F.col(c) * (1.0 / size)) for c in AXES})


def voxel_members(points: DataFrame, size: float) -> DataFrame:
    """``cx, cy, cz, point_id``: the cell of each point."""
    return with_cell(to_positive(points), size).select(*CELL, "point_id")


def voxel_groups(points: DataFrame, size: float) -> DataFrame:
    """``cx, cy, cz, n, first_id`` of each occupied cell."""
    return voxel_members(points, size).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first_id"))


def occupied_cells(points: DataFrame, size: float) -> DataFrame:
    """One row: ``n_cells``."""
    return voxel_members(points, size).select(*CELL).distinct().agg(F.count(F.lit(1)).alias("n_cells"))


def with_curve(points: DataFrame, name: str = "curve") -> DataFrame:
    """Add each point's place on a Z-order curve through the cloud's box (21
    bits an axis): points that are near each other in it are near in space."""
    box = F.broadcast(bounding_box(points))
    out = points.crossJoin(box).selectExpr("*", *(f"least(greatest(CAST((CAST({c} AS double) - min_{c}) / (max_{c} - min_{c}) * 2097152 AS bigint), 0L), 2097151L) AS _{c}" for c in AXES))
    # Each step moves half of the bits apart, until two gaps follow each
    for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        out = out.withColumns({"_" + c: F.expr(f"(_{c} | shiftleft(_{c}, {by})) & {mask}L") for c in AXES})
    out = out.withColumn(name, F.expr("shiftleft(_x, 2) | shiftleft(_y, 1) | _z"))
    return out.drop(*("_" + c for c in AXES), *(f"{m}_{c}" for m in ("min", "max") for c in AXES))


def scalar_range(points: DataFrame, field: str) -> DataFrame:
    """One row: ``lo, hi`` of a field over the visible points."""
    from .select import visible_points

    seen = visible_points(points) if "visible" in points.columns else points
    return seen.agg(F.min(field).alias("lo"), F.max(field).alias("hi"))


def chunk_by_number(points: DataFrame, nx: int, ny: int, nz: int) -> DataFrame:
    """Add ``chunk_id``: the padded box cut in nx x ny x nz equal chunks."""
    return _chunk(points, [(F.col(f"max_{c}") - F.col(f"min_{c}")) / n for c, n in zip(AXES, (nx, ny, nz), strict=True)], F.lit(ny), F.lit(nz))


def chunk_by_size(points: DataFrame, sx: float, sy: float, sz: float) -> DataFrame:
    """Add ``chunk_id``: chunks of the given edges, as many as the box needs."""
    sizes = (sx, sy, sz)
    many = [F.ceil((F.col(f"max_{c}") - F.col(f"min_{c}")) / s) for c, s in zip(AXES, sizes, strict=True)]
    return _chunk(points, [F.lit(float(s)) for s in sizes], many[1], many[2])


def _chunk(points: DataFrame, edges, ny, nz) -> DataFrame:
    box = F.broadcast(bounding_box(points))
    cells = [F.floor((F.col(c) - F.col(f"min_{c}")) / e) for c, e in zip(AXES, edges, strict=True)]
    out = points.crossJoin(box).withColumn("chunk_id", flatten_index(*cells, ny, nz).cast("long"))
    return out.drop(*(f"{m}_{c}" for m in ("min", "max") for c in AXES))


def plane_fit(points: DataFrame, group: str, scale: float = 1.0) -> DataFrame:
    """Per group: ``n``, centroid ``cx, cy, cz`` and the plane's ``normal``.
    Sums are taken about the groups' rounded centroids, so that large
    coordinates lose no digits; the second pass is one more aggregation."""
    mean = points.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias("s" + c) for c in AXES))
    mean = mean.withColumns({"m" + c: F.round(F.col("s" + c) / F.col("n")) for c in AXES})
    off = points.join(mean.select(group, "mx", "my", "mz"), group).select(group, *((F.col(c) - F.col("m" + c)).alias("d" + c) for c in AXES))
    pairs = {"xx": "xx", "xy": "xy", "xz": "xz", "yy": "yy", "yz": "yz", "zz": "zz"}
    second = off.groupBy(group).agg(*(F.sum("d" + c).alias("t" + c) for c in AXES), *(F.sum(F.col("d" + p[0]) * F.col("d" + p[1])).alias(p) for p in pairs))
    both = mean.join(second, group)
    both = both.withColumns({p: F.col(p) - F.col("t" + p[0]) * F.col("t" + p[1]) / F.col("n") for p in pairs})
    out = eigen_features(both, scale, normals=True, eigenvals=False)
    return out.select(group, "n", *((F.col("s" + c) / F.col("n")).alias("c" + c) for c in AXES), "normal")
