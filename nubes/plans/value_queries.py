"""Registered queries of Column expressions: cells, distances, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.color import COLOR_MAPS, apply_colormap, blend, dark_text, random_color
from ..functions.geometry import dot, squared_distance, steady, unflatten_index, voxel_key
from ..operators import fields, grid, neighbors, select
from .queries import _BOX, PAIRS_SQL, SUMS_SQL, R, _eigen_sql, _steady_sql, query
from .views import E_SQL, L_SQL, Q_SQL, points_e, points_l, quantised


@query(
    f"""WITH {L_SQL}, lo AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM points_l),
  c AS (SELECT point_id, CAST(trunc((x - mx) * 2.0) AS BIGINT) AS cx, CAST(trunc((y - my) * 2.0) AS BIGINT) AS cy, CAST(trunc((z - mz) * 2.0) AS BIGINT) AS cz FROM points_l, lo)
SELECT point_id, ((cx & 2097151) << 42) | ((cy & 2097151) << 21) | (cz & 2097151) AS voxel FROM c"""
)
def voxel_keys(spark, d):
    p = grid.to_positive(points_l(spark, d))
    return p.select("point_id", voxel_key(F.col("x"), F.col("y"), F.col("z"), 2.0).alias("voxel"))


@query(f"WITH {L_SQL}, lo AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM points_l) SELECT count(*) AS n_cells FROM (SELECT DISTINCT floor(x - mx), floor(y - my), floor(z - mz) FROM points_l, lo)")
def occupied_cells(spark, d):
    return grid.occupied_cells(points_l(spark, d), 1.0)


@query(f"WITH {L_SQL}, lo AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM points_l) SELECT CAST(floor(x - mx) AS BIGINT) AS cx, CAST(floor(y - my) AS BIGINT) AS cy, CAST(floor(z - mz) AS BIGINT) AS cz, point_id FROM points_l, lo")
def voxel_members(spark, d):
    return grid.voxel_members(points_l(spark, d), 1.0)


@query(
    f"WITH {L_SQL}, {_BOX} SELECT point_id, CAST(floor((x - lx) / ((hx - lx) / 4)) AS BIGINT) AS ix, CAST(floor((y - ly) / ((hy - ly) / 3)) AS BIGINT) AS iy, CAST(floor((z - lz) / ((hz - lz) / 2)) AS BIGINT) AS iz FROM points_l, b"
)
def chunk_cells(spark, d):
    """A chunk's number taken apart again."""
    p = grid.chunk_by_number(points_l(spark, d), 4, 3, 2)
    return p.select("point_id", *(c.cast("long").alias(n) for c, n in zip(unflatten_index(F.col("chunk_id"), 3, 2), ("ix", "iy", "iz"), strict=True)))


@query(f"WITH {E_SQL} SELECT point_id, (x - 1.5) * (x - 1.5) + (y - 2.5) * (y - 2.5) + (z - 0.5) * (z - 0.5) AS d2, x * 0.5 + y * -2.0 + z * 4.0 AS along FROM points_e")
def distances(spark, d):
    xyz = [F.col(c) for c in "xyz"]
    return points_e(spark, d).select("point_id", squared_distance(xyz, [F.lit(1.5), F.lit(2.5), F.lit(0.5)]).alias("d2"), dot(xyz, [F.lit(0.5), F.lit(-2.0), F.lit(4.0)]).alias("along"))


@query(
    f"WITH {Q_SQL}, {PAIRS_SQL}, {SUMS_SQL}, {_eigen_sql('s')} SELECT q_id AS point_id, CASE WHEN high > 0 THEN {_steady_sql('(mid - low) / high', 3)} END AS \"planarity(r=0.500)\", CASE WHEN high > 0 THEN {_steady_sql('low / high', 3)} END AS \"sphericity(r=0.500)\" FROM e6"
)
def named_features(spark, d):
    """Features under their default names."""
    f, names = neighbors.compute_features(quantised(points_e(spark, d)), R, normals=False, scale=1e-8), neighbors.field_names(0.5)
    return f.select("point_id", *(steady(F.col(c), 3).alias(names[c]) for c in ("planarity", "sphericity")))


# ----------------------------------------------------------------------- colours


def _map_sql(points) -> str:
    """A map's colour at pos as one number, r * 65536 + g * 256 + b."""
    num = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    points, out = sorted(points), []
    for c in (1, 2, 3):
        steps = " ".join(f"WHEN pos <= {num(b[0])} THEN {num(a[c])} + (pos - {num(a[0])}) * {num((b[c] - a[c]) / (b[0] - a[0]))}" for a, b in zip(points, points[1:], strict=False))
        out.append(f"CAST(trunc((CASE {steps} ELSE {num(points[-1][c])} END) * 255) AS INT)")
    return f"{out[0]} * 65536 + {out[1]} * 256 + {out[2]}"


_OWN = {"own": ("rgb", [(1.0, 1.0, 0.5, 0.0), (0.0, 0.0, 0.25, 1.0), (0.5, 0.75, 0.0, 0.125)])}
_MAPS = COLOR_MAPS | _OWN
_POS = f"WITH {E_SQL}, t AS (SELECT point_id, greatest(least(intensity / CAST(80.0 AS DOUBLE), 1.0), 0.0) AS pos FROM points_e) "


@query(_POS + "SELECT point_id, " + ", ".join(f"{_map_sql(p)} AS \"{n}\"" for n, (_, p) in _MAPS.items()) + " FROM t")
def colorize_maps(spark, d):
    """Every colour map, and one whose control points are not in order."""
    one = lambda c: F.get(c, F.lit(0)) * 65536 + F.get(c, F.lit(1)) * 256 + F.get(c, F.lit(2))
    return points_e(spark, d).select("point_id", *(one(apply_colormap(F.col("intensity"), n, 0.0, F.lit(80.0), _MAPS)).alias(n) for n in _MAPS))


@query(f"WITH {E_SQL} SELECT point_id, sem * 10.0 * 0.75 + 200.0 * 0.25 AS r, inst * 20.0 * 0.75 + 40.0 * 0.25 AS g FROM points_e")
def blend_colors(spark, d):
    a, b = F.array(F.col("sem") * 10.0, F.col("inst") * 20.0), F.array(F.lit(200.0), F.lit(40.0))
    return points_e(spark, d).select("point_id", *(F.get(blend(a, b, 0.25), F.lit(i)).alias(c) for i, c in enumerate("rg")))


@query(f"WITH {E_SQL} SELECT point_id, 0.2126 * (inst * 40) + 0.7152 * (inst * 30) + 0.0722 * 9 > 128 AS dark FROM points_e")
def text_on_color(spark, d):
    return points_e(spark, d).select("point_id", dark_text(F.array(F.col("inst") * 40, F.col("inst") * 30, F.lit(9))).alias("dark"))


@query(f"WITH {E_SQL} SELECT count(*) AS n, 229 AS least_top, 229 AS most_top, 22 AS low, 6 AS n_sixths, true AS even, true AS again FROM points_e")
def random_colors(spark, d):
    """Random hues of one value and saturation: the largest component is always
    0.9 of 255, the smallest a tenth of it; all sixths of the colour circle have
    their share, and a seed gives the same colours again."""
    c = points_e(spark, d).select(random_color(7).alias("c"), random_color(7).alias("e"))
    r, g, b = (F.get("c", F.lit(i)) for i in range(3))
    sixth = F.when((r >= g) & (g > b), 0).when((g >= r) & (r > b), 1).when((g >= b) & (b > r), 2).when((b >= g) & (g > r), 3).when((b >= r) & (r > g), 4).otherwise(5)
    per = c.withColumn("sixth", sixth).groupBy("sixth").agg(F.count(F.lit(1)).alias("k"), F.min(F.array_max("c")).alias("lt"), F.max(F.array_max("c")).alias("mt"), F.max(F.array_min("c")).alias("lo"), F.bool_and(F.col("c") == F.col("e")).alias("same"))
    share = F.col("n") / 6
    one = per.agg(F.sum("k").alias("n"), F.min("lt").alias("least_top"), F.max("mt").alias("most_top"), F.max("lo").alias("low"), F.count(F.lit(1)).alias("n_sixths"), F.min("k").alias("few"), F.max("k").alias("many"), F.bool_and("same").alias("again"))
    return one.select("n", "least_top", "most_top", "low", "n_sixths", ((F.col("few") > 0.7 * share) & (F.col("many") < 1.3 * share)).alias("even"), "again")


@query(f"WITH {E_SQL} SELECT point_id, 153 AS r, 153 AS g, 153 AS b FROM points_e WHERE inst <> 3")
def colorize_none(spark, d):
    """Without a field, visible points are grey."""
    c = fields.colorize(points_e(spark, d).withColumn("visible", F.col("inst") != 3), "", "")
    return c.select("point_id", *(F.get("rgb", F.lit(i)).alias(k) for i, k in enumerate("rgb")))


@query(f"WITH {E_SQL} SELECT DISTINCT point_id FROM points_e WHERE sem IN (0, 1)")
def deselect(spark, d):
    """Nothing selected, then a selection added."""
    p = points_e(spark, d)
    return select.combine(select.deselect(p), select.class_select(p, {"sem": [0, 1]}), "UNION")
