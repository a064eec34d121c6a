"""Registered queries over the point views: one thin function for each, with
the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import COLOR_MAPS, apply_colormap
from ..functions.geometry import steady
from ..functions.storage import work_dir
from ..operators import fields, grid, growth, labels, neighbors, schema, segment, select
from ..sources import documents, toollog
from .views import E_SQL, L_SQL, Q_SQL, V_SQL, points_e, points_l, points_v, quantised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


R = 5000  # 0.5 in quantised units


def _eigen_sql(source: str, six: str = "xx, xy, xz, yy, yz, zz", key: str = "q_id, n") -> str:
    """Chained CTEs: closed-form eigenvalues low, mid, high of ``source``."""
    return f"""
e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM {source}),
e2 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM e1),
e3 AS (SELECT *, (xx - q) / nullif(p, 0) AS a, (yy - q) / nullif(p, 0) AS b, (zz - q) / nullif(p, 0) AS c, xy / nullif(p, 0) AS d, yz / nullif(p, 0) AS e, xz / nullif(p, 0) AS f FROM e2),
e4 AS (SELECT *, acos(greatest(least(coalesce(a * (b * c - e * e) - d * (d * c - e * f) + f * (d * e - b * f), 0.0) / 2, 1.0), -1.0)) / 3 AS phi FROM e3),
e5 AS (SELECT *, q + 2 * p * cos(phi) AS high, q + 2 * p * cos(phi + 2 * pi() / 3) AS l0 FROM e4),
e6 AS (SELECT *, greatest(l0, 0.0) AS low, greatest(3 * q - high - l0, 0.0) AS mid FROM e5)"""


def _plane_sql() -> str:
    """CTEs from ``i`` (region_id, x, y, z) to ``pl``: each region's centre px,
    py, pz and normal ux, uy, uz."""
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    firsts, seconds = ", ".join(f"sum(d{c}) AS t{c}" for c in "xyz"), ", ".join(f"sum(d{p[0]} * d{p[1]}) AS b{p}" for p in pairs)
    return f"""
m AS (SELECT region_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM i GROUP BY region_id),
o AS (SELECT i.region_id, {", ".join(f"i.{c} - round(m.s{c} / m.n) AS d{c}" for c in "xyz")} FROM i JOIN m ON i.region_id = m.region_id),
t AS (SELECT region_id, {firsts}, {seconds} FROM o GROUP BY region_id),
s AS (SELECT t.region_id, n, sx, sy, sz, {", ".join(f"b{p} - t{p[0]} * t{p[1]} / n AS {p}" for p in pairs)} FROM t JOIN m ON t.region_id = m.region_id),
{_eigen_sql("s")}, {_normal_sql()}, pl AS (SELECT region_id, sx / n AS px, sy / n AS py, sz / n AS pz, ux, uy, uz FROM n7)"""


def _normal_sql() -> str:
    """CTEs after _eigen_sql: unit normal ux, uy, uz, null where ambiguous."""
    return """
n1 AS (SELECT *, xx - low AS r00, yy - low AS r11, zz - low AS r22 FROM e6),
n2 AS (SELECT *, xy * yz - xz * r11 AS ax, xz * xy - r00 * yz AS ay, r00 * r11 - xy * xy AS az,
  xy * r22 - xz * yz AS bx, xz * xz - r00 * r22 AS by_, r00 * yz - xy * xz AS bz,
  r11 * r22 - yz * yz AS cx_, yz * xz - xy * r22 AS cy_, xy * yz - r11 * xz AS cz_ FROM n1),
n3 AS (SELECT *, ax * ax + ay * ay + az * az AS sa, bx * bx + by_ * by_ + bz * bz AS sb, cx_ * cx_ + cy_ * cy_ + cz_ * cz_ AS sc FROM n2),
n4 AS (SELECT *, CASE WHEN sa >= sb AND sa >= sc THEN [ax, ay, az] WHEN sb >= sc THEN [bx, by_, bz] ELSE [cx_, cy_, cz_] END AS v, sqrt(greatest(sa, sb, sc)) AS len FROM n3),
n5 AS (SELECT *, v[1] / nullif(len, 0) AS u1, v[2] / nullif(len, 0) AS u2, v[3] / nullif(len, 0) AS u3 FROM n4),
n6 AS (SELECT *, CASE WHEN (CASE WHEN abs(u1) > 1e-6 THEN u1 WHEN abs(u2) > 1e-6 THEN u2 ELSE u3 END) < 0 THEN -1.0 ELSE 1.0 END AS sg, mid - low > 1e-6 * high AS clear FROM n5),
n7 AS (SELECT *, CASE WHEN clear THEN u1 * sg END AS ux, CASE WHEN clear THEN u2 * sg END AS uy, CASE WHEN clear THEN u3 * sg END AS uz FROM n6)"""


def _steady_sql(x: str, digits: int = 4) -> str:
    return f"floor({x} * {10**digits}.0 + 0.50005) / {10**digits}.0"


PAIRS_SQL = f"""pr AS (SELECT a.point_id AS q_id, b.point_id AS p_id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM q a JOIN q b
  ON b.x BETWEEN a.x - {R} AND a.x + {R} WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= {R * R})"""
SUMS_SQL = """s AS (SELECT q_id, count(*) AS n, sum(dx * dx) * 1e-8 AS xx, sum(dx * dy) * 1e-8 AS xy, sum(dx * dz) * 1e-8 AS xz, sum(dy * dy) * 1e-8 AS yy,
  sum(dy * dz) * 1e-8 AS yz, sum(dz * dz) * 1e-8 AS zz FROM pr GROUP BY q_id)"""


# --------------------------------------------------------- neighbours, features


@query(f"WITH {Q_SQL}, {PAIRS_SQL} SELECT q_id AS point_id, count(*) AS n_neighbors FROM pr GROUP BY q_id")
def neighbor_counts(spark, d):
    p = quantised(points_e(spark, d))
    return neighbors.neighbor_counts(p, p, R).select(F.col("q_id").alias("point_id"), F.col("n").alias("n_neighbors"))


@query(
    f"WITH {Q_SQL}, {PAIRS_SQL}, {SUMS_SQL}, {_eigen_sql('s')} SELECT q_id AS point_id, n, {_steady_sql('low')} AS l0, {_steady_sql('mid')} AS l1, {_steady_sql('high')} AS l2, "
    f"CASE WHEN high > 0 THEN {_steady_sql('(mid - low) / high', 3)} END AS planarity, CASE WHEN high > 0 THEN {_steady_sql('low / high', 3)} END AS sphericity FROM e6"
)
def features(spark, d):
    f = neighbors.compute_features(quantised(points_e(spark, d)), R, normals=False, scale=1e-8)
    ev = [steady(F.get("eigenvalues", F.lit(i))).alias(f"l{i}") for i in range(3)]
    return f.select("point_id", "n", *ev, steady(F.col("planarity"), 3).alias("planarity"), steady(F.col("sphericity"), 3).alias("sphericity"))


@query(
    f"WITH {Q_SQL}, {PAIRS_SQL}, {SUMS_SQL}, s2 AS (SELECT s.* FROM s JOIN q ON q.point_id = s.q_id WHERE q.inst = 0), {_eigen_sql('s2')}, {_normal_sql()} "
    f"SELECT q_id AS point_id, {_steady_sql('ux', 2)} AS nx, {_steady_sql('uy', 2)} AS ny, {_steady_sql('uz', 2)} AS nz FROM n7"
)
def normals(spark, d):
    p = quantised(points_e(spark, d))
    n = neighbors.compute_normals(p, p.where("inst = 0"), R, scale=1e-8)
    return n.select("point_id", *(steady(F.get("normal", F.lit(i)), 2).alias("n" + c) for i, c in enumerate("xyz")))


@query(
    f"WITH {Q_SQL}, {PAIRS_SQL}, {SUMS_SQL}, {_eigen_sql('s')}, {_normal_sql()} "
    f"SELECT q_id AS point_id, {_steady_sql('ux', 2)} AS nx, {_steady_sql('uy', 2)} AS ny, {_steady_sql('uz', 2)} AS nz FROM n7"
)
def normals_all(spark, d):
    """As normals, for every point of the cloud."""
    p = quantised(points_e(spark, d))
    n = neighbors.compute_normals(p, p, R, scale=1e-8)
    return n.select("point_id", *(steady(F.get("normal", F.lit(i)), 2).alias("n" + c) for i, c in enumerate("xyz")))


@query(f"WITH {E_SQL} SELECT point_id, (x - 15) * (x - 15) + (y - 2.5) * (y - 2.5) + (z - 5) * (z - 5) AS d2 FROM points_e WHERE (x - 15) * (x - 15) + (y - 2.5) * (y - 2.5) + (z - 5) * (z - 5) <= 4.0")
def radius_query(spark, d):
    return neighbors.radius_query(points_e(spark, d), (15.0, 2.5, 5.0), 2.0)


# ------------------------------------------------------------------ grid, chunks


@query(
    f"""WITH {L_SQL}, lo AS (SELECT min(x) AS mx, min(y) AS my, min(z) AS mz FROM points_l),
  c AS (SELECT point_id, CAST(trunc((x - mx) * 1.0) AS BIGINT) AS cx, CAST(trunc((y - my) * 1.0) AS BIGINT) AS cy, CAST(trunc((z - mz) * 1.0) AS BIGINT) AS cz FROM points_l, lo)
SELECT cx, cy, cz, count(*) AS n, min(point_id) AS first_id FROM c GROUP BY cx, cy, cz"""
)
def voxel_counts(spark, d):
    return grid.voxel_groups(points_l(spark, d), 1.0)


@query(f"WITH {L_SQL} SELECT min(x) - 0.001 AS min_x, min(y) - 0.001 AS min_y, min(z) - 0.001 AS min_z, max(x) + 0.001 AS max_x, max(y) + 0.001 AS max_y, max(z) + 0.001 AS max_z FROM points_l")
def bbox(spark, d):
    return grid.bounding_box(points_l(spark, d))


_BOX = "b AS (SELECT min(x) - 0.001 AS lx, min(y) - 0.001 AS ly, min(z) - 0.001 AS lz, max(x) + 0.001 AS hx, max(y) + 0.001 AS hy, max(z) + 0.001 AS hz FROM points_l)"


@query(
    f"WITH {L_SQL}, {_BOX} SELECT CAST(floor((x - lx) / ((hx - lx) / 4)) * 3 * 2 + floor((y - ly) / ((hy - ly) / 3)) * 2 + floor((z - lz) / ((hz - lz) / 2)) AS BIGINT) AS chunk_id, "
    "count(*) AS n, min(point_id) AS first_id FROM points_l, b GROUP BY 1"
)
def chunk_counts_by_number(spark, d):
    return _chunk_counts(grid.chunk_by_number(points_l(spark, d), 4, 3, 2))


@query(
    f"WITH {L_SQL}, {_BOX} SELECT CAST(floor((x - lx) / 10.0) * ceil((hy - ly) / 9.0) * ceil((hz - lz) / 4.0) + floor((y - ly) / 9.0) * ceil((hz - lz) / 4.0) + floor((z - lz) / 4.0) AS BIGINT) AS chunk_id, "
    "count(*) AS n, min(point_id) AS first_id FROM points_l, b GROUP BY 1"
)
def chunk_counts_by_size(spark, d):
    return _chunk_counts(grid.chunk_by_size(points_l(spark, d), 10.0, 9.0, 4.0))


def _chunk_counts(p):
    return p.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first_id"))


@query(
    f"""WITH {Q_SQL}, m AS (SELECT sem, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM q GROUP BY sem),
  o AS (SELECT q.sem, m.n, m.sx, m.sy, m.sz, q.x - round(m.sx / m.n) AS dx, q.y - round(m.sy / m.n) AS dy, q.z - round(m.sz / m.n) AS dz FROM q JOIN m ON q.sem = m.sem),
  t AS (SELECT sem, any_value(n) AS n, any_value(sx) AS sx, any_value(sy) AS sy, any_value(sz) AS sz, sum(dx) AS tx, sum(dy) AS ty, sum(dz) AS tz, sum(dx * dx) AS a1, sum(dx * dy) AS a2, sum(dx * dz) AS a3,
    sum(dy * dy) AS a4, sum(dy * dz) AS a5, sum(dz * dz) AS a6 FROM o GROUP BY sem),
  s AS (SELECT sem, n, sx, sy, sz, (a1 - tx * tx / n) * 1e-8 AS xx, (a2 - tx * ty / n) * 1e-8 AS xy, (a3 - tx * tz / n) * 1e-8 AS xz, (a4 - ty * ty / n) * 1e-8 AS yy, (a5 - ty * tz / n) * 1e-8 AS yz, (a6 - tz * tz / n) * 1e-8 AS zz FROM t),
  {_eigen_sql('s')}, {_normal_sql()}
SELECT sem, n, {_steady_sql('sx / n * 1e-4')} AS cx, {_steady_sql('sy / n * 1e-4')} AS cy, {_steady_sql('sz / n * 1e-4')} AS cz,
  {_steady_sql('ux', 3)} AS nx, {_steady_sql('uy', 3)} AS ny, {_steady_sql('uz', 3)} AS nz FROM n7"""
)
def plane_fit_by_label(spark, d):
    f = grid.plane_fit(quantised(points_e(spark, d)), "sem", scale=1e-8)
    return f.select("sem", "n", *(steady(F.col("c" + c) * 1e-4).alias("c" + c) for c in "xyz"), *(steady(F.get("normal", F.lit(i)), 3).alias("n" + c) for i, c in enumerate("xyz")))


# -------------------------------------------------------------------- selections

MATRIX = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0.1, 1.0]
POLYGON = [(50, 20), (150, 60), (260, 10), (300, 120), (420, 150), (330, 220), (390, 330), (260, 290), (180, 380), (150, 260), (40, 240), (110, 150)]
W = H = 20


def _inside_sql() -> str:
    hits = " + ".join(f"CAST((sy < {yi}) <> (sy < {yj}) AS INT) * CAST(sx < ({float(xj)} - {xi}) * (sy - {yi}) / ({float(yj)} - {yi} + 1e-12) + {xi} AS INT)" for (xi, yi), (xj, yj) in zip(POLYGON, [POLYGON[-1], *POLYGON[:-1]], strict=True))
    return f"(({hits}) % 2 = 1)"


_SCREEN = "sc AS (SELECT point_id, (x / (z * 0.1 + 1) + 1) / 2 * 20 AS sx, (y / (z * 0.1 + 1) + 1) / 2 * 20 AS sy, z / (z * 0.1 + 1) AS depth FROM points_l)"


@query(f"WITH {L_SQL}, {_SCREEN} SELECT point_id FROM sc WHERE {_inside_sql()}")
def polygon_in(spark, d):
    return select.polygon_select(points_l(spark, d), POLYGON, MATRIX, W, H)


@query(f"WITH {L_SQL}, {_SCREEN} SELECT point_id FROM sc WHERE NOT {_inside_sql()}")
def polygon_out(spark, d):
    return select.polygon_select(points_l(spark, d), POLYGON, MATRIX, W, H, "out")


@query(f"WITH {L_SQL}, {_SCREEN} SELECT point_id, sx, sy, depth FROM sc WHERE abs(sx - 100) <= 8 AND abs(sy - 100) <= 8 ORDER BY depth, point_id LIMIT 1")
def pick(spark, d):
    return select.pick(select.show_all(points_l(spark, d)), 100, 100, MATRIX, W, H, 8)


@query(f"WITH {E_SQL} SELECT point_id FROM points_e WHERE abs(intensity - (SELECT intensity FROM points_e WHERE point_id = 10)) < 3.0")
def similar_scalar(spark, d):
    return select.similar_select(points_e(spark, d), "intensity", 10, 3.0)


@query(f"WITH {V_SQL}, o AS (SELECT vec AS v FROM points_v WHERE point_id = 10) SELECT point_id FROM points_v, o WHERE sqrt(list_sum([CAST(t[1] - t[2] AS DOUBLE) * CAST(t[1] - t[2] AS DOUBLE) for t in list_zip(vec, v)])) < 1.0")
def similar_vector(spark, d):
    return select.similar_select(points_v(spark, d), "vec", 10, 1.0)


@query(f"WITH {E_SQL} SELECT point_id FROM points_e WHERE sem IN (1, 3) OR inst = 2")
def class_select(spark, d):
    return select.class_select(points_e(spark, d), {"sem": [1, 3], "inst": [2]})


def _two(spark, d):
    p = points_e(spark, d)
    return select.class_select(p, {"sem": [0, 1]}), select.class_select(p, {"inst": [0, 1, 2]})


_TWO = f"WITH {E_SQL}, a AS (SELECT point_id FROM points_e WHERE sem IN (0, 1)), b AS (SELECT point_id FROM points_e WHERE inst IN (0, 1, 2)) "


@query(_TWO + "SELECT point_id FROM a UNION SELECT point_id FROM b")
def sel_union(spark, d):
    return select.combine(*_two(spark, d), "UNION")


@query(_TWO + "SELECT point_id FROM a EXCEPT SELECT point_id FROM b")
def sel_difference(spark, d):
    return select.combine(*_two(spark, d), "DIFFERENCE")


@query(_TWO + "SELECT point_id FROM a INTERSECT SELECT point_id FROM b")
def sel_intersection(spark, d):
    return select.combine(*_two(spark, d), "INTERSECTION")


@query(_TWO + "(SELECT point_id FROM a EXCEPT SELECT point_id FROM b) UNION (SELECT point_id FROM b EXCEPT SELECT point_id FROM a)")
def sel_exclusion(spark, d):
    return select.combine(*_two(spark, d), "EXCLUSION")


@query(_TWO + "SELECT point_id FROM b")
def sel_overwrite(spark, d):
    return select.combine(*_two(spark, d), "OVERWRITE")


def _shown(spark, d):
    return points_e(spark, d).withColumn("visible", F.when(F.col("point_id") % 5 == 0, F.lit(None)).otherwise(F.col("inst") != 3))


_SHOWN = f"WITH {E_SQL}, v AS (SELECT *, CASE WHEN point_id % 5 = 0 THEN NULL ELSE inst <> 3 END AS visible FROM points_e) "


@query(_SHOWN + "SELECT point_id, coalesce(visible, true) AND sem <> 1 AS visible FROM v")
def hide(spark, d):
    p = _shown(spark, d)
    return select.hide(p, select.class_select(p, {"sem": [1]})).select("point_id", "visible")


@query(_SHOWN + "SELECT point_id, sem = 1 AS visible FROM v")
def isolate(spark, d):
    p = _shown(spark, d)
    return select.isolate(p, select.class_select(p, {"sem": [1]})).select("point_id", "visible")


@query(_SHOWN + "SELECT point_id, true AS visible FROM v")
def show_all(spark, d):
    return select.show_all(_shown(spark, d)).select("point_id", "visible")


@query(_SHOWN + "SELECT point_id FROM v WHERE coalesce(visible, true)")
def visible_points(spark, d):
    return select.visible_points(_shown(spark, d)).select("point_id")


@query(_SHOWN + "SELECT count(*) FILTER (coalesce(visible, true)) AS n_visible, count(*) AS n_total, count(*) FILTER (sem = 1) AS n_selected FROM v")
def visible_counts(spark, d):
    p = _shown(spark, d)
    return select.counts(p, select.class_select(p, {"sem": [1]}))


@query(_SHOWN + "SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS position FROM v WHERE coalesce(visible, true)")
def nth_visible(spark, d):
    return select.with_position(select.visible_points(_shown(spark, d))).select("point_id", "position")


@query(f"WITH {L_SQL}, n AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS k FROM points_l) SELECT point_id FROM n WHERE k % 100 = 0")
def coarse_lod(spark, d):
    return select.every_kth(points_l(spark, d).select("point_id"))


@query(f"WITH {E_SQL} SELECT 3 * point_id AS point_id FROM points_e WHERE 3 * point_id NOT IN (SELECT point_id FROM points_e)")
def invalid_selection(spark, d):
    """Three times each id, many of which are no points."""
    p = points_e(spark, d)
    return select.invalid_selection(p, p.select((3 * F.col("point_id")).alias("point_id")))


@query(
    f"""WITH {E_SQL}, k AS (SELECT point_id FROM points_e WHERE point_id % 5 <> 0 UNION ALL SELECT point_id FROM points_e WHERE point_id % 7 = 1 UNION ALL SELECT -1 - point_id FROM points_e WHERE point_id % 100 = 1),
  m AS (SELECT point_id, count(*) AS n FROM k GROUP BY point_id)
SELECT coalesce(p.point_id, m.point_id) AS point_id, CASE WHEN p.point_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'repeated' ELSE 'missing' END AS rule
FROM points_e p FULL JOIN m ON p.point_id = m.point_id WHERE p.point_id IS NULL OR n IS NULL OR n > 1"""
)
def invalid_mask(spark, d):
    """A mask that lacks points, has others twice, and ids that are no points."""
    p = points_e(spark, d).select("point_id", F.lit(True).alias("visible"))
    other = p.where("point_id % 100 = 1").withColumn("point_id", -1 - F.col("point_id"))
    return select.invalid_mask(p, p.where("point_id % 5 <> 0").unionAll(p.where("point_id % 7 = 1")).unionAll(other))


@query(f"WITH {E_SQL} SELECT point_id FROM points_e WHERE x BETWEEN 5 AND 9 AND y BETWEEN 1 AND 6 AND z BETWEEN 2 AND 7")
def bbox_filter(spark, d):
    return select.bbox_filter(points_e(spark, d), (5, 1, 2), (9, 6, 7)).select("point_id")


# ------------------------------------------------------------------------ labels


def _classes(spark, d):
    """Class table of the labels that occur, without id 2."""
    c = schema.schema_from_labels(points_e(spark, d), ["sem"]).where("id <> 2")
    return c.withColumn("color", F.array(F.pmod(F.col("id") * 50 + 60, F.lit(256)), F.pmod(F.col("id") * 90 + 100, F.lit(256)), F.lit(7)).cast("array<int>"))


_CLASSES = """cl AS (SELECT id, CASE WHEN id = -1 THEN '_unlabeled' ELSE concat('class_', id) END AS name, (id * 50 + 60) % 256 AS cr, (id * 90 + 100) % 256 AS cg, 7 AS cb
  FROM (SELECT DISTINCT sem AS id FROM points_e UNION SELECT -1) WHERE id <> 2)"""


@query(f"WITH {E_SQL}, {_CLASSES} SELECT point_id, name AS class_name, coalesce(cr, 204) AS r, coalesce(cg, 204) AS g, coalesce(cb, 204) AS b FROM points_e LEFT JOIN cl ON id = greatest(sem, -1)")
def class_lookup(spark, d):
    return labels.class_lookup(points_e(spark, d), "sem", _classes(spark, d)).select("point_id", "class_name", *(F.get("rgb", F.lit(i)).alias(c) for i, c in enumerate("rgb")))


@query(f"WITH {E_SQL} SELECT point_id, CASE sem WHEN 0 THEN 3 WHEN 3 THEN 0 WHEN 1 THEN 7 ELSE sem END AS sem FROM points_e")
def remap(spark, d):
    return labels.remap(points_e(spark, d), "sem", [(0, 3), (3, 0), (1, 5), (1, 7)]).select("point_id", "sem")


@query(f"WITH {L_SQL} SELECT point_id, CASE CAST(point_id % 10 AS INT) WHEN 0 THEN 9 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 9 THEN 5 ELSE CAST(point_id % 10 AS INT) END AS label FROM points_l")
def remap_large(spark, d):
    """Seven pairs over the large view."""
    p = points_l(spark, d).withColumn("label", (F.col("point_id") % 10).cast("int"))
    return labels.remap(p, "label", [(0, 9), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (9, 5)]).select("point_id", "label")


@query(f"WITH {E_SQL} SELECT point_id, CASE WHEN inst IN (1, 2, 3) THEN inst + 10 ELSE inst END AS inst FROM points_e")
def remap_by_table(spark, d):
    p = points_e(spark, d)
    pairs = p.select(F.col("inst").alias("old"), (F.col("inst") + 10).alias("new"), F.lit(1).alias("seq")).where("old IN (1, 2, 3)").distinct()
    return labels.remap_by(p, "inst", pairs).select("point_id", "inst")


@query(f"WITH {E_SQL}, {_CLASSES} SELECT id, name FROM cl WHERE id IN (SELECT sem FROM points_e)")
def classes_present(spark, d):
    return labels.classes_present(points_e(spark, d), "sem", _classes(spark, d)).select("id", "name")


_COMBOS = "co AS (SELECT sem, inst, count(*) AS n, min(point_id) AS first_id, CAST(row_number() OVER (ORDER BY sem, inst) - 1 AS INT) AS combo_id FROM points_e GROUP BY sem, inst)"


@query(f"WITH {E_SQL}, {_COMBOS} SELECT * FROM co")
def label_combinations(spark, d):
    return labels.label_combinations(points_e(spark, d), ["sem", "inst"])


@query(f"WITH {E_SQL}, {_COMBOS} SELECT point_id, combo_id AS label FROM points_e p JOIN co ON p.sem = co.sem AND p.inst = co.inst")
def flatten_labels(spark, d):
    return labels.flatten_labels(points_e(spark, d), ["sem", "inst"]).select("point_id", "label")


_MEX = "(SELECT CAST(coalesce(min(CASE WHEN v <> r THEN r END), count(*)) AS INT) FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM (SELECT DISTINCT inst AS v FROM points_e WHERE inst >= 0 AND inst <> 4)))"


@query(f"WITH {E_SQL} SELECT {_MEX} AS mex")
def mex(spark, d):
    return labels.mex(points_e(spark, d).where("inst <> 4"), "inst")


@query(f"WITH {E_SQL}, m AS (SELECT max(inst) + 1 AS nxt FROM points_e) SELECT point_id, CASE WHEN sem = 1 THEN 9 ELSE sem END AS sem, CASE WHEN sem = 1 THEN nxt ELSE inst END AS inst FROM points_e, m")
def annotate(spark, d):
    p = points_e(spark, d)
    return labels.annotate(p, select.class_select(p, {"sem": [1]}), "sem", 9, "inst").select("point_id", "sem", "inst")


_LOG = "lg AS (SELECT event_id AS edit_seq, event_id * 7 % (SELECT max(event_id) FROM events) AS point_id, CAST(event_id % 11 AS INT) AS new FROM events)"


@query(f"WITH {E_SQL}, {_LOG}, u AS (SELECT point_id, arg_max(new, edit_seq) AS new FROM lg WHERE edit_seq <= (SELECT max(edit_seq) * 3 // 4 FROM lg) GROUP BY point_id) SELECT p.point_id, coalesce(u.new, p.sem) AS sem FROM points_e p LEFT JOIN u ON u.point_id = p.point_id")
def edit_replay(spark, d):
    """A log over all points, replayed to three quarters of its length."""
    p = points_e(spark, d)
    last = p.agg(F.max("point_id")).first()[0]
    log = p.select(F.col("point_id").alias("edit_seq"), (F.col("point_id") * 7 % last).alias("point_id"), F.lit("sem").alias("field"), (F.col("point_id") % 11).cast("int").alias("new"))
    return labels.replay_edits(p, log, "sem", last * 3 // 4).select("point_id", "sem")


@query(f"WITH {E_SQL} SELECT DISTINCT id FROM (SELECT sem AS id FROM points_e UNION ALL SELECT inst FROM points_e UNION ALL SELECT -1)")
def required_ids(spark, d):
    return labels.required_ids(points_e(spark, d), ["sem", "inst"])


# ----------------------------------------------------------------------- schemas


@query(f"WITH {E_SQL} SELECT id, CASE WHEN id = -1 THEN '_unlabeled' ELSE concat('class_', id) END AS name FROM (SELECT sem AS id FROM points_e UNION SELECT inst FROM points_e UNION SELECT -1)")
def schema_from_labels(spark, d):
    return schema.schema_from_labels(points_e(spark, d), ["sem", "inst"])


@query(f"WITH {E_SQL}, {_CLASSES} SELECT id AS old_id, CASE WHEN id <= 0 THEN -1 ELSE id + 10 END AS new_id FROM cl")
def schema_diff(spark, d):
    """Ids moved by ten, -1 kept: the removed class becomes unlabelled."""
    c = _classes(spark, d)
    edited = c.where("id <> 0").select(F.col("id").alias("original_id"), F.when(F.col("id") >= 0, F.col("id") + 10).otherwise(F.col("id")).alias("id"))
    return schema.schema_diff(c, edited)


@query(f"WITH {E_SQL}, {_CLASSES} SELECT id AS old_id, CAST(CASE WHEN id < 0 THEN id ELSE row_number() OVER (PARTITION BY id < 0 ORDER BY id) - 1 END AS INT) AS new_id, name FROM cl")
def reindex(spark, d):
    return schema.reindex(_classes(spark, d))


@query(f"WITH {E_SQL}, {_CLASSES} SELECT 'gap' AS rule, '2' AS key FROM cl WHERE id = 3 UNION ALL SELECT 'missing', CAST(id AS VARCHAR) FROM (SELECT DISTINCT inst AS id FROM points_e) WHERE id NOT IN (SELECT id FROM cl)")
def schema_violations(spark, d):
    return schema.violations(_classes(spark, d), labels.required_ids(points_e(spark, d), ["inst"]).where("id >= 0"))


def _catalog(spark, d):
    """A catalogue of one field for each instance: the schema of its labels."""
    p = points_e(spark, d).where("sem <> inst % 3")
    c = p.select("inst", F.col("sem").alias("id")).distinct().groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("id", F.concat(F.lit("c"), F.col("id")).alias("name"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("color")))).alias("classes"))
    name = F.concat(F.lit("s"), F.col("inst") % 2)
    key = schema.build_key(F.concat(F.lit("doc"), F.col("inst")), F.lit("PCD_0001"), F.lit("sem"), name)
    return c.select(key.alias("key"), F.concat(F.lit("doc"), F.col("inst")).alias("doc_name"), name.alias("schema_name"), "classes")


_CATALOG = """ct AS (SELECT concat('doc', inst, '/PCD_0001/sem/s', inst % 2) AS key, concat('doc', inst) AS doc_name, concat('s', inst % 2) AS schema_name, string_agg(CAST(sem AS VARCHAR), ',' ORDER BY sem) AS sig
  FROM (SELECT DISTINCT inst, sem FROM points_e WHERE sem <> inst % 3) GROUP BY inst)"""


@query(f"WITH {E_SQL}, {_CATALOG} SELECT min(key) AS key, arg_min(schema_name, key) AS schema_name, count(*) AS n_fields FROM ct GROUP BY sig")
def unique_schemas(spark, d):
    return schema.unique_schemas(_catalog(spark, d))


@query(f"WITH {E_SQL}, {_CATALOG} SELECT key FROM ct WHERE schema_name = 's1' AND sig = (SELECT sig FROM ct WHERE doc_name = 'doc1')")
def matching_schemas(spark, d):
    c = _catalog(spark, d)
    one = c.where("doc_name = 'doc1'").select(F.col("classes").alias("wanted"))
    return schema.matching_fields(c.crossJoin(F.broadcast(one)), "s1", F.col("wanted")).select("key")


# ----------------------------------------------------------------------- colours


@query(
    f"""WITH {E_SQL}, r AS (SELECT min(intensity) AS lo, max(intensity) AS hi FROM points_e), t AS (SELECT point_id, greatest(least((intensity - lo) / (hi - lo), 1.0), 0.0) AS t FROM points_e, r)
SELECT point_id, CAST(trunc(t * 255) AS INT) AS r, CAST(trunc(t * 255) AS INT) AS g, CAST(trunc(t * 255) AS INT) AS b FROM t"""
)
def colorize_scalar(spark, d):
    return _rgb(fields.colorize(points_e(spark, d), "intensity", "INTENSITY"))


def _rgb(df):
    return df.select("point_id", *(F.get("rgb", F.lit(i)).alias(c) for i, c in enumerate("rgb")))


@query(f"WITH {E_SQL}, {_CLASSES} SELECT point_id, coalesce(cr, 204) AS r, coalesce(cg, 204) AS g, coalesce(cb, 204) AS b FROM points_e LEFT JOIN cl ON id = greatest(sem, -1)")
def colorize_semantic(spark, d):
    return _rgb(fields.colorize(points_e(spark, d), "sem", "SEMANTIC", classes=_classes(spark, d)))


@query(
    f"""WITH {E_SQL}, h AS (SELECT point_id, ((CAST(inst AS BIGINT) * 2654435761) & 4294967295) / 4294967296.0 AS h FROM points_e),
  i AS (SELECT point_id, floor(h * 6) AS k, h * 6 - floor(h * 6) AS f FROM h), c AS (SELECT point_id, k, 0.9 AS v, 0.9 * (1 - 0.9) AS p, 0.9 * (1 - CAST(0.9 AS DOUBLE) * f) AS q, 0.9 * (1 - CAST(0.9 AS DOUBLE) * (1 - f)) AS t FROM i)
SELECT point_id, CAST(trunc((CASE k WHEN 0 THEN 0.9 WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE 0.9 END) * 255) AS INT) AS r,
  CAST(trunc((CASE k WHEN 0 THEN t WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 WHEN 3 THEN q WHEN 4 THEN p ELSE p END) * 255) AS INT) AS g,
  CAST(trunc((CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN 0.9 WHEN 4 THEN 0.9 ELSE q END) * 255) AS INT) AS b FROM c"""
)
def colorize_instance(spark, d):
    return _rgb(fields.colorize(points_e(spark, d), "inst", "INSTANCE"))


# the default map: its control points' positions and components, as numbers of SQL
def _steps_sql(points, c: int) -> str:
    num = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    points = sorted(points)
    steps = " ".join(f"WHEN t <= {num(b[0])} THEN {num(a[c])} + (t - {num(a[0])}) * {num((b[c] - a[c]) / (b[0] - a[0]))}" for a, b in zip(points, points[1:], strict=False))
    return f"(CASE {steps} ELSE {num(points[-1][c])} END)"


@query(
    f"WITH {V_SQL}, t AS (SELECT point_id, greatest(least((CAST(vec[2] AS DOUBLE) - -1.0) / (1.0 - -1.0), 1.0), 0.0) AS t FROM points_v) SELECT point_id, "
    + ", ".join(f"CAST(trunc({_steps_sql(COLOR_MAPS['rainbow'][1], i + 1)} * 255) AS INT) AS {c}" for i, c in enumerate("rgb"))
    + " FROM t"
)
def colorize_vector(spark, d):
    return _rgb(fields.colorize(points_v(spark, d), "vec", "VECTOR", lo=-1.0, hi=1.0, index=1))


_HSV = [(1.0, 0.875, 0.5, 1.0), (0.0, 0.0, 1.0, 0.5), (0.5, 0.375, 0.75, 0.75)]


@query(
    f"""WITH {E_SQL}, t AS (SELECT point_id, greatest(least(intensity / CAST(80.0 AS DOUBLE), 1.0), 0.0) AS t FROM points_e), c AS (SELECT point_id, {", ".join(f"{_steps_sql(_HSV, i + 1)} AS {c}" for i, c in enumerate("hsv"))} FROM t),
  k AS (SELECT point_id, floor(h * 6) AS k, h * 6 - floor(h * 6) AS f, s, v FROM c), w AS (SELECT point_id, CAST(k AS INT) % 6 AS k, v, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS u FROM k)
SELECT point_id, CAST(trunc((CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN u ELSE v END) * 255) AS INT) AS r,
  CAST(trunc((CASE k WHEN 0 THEN u WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END) * 255) AS INT) AS g,
  CAST(trunc((CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN u WHEN 3 THEN v WHEN 4 THEN v ELSE q END) * 255) AS INT) AS b FROM w"""
)
def colorize_hsv(spark, d):
    """A map whose control points are hue, saturation and value."""
    c = apply_colormap(F.col("intensity"), "own", 0.0, F.lit(80.0), {"own": ("hsv", _HSV)})
    return _rgb(points_e(spark, d).withColumn("rgb", c))


# ------------------------------------------------------------------ segmentation

EDGE = segment.CELL * 0.05


@query(
    f"""WITH RECURSIVE {V_SQL}, c AS (SELECT point_id, floor(x / {EDGE!r}) AS cx, floor(y / {EDGE!r}) AS cy, floor(z / {EDGE!r}) AS cz FROM points_v), u AS (SELECT DISTINCT cx, cy, cz FROM c),
  adj AS (SELECT a.cx AS ax, a.cy AS ay, a.cz AS az, b.cx AS bx, b.cy AS by_, b.cz AS bz FROM u a JOIN u b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1),
  reach AS (SELECT cx, cy, cz, cx AS rx, cy AS ry, cz AS rz FROM u UNION SELECT reach.cx, reach.cy, reach.cz, bx, by_, bz FROM reach JOIN adj ON rx = ax AND ry = ay AND rz = az)
SELECT c.point_id, min(o.point_id) AS component FROM c JOIN reach ON reach.cx = c.cx AND reach.cy = c.cy AND reach.cz = c.cz JOIN c o ON o.cx = rx AND o.cy = ry AND o.cz = rz GROUP BY c.point_id"""
)
def voxel_components(spark, d):
    return segment.voxel_components(points_v(spark, d), 0.05)


@query(
    f"""WITH {L_SQL}, {_BOX}, r AS (SELECT CAST(floor((x - lx) / ((hx - lx) / 4)) * 3 * 2 + floor((y - ly) / ((hy - ly) / 3)) * 2 + floor((z - lz) / ((hz - lz) / 2)) AS BIGINT) AS chunk_id, point_id % 7 AS region_id FROM points_l, b),
  p AS (SELECT chunk_id, count(DISTINCT region_id) AS n_regions FROM r GROUP BY chunk_id)
SELECT chunk_id, n_regions, CAST(coalesce(sum(n_regions) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS region_offset FROM p"""
)
def region_offsets(spark, d):
    p = grid.chunk_by_number(points_l(spark, d), 4, 3, 2)
    return segment.region_offsets(p.withColumn("region_id", F.col("point_id") % 7))


@query()
def segment_planes(spark, d):
    return growth.segment_planes(points_e(spark, d), epsilon=0.8, min_points=4)


@query()
def segment_chunked(spark, d):
    return growth.segment_chunked(points_e(spark, d), 2, 2, 1, epsilon=0.8, min_points=4)


@query(
    f"""WITH {E_SQL}, rg AS (SELECT point_id, x, y, z, CASE WHEN inst = 0 THEN -1 ELSE sem END AS region_id FROM points_e), i AS (SELECT * FROM rg WHERE region_id >= 0),
  m AS (SELECT region_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM i GROUP BY region_id),
  o AS (SELECT i.region_id, m.n, m.sx, m.sy, m.sz, i.x - round(m.sx / m.n) AS dx, i.y - round(m.sy / m.n) AS dy, i.z - round(m.sz / m.n) AS dz FROM i JOIN m ON i.region_id = m.region_id),
  t AS (SELECT region_id, any_value(n) AS n, any_value(sx) AS sx, any_value(sy) AS sy, any_value(sz) AS sz, sum(dx) AS tx, sum(dy) AS ty, sum(dz) AS tz, sum(dx * dx) AS a1, sum(dx * dy) AS a2, sum(dx * dz) AS a3,
    sum(dy * dy) AS a4, sum(dy * dz) AS a5, sum(dz * dz) AS a6 FROM o GROUP BY region_id),
  s AS (SELECT region_id, n, sx, sy, sz, a1 - tx * tx / n AS xx, a2 - tx * ty / n AS xy, a3 - tx * tz / n AS xz, a4 - ty * ty / n AS yy, a5 - ty * tz / n AS yz, a6 - tz * tz / n AS zz FROM t),
  {_eigen_sql('s')}, {_normal_sql()}, pl AS (SELECT region_id, sx / n AS px, sy / n AS py, sz / n AS pz, ux, uy, uz FROM n7 WHERE ux IS NOT NULL),
  near AS (SELECT g.point_id, any_value(g.x) AS x, any_value(g.y) AS y, any_value(g.z) AS z, i.region_id, min(sqrt((i.x - g.x) * (i.x - g.x) + (i.y - g.y) * (i.y - g.y) + (i.z - g.z) * (i.z - g.z))) AS d
    FROM rg g JOIN i ON i.x BETWEEN g.x - 0.5 AND g.x + 0.5 WHERE g.region_id < 0 AND (i.x - g.x) * (i.x - g.x) + (i.y - g.y) * (i.y - g.y) + (i.z - g.z) * (i.z - g.z) <= 0.25 GROUP BY g.point_id, i.region_id),
  cand AS (SELECT point_id, near.region_id, d, abs((x - px) * ux + (y - py) * uy + (z - pz) * uz) AS plane FROM near JOIN pl ON near.region_id = pl.region_id),
  best AS (SELECT point_id, region_id, row_number() OVER (PARTITION BY point_id ORDER BY d / 0.5 + plane / 1.5, region_id) AS k FROM cand WHERE plane < 1.5)
SELECT rg.point_id, coalesce(best.region_id, rg.region_id) AS region_id FROM rg LEFT JOIN best ON best.point_id = rg.point_id AND k = 1"""
)
def clean_up(spark, d):
    p = points_e(spark, d)
    return segment.clean_up(p, p.select("point_id", F.when(F.col("inst") == 0, -1).otherwise(F.col("sem")).alias("region_id")), 0.5, 3.0)


def _faults(points, regions, planes, epsilon, least):
    """One row: whether there are several regions with points enough for two;
    how many regions are too small, not in one piece, not named by their
    smallest member or of another size than said; how many members lie off
    their plane; and how many points have a row."""
    p = points.select("point_id", *"xyz").join(regions, "point_id")
    inside = p.where("region_id >= 0")
    parts = segment.voxel_components(inside, epsilon, ("region_id",)).groupBy("region_id").agg(F.count_distinct("component").alias("parts"), F.count(F.lit(1)).alias("size"), F.min("point_id").alias("first"))
    said = parts.join(planes.select("region_id", "n"), "region_id", "full")
    off = inside.join(planes, "region_id").where("abs(plane[0] * (x - px) + plane[1] * (y - py) + plane[2] * (z - pz)) > 3.000001 * " + repr(epsilon))
    bad = said.agg(F.count_if(F.col("size") < least).alias("n_small"), F.count_if(F.col("parts") > 1).alias("n_split"), F.count_if(F.col("first") != F.col("region_id")).alias("n_misnamed"), F.count_if(~F.col("n").eqNullSafe(F.col("size"))).alias("n_missized"))
    share = p.agg(F.count(F.lit(1)).alias("n_points"), (F.count_if(F.col("region_id") >= 0) >= 2 * least).alias("enough"), (F.count_distinct(F.expr("IF(region_id >= 0, region_id, NULL)")) > 1).alias("several"))
    return bad.crossJoin(F.broadcast(off.agg(F.count(F.lit(1)).alias("n_off")))).crossJoin(F.broadcast(share))


_FAULTS = f"WITH {E_SQL} SELECT 0 AS n_small, 0 AS n_split, 0 AS n_misnamed, 0 AS n_missized, 0 AS n_off, true AS enough, true AS several, count(*) AS n_points FROM points_e"


@query(_FAULTS)
def segment_planes_faults(spark, d):
    """What every segmentation must hold to, whatever order regions are found in."""
    p = points_e(spark, d)
    return _faults(p, *growth.grow_planes(p, epsilon=0.8, min_points=4), 0.8, 4)


@query(_FAULTS)
def segment_chunked_faults(spark, d):
    p = grid.chunk_by_number(points_e(spark, d), 2, 2, 1)
    regions, planes = growth.grow_planes(p, epsilon=0.8, min_points=4, chunk="chunk_id")
    return _faults(p, regions.drop("chunk_id"), planes, 0.8, 4)


_GRID = ("event_id % 400 % 20 * 0.02D AS u", "event_id % 400 div 20 * 0.02D AS v", "event_id div 400 AS m")
_GRID_SQL = "g AS (SELECT event_id AS point_id, event_id % 400 % 20 AS u, event_id // 400 AS m FROM events)"


def grids(spark, d):
    """The events as points of flat grids of 20 x 20 that stand apart, in three
    directions, with one point far off in each."""
    g = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS point_id", *_GRID, "event_id % 400 = 399 AS away")
    far = "m * 2D + IF(away, 1D, 0D)"
    return g.selectExpr("point_id", f"IF(m % 3 = 2, 0D, u) + {far} AS x", "IF(m % 3 = 2, u, IF(m % 3 = 1, 0D, v)) AS y", "IF(m % 3 = 0, 0D, v) AS z")


@query(f"WITH {_GRID_SQL}, s AS (SELECT m, min(point_id) AS first, count(*) AS n FROM g WHERE point_id % 400 <> 399 GROUP BY m) SELECT point_id, CASE WHEN point_id % 400 <> 399 AND n >= 100 THEN first ELSE -1 END AS region_id FROM g LEFT JOIN s ON g.m = s.m")
def segment_grids(spark, d):
    """Planes known beforehand: each grid is one region, but for its far point."""
    return growth.segment_planes(grids(spark, d), epsilon=0.05, min_points=100)


@query(
    f"""WITH {_GRID_SQL}, c AS (SELECT point_id, 2 * m + (CASE WHEN u >= 10 THEN 1 ELSE 0 END) AS half FROM g WHERE point_id % 400 <> 399),
  s AS (SELECT half, min(point_id) AS first, count(*) AS n FROM c GROUP BY half)
SELECT g.point_id, CASE WHEN n >= 60 THEN first ELSE -1 END AS region_id FROM g LEFT JOIN c ON g.point_id = c.point_id LEFT JOIN s ON c.half = s.half"""
)
def segment_grids_chunked(spark, d):
    """Each grid cut in its middle by a border of chunks: a region on either
    side, with normals from both."""
    p = grids(spark, d).withColumn("chunk_id", F.expr("point_id div 400 * 2 + IF(point_id % 400 % 20 >= 10, 1, 0)"))
    return growth.segment_planes(p, epsilon=0.05, min_points=60, chunk="chunk_id").select("point_id", "region_id")


@query(
    f"""WITH {E_SQL}, pr AS (SELECT least(a.inst, b.inst) AS src, greatest(a.inst, b.inst) AS dst, a.point_id FROM points_e a JOIN points_e b ON b.x BETWEEN a.x - 0.25 AND a.x + 0.25
  WHERE a.inst <> b.inst AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 0.0625)
SELECT src, dst, count(DISTINCT point_id) AS n_boundary, min(point_id) AS first_id FROM pr GROUP BY src, dst"""
)
def region_graph(spark, d):
    p = points_e(spark, d)
    return segment.region_graph(p, p.select("point_id", F.col("inst").alias("region_id")), 0.25)


@query(
    f"""WITH {E_SQL} SELECT DISTINCT least(a.inst, b.inst) AS src, greatest(a.inst, b.inst) AS dst, a.point_id FROM points_e a JOIN points_e b ON b.x BETWEEN a.x - 0.25 AND a.x + 0.25
  WHERE a.inst <> b.inst AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 0.0625"""
)
def region_boundaries(spark, d):
    p = points_e(spark, d)
    return segment.region_boundaries(p, p.select("point_id", F.col("inst").alias("region_id")), 0.25)


@query(f"WITH {L_SQL}, {_BOX} SELECT CAST(floor((x - lx) / ((hx - lx) / 4)) * 3 * 2 + floor((y - ly) / ((hy - ly) / 3)) * 2 + floor((z - lz) / ((hz - lz) / 2)) AS BIGINT) AS chunk_id, point_id % 7 AS region_id, count(*) AS n_members FROM points_l, b GROUP BY 1, 2")
def regions_per_chunk(spark, d):
    p = grid.chunk_by_number(points_l(spark, d), 4, 3, 2)
    return segment.regions_per_chunk(p.withColumn("region_id", F.col("point_id") % 7))


# ------------------------------------------------------------- columns, sources


@query(f"WITH {V_SQL} SELECT point_id, x, y, z, sem, {', '.join(f'vec[{i + 1}] AS vec_{i}' for i in range(64))} FROM points_v")
def wide_record(spark, d):
    return fields.to_wide(points_v(spark, d), {"vec": 64})


@query(
    f"WITH {E_SQL}, {_CLASSES}, o AS (SELECT * FROM points_e LEFT JOIN cl ON id = sem WHERE point_id = 10) SELECT 'coords' AS field, 'X' AS component, printf('%.4f', x) AS value FROM o UNION ALL SELECT 'coords', 'Y', printf('%.4f', y) FROM o "
    "UNION ALL SELECT 'coords', 'Z', printf('%.4f', z) FROM o UNION ALL SELECT 'sem', '', coalesce(concat(name, ' (ID=', sem, ')'), concat('ID=', sem)) FROM o UNION ALL SELECT 'inst', '', CAST(inst AS VARCHAR) FROM o UNION ALL SELECT 'intensity', '', printf('%.4f', intensity) FROM o"
)
def inspect_point(spark, d):
    return fields.inspect_point(points_e(spark, d), 10, {"sem": _classes(spark, d)})


@query(f"WITH {E_SQL} SELECT point_id, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(x AS FLOAT) AS n0, CAST(0 AS FLOAT) AS n1, CAST(z AS FLOAT) AS n2, sem AS label, CAST(intensity AS FLOAT) AS intensity FROM points_e")
def map_fields(spark, d):
    p = points_e(spark, d).select("point_id", F.col("x").alias("PosX"), F.col("y").alias("posy"), F.col("z").alias("PosZ"), F.col("x").alias("nx"), F.col("z").alias("normal_z"), F.col("sem").alias("label"), F.col("intensity").alias("Reflectance"))
    coords, targets = fields.auto_map([c for c in p.columns if c != "point_id"])
    m = fields.map_fields(p, coords, targets)
    return m.select("point_id", "x", "y", "z", *(F.get("normals", F.lit(i)).alias(f"n{i}") for i in range(3)), "label", "intensity")


@query("SELECT event_type AS tool, CAST(event_id AS VARCHAR) AS action, CAST(user_id AS VARCHAR) AS user, epoch_us(ts) AS at_us FROM events")
def tool_log(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    line = F.to_json(F.struct(F.col("event_type").alias("tool"), F.col("event_id").cast("string").alias("action"), F.col("user_id").cast("string").alias("user"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")))
    log = toollog.parse_tool_log(ev.select(line.alias("entry")))
    return log.select("tool", "action", "user", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', at)").alias("at_us"))


@query(f"WITH {E_SQL}, {_CATALOG} SELECT point_id, CASE WHEN sem = 0 THEN 5 ELSE sem END AS sem FROM points_e WHERE concat('doc', inst) IN (SELECT doc_name FROM ct WHERE schema_name = 's1' AND sig = (SELECT sig FROM ct WHERE doc_name = 'doc1'))")
def update_schema(spark, d):
    p = points_e(spark, d).withColumn("doc_name", F.concat(F.lit("doc"), F.col("inst")))
    c = _catalog(spark, d)
    one = c.where("doc_name = 'doc1'").select(F.col("classes").alias("wanted"))
    pairs = p.select(F.lit(0).alias("old"), F.lit(5).alias("new"), F.lit(1).alias("seq")).limit(1)
    return schema.update_schema(p, c.crossJoin(F.broadcast(one)), "s1", F.col("wanted"), pairs, "sem").select("point_id", "sem")


@query(f"WITH {E_SQL} SELECT concat('a/scan_', inst, '.ply') AS path, concat('scan_', inst, CASE WHEN inst IN (1, 3, 5) THEN '_000' ELSE '' END) AS doc_name FROM points_e GROUP BY inst")
def document_names(spark, d):
    """Names for one file an instance, beside documents that exist for odd ones."""
    p = points_e(spark, d).select("inst").distinct()
    known = p.where("inst IN (1, 3, 5)").select(F.concat(F.lit("scan_"), F.col("inst")).alias("doc_name"))
    return documents.unique_names(p.select(F.concat(F.lit("a/scan_"), F.col("inst"), F.lit(".ply")).alias("path")), known)


@query(f"WITH {E_SQL} SELECT min(intensity) AS lo, max(intensity) AS hi FROM points_e WHERE inst <> 3")
def scalar_range(spark, d):
    return grid.scalar_range(points_e(spark, d).withColumn("visible", F.col("inst") != 3), "intensity")


@query(f"WITH {E_SQL} SELECT point_id, CAST(CASE WHEN sem < 0 THEN 0 ELSE sem * 10 END AS INT) AS r, 200 AS g, 3 AS b FROM points_e")
def colorize_color(spark, d):
    c = F.array(F.greatest(F.col("sem") * 10.0, F.lit(0.0)), F.lit(200.0), F.lit(3.0))
    return _rgb(fields.colorize(points_e(spark, d).withColumn("c", c), "c", "COLOR"))


@query(f"WITH {E_SQL} SELECT concat('scan_', inst) AS doc_name, 'PCD_0001' AS cloud_id, point_id, x, y, z, sem, intensity FROM points_e")
def document_catalog(spark, d):
    """Write one document an instance, list them and read them back."""
    root = work_dir(spark)
    p = points_e(spark, d).withColumns({"doc_name": F.concat(F.lit("scan_"), F.col("inst")), "cloud_id": F.lit("PCD_0001")})
    documents.write_documents(p, root)
    listed = documents.list_documents(spark, root).select("doc_name")
    return documents.read_documents(spark, root).join(listed, "doc_name", "left_semi").select("doc_name", "cloud_id", "point_id", "x", "y", "z", "sem", "intensity")


from . import table_queries, value_queries  # noqa: E402, F401  (they register theirs)
