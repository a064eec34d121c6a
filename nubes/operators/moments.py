"""Neighbourhood sums without pairs where points are crowded.

Cells of edge r with more than CROWDED points, and their neighbours, are not
joined point by point. Pairs of such cells are refined together, from level to
level with half the edge: a pair that lies wholly within r adds the one cell's
count, sums and products to all points of the other as one row; a pair wholly
beyond r is dropped; a pair at the border is joined point by point once the
product of its counts is LEAF or less, and split into the pairs of its children
otherwise. So a crowded cell meets itself and its surroundings as moments, and
what is joined point by point is bounded for each pair of cells, however many
points there are. All other points take the plain join.

Moments are taken about the least coordinates of a cell, so they are whole
numbers where coordinates are; with the same points the sums equal those of the
pairs. Points are positions with a weight ``w``, the number of points there.
DEPTH bounds the levels: cells of 1 / 4096 of r that still lie at the
border are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise

CROWDED, LEAF, DEPTH, SALT = 128, 2048, 12, 16
AXES, SIX = ("x", "y", "z"), ("xx", "xy", "xz", "yy", "yz", "zz")
Q, D = [f"q{c}" for c in AXES], [f"d{c}" for c in AXES]


def _cells(df: DataFrame, keys: list[str], edge: float, level: int, *more: str, names: list[str]) -> DataFrame:
    """Points with their cell of a level; twice a quotient is exact, so a cell's
    children are those whose numbers halve to its own."""
    return df.selectExpr(*keys, "point_id", *AXES, *more, *(f"floor({c} / {edge!r}D * {2**level}) AS {n}" for c, n in zip(AXES, names, strict=True)))


def _moments(points: DataFrame, by: list[str]) -> DataFrame:
    """Count, least coordinates, and sums and products about these, of each cell."""
    low = points.groupBy(*by).agg(*(F.min(c).alias("o" + c) for c in AXES))
    off = points.join(low, by).selectExpr(*by, "w", *(f"o{c}" for c in AXES), *(f"{c} - o{c} AS e{c}" for c in AXES))
    return off.groupBy(*by, *("o" + c for c in AXES)).agg(F.sum("w").alias("nd"), *(F.expr(f"sum(e{c} * w)").alias("s" + c) for c in AXES), *(F.expr(f"sum(e{p[0]} * e{p[1]} * w)").alias(p) for p in SIX))


def crowded_cells(query: DataFrame, points: DataFrame, keys: list[str], edge: float) -> DataFrame:
    """The cells (keys, cx, cy, cz) that hold more than CROWDED query points or
    points, with the larger number of the two (``places``)."""
    cell = [f"c{c}" for c in AXES]
    sides = [query] if query is points else [query, points]
    many = [_cells(s, keys, edge, 0, names=cell).groupBy(*keys, *cell).count().where(F.col("count") > CROWDED) for s in sides]
    return reduce(DataFrame.unionByName, many).groupBy(*keys, *cell).agg(F.max("count").alias("places"))


def crowded_sums(query: DataFrame, points: DataFrame, dense: DataFrame, r: float, edge: float, keys: list[str]) -> DataFrame:
    """``q_id`` (and keys) with ``n`` and the six sums over the neighbours in
    pairs of cells of which one is crowded; a point may have several rows."""
    near = dense.selectExpr(*keys, "cx", "cy", "cz", "explode(sequence(-1, 1)) AS i").selectExpr("*", "explode(sequence(-1, 1)) AS j").selectExpr("*", "explode(sequence(-1, 1)) AS k")
    own, other = ["cx", "cy", "cz"], ["cx + i", "cy + j", "cz + k"]
    pairs = [near.selectExpr(*keys, *(f"{a} AS {n}" for a, n in zip(x + y, Q + D, strict=True))) for x, y in ((own, other), (other, own))]
    first = materialise(pairs[0].unionByName(pairs[1]).distinct())
    q = materialise(_cells(query, keys, edge, 0, names=Q).join(first.select(*keys, *Q).distinct(), [*keys, *Q], "left_semi").select(*keys, "point_id", *AXES))
    d = materialise(_cells(points, keys, edge, 0, "w", names=D).join(first.select(*keys, *D).distinct(), [*keys, *D], "left_semi").select(*keys, "point_id", "w", *AXES))
    parts, level, open_pairs = [], 0, first
    while True:
        h2 = (edge / 2**level) ** 2
        at_q, at_d = _cells(q, keys, edge, level, names=Q), _cells(d, keys, edge, level, "w", names=D)
        counted = open_pairs.join(at_q.groupBy(*keys, *Q).agg(F.count(F.lit(1)).alias("nq")), [*keys, *Q]).join(at_d.groupBy(*keys, *D).agg(F.count(F.lit(1)).alias("nd")), [*keys, *D])
        apart = [f"abs({a} - {b})" for a, b in zip(Q, D, strict=True)]
        within = " + ".join(f"({a} + 1) * ({a} + 1)" for a in apart) + f" <= {r * r * (1 - 1e-9) / h2!r}D"
        beyond = " + ".join(f"greatest({a} - 1, 0) * greatest({a} - 1, 0)" for a in apart) + f" > {r * r * (1 + 1e-9) / h2!r}D"
        kind = f"CASE WHEN {within} THEN 'in' WHEN nq * nd <= {LEAF} OR {level} >= {DEPTH} THEN 'join' ELSE 'split' END"
        table = materialise(counted.where(f"NOT ({beyond})").selectExpr(*keys, *Q, *D, f"{kind} AS kind"))
        kinds = {x["kind"] for x in table.select("kind").distinct().collect()}
        if "in" in kinds:
            parts.append(_from_moments(table.where("kind = 'in'").drop("kind"), at_q, at_d, keys))
        if "join" in kinds:
            both = table.where("kind = 'join'").drop("kind").join(at_q.withColumnsRenamed({c: "u" + c for c in AXES} | {"point_id": "q_id"}), [*keys, *Q]).join(at_d.drop("point_id"), [*keys, *D])
            off = {p: f"({p} - u{p})" for p in AXES}
            near = both.where(" + ".join(f"{x} * {x}" for x in off.values()) + f" <= {r * r!r}D")
            parts.append(near.selectExpr(*keys, "q_id", "w AS n", *(f"{off[p[0]]} * {off[p[1]]} * w AS {p}" for p in SIX)))
        if "split" not in kinds:
            break
        down = table.where("kind = 'split'").drop("kind")
        for side, names in ((q, Q), (d, D)):  # pairs of a cell to pairs of its children
            kids = _cells(side, keys, edge, level + 1, names=["k" + n for n in names]).select(*keys, *("k" + n for n in names)).distinct()
            kids = kids.selectExpr("*", *(f"shiftright(k{n}, 1) AS {n}" for n in names))
            rest = [c for c in down.columns if c not in names]
            down = down.join(kids, [*keys, *names]).selectExpr(*rest, *(f"k{n} AS {n}" for n in names))
        open_pairs, level = down.select(*keys, *Q, *D), level + 1
    if not parts:
        parts = [q.limit(0).selectExpr(*keys, "point_id AS q_id", "0L AS n", *(f"0D AS {p}" for p in SIX))]
    return reduce(DataFrame.unionByName, parts)


def _from_moments(pairs: DataFrame, at_q: DataFrame, at_d: DataFrame, keys: list[str]) -> DataFrame:
    """What the cells in ``pairs`` add to each point of the other side: moments
    are moved to the least coordinates of the query's cell and added up there,
    then moved to each point. Points of one cell meet its row in SALT places."""
    low = at_q.groupBy(*keys, *Q).agg(*(F.min(c).alias("r" + c) for c in AXES))
    both = pairs.join(_moments(at_d, [*keys, *D]), [*keys, *D]).join(low, [*keys, *Q])
    t = {c: f"(o{c} - r{c})" for c in AXES}
    sums = [F.sum("nd").alias("m"), *(F.expr(f"sum(s{c} + nd * {t[c]})").alias("m" + c) for c in AXES)]
    sums += [F.expr(f"sum({p} + s{p[0]} * {t[p[1]]} + s{p[1]} * {t[p[0]]} + nd * {t[p[0]]} * {t[p[1]]})").alias("m" + p) for p in SIX]
    one = both.groupBy(*keys, *Q, *("r" + c for c in AXES)).agg(*sums).selectExpr("*", f"explode(sequence(0, {SALT - 1})) AS salt")
    each = at_q.selectExpr("*", f"CAST(pmod(xxhash64(point_id), {SALT}) AS int) AS salt").join(one, [*keys, *Q, "salt"])
    u = {c: f"({c} - r{c})" for c in AXES}
    return each.selectExpr(*keys, "point_id AS q_id", "m AS n", *(f"m{p} - {u[p[0]]} * m{p[1]} - {u[p[1]]} * m{p[0]} + m * {u[p[0]]} * {u[p[1]]} AS {p}" for p in SIX))
