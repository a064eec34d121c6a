"""Plane segments by seeded region growing, block by block.

A round cuts space into blocks of at most BLOCK places (cubes whose edge halves
until they hold no more, slices where even the smallest cube holds more), which
Spark deals to its tasks. In a block regions grow one after another, as the
search does that this re-expresses: from the flattest points, the front moves by
one radius a step, planes are fitted again when a region's size passes limits
that multiply, members that no longer fit are given back, and regions that stay
too small are given up, unless they lie at the block's rim. Regions that touch
and lie in one plane, within a block or across blocks, are then put together from
their moments alone, so a round is a fixed number of Spark jobs and some for each
doubling of what is put together, whatever the size of planes. What holds of a
region after that (members on its plane, in one piece, enough of them) is kept,
the rest goes back. The next round cuts elsewhere; what grows there is put
together with the regions kept before. Rounds end when nothing is left, when the
latest attempts succeed too rarely, or when a round finds nothing.

Points at one place with one normal grow as one, weighted by their number.
Nothing is collected but the outcome of the latest attempts and counts.
"""

from __future__ import annotations

import itertools
import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import SMALL, discard, few, materialise, sized
from .grid import chunk_by_number
from .neighbors import eigen_features, position_sums, positions
from .segment import CELL, HALF_OFFSETS, region_offsets, voxel_components

ID, AXES = "point_id", ("x", "y", "z")
PLANE = ("px", "py", "pz", "plane")
SIX = ("xx", "xy", "xz", "yy", "yz", "zz")
LEAST_SPACING = 2.0
BLOCK, LEVELS = 2048, 10  # places in a block, and doublings from the smallest cube's edge, epsilon


class Fit:
    """When a point, or another plane's centre, fits a plane: SQL conditions.
    ``at`` and ``p`` are the prefixes of the coordinates and of the plane's
    centre, ``normal`` and ``plane`` name the two normals."""

    def __init__(self, epsilon: float, k: float, alpha: float, max_dist: float, oriented: bool):
        self.far, self.cos, self.max_dist, self.oriented = float(k * epsilon), math.cos(alpha), float(max_dist), oriented

    def on(self, at: np.ndarray, normal: np.ndarray, centre: np.ndarray, plane: np.ndarray) -> np.ndarray:
        """``holds`` for rows of a block."""
        off, tilt = at - centre, normal @ plane
        like = tilt if self.oriented else np.abs(tilt)
        return (np.abs(off @ plane) <= self.far) & (like > self.cos + (1 - self.cos) * np.sqrt((off * off).sum(axis=1)) / self.max_dist)

    def distance(self, at: str = "", plane: str = "plane", p: str = "p") -> str:
        return "abs(" + " + ".join(f"{plane}[{i}] * ({at}{c} - {p}{c})" for i, c in enumerate(AXES)) + ")"

    def tilt(self, normal: str, plane: str = "plane") -> str:
        dot = dot_sql(normal, plane)
        return dot if self.oriented else f"abs({dot})"

    def like(self, at: str = "", normal: str = "normal", plane: str = "plane", p: str = "p") -> str:
        """Normals agree, the less leeway the farther from the centre."""
        away = "sqrt(" + " + ".join(f"({at}{c} - {p}{c}) * ({at}{c} - {p}{c})" for c in AXES) + ")"
        return f"{self.tilt(normal, plane)} > {self.cos!r}D + {1 - self.cos!r}D * {away} / {self.max_dist!r}D"

    def holds(self, at: str = "", normal: str = "normal", plane: str = "plane", p: str = "p") -> str:
        return f"({self.distance(at, plane, p)} <= {self.far!r}D AND {self.like(at, normal, plane, p)})"


def dot_sql(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(3)) + ")"


def towards_sql(normal: str, old: str) -> str:
    """The normal, turned to the side of the old one."""
    return f"CASE WHEN {dot_sql(normal, old)} < 0 THEN transform({normal}, v -> -v) ELSE {normal} END"


def blocks(free: DataFrame, epsilon: float, keys: list[str], number: int) -> DataFrame:
    """``free`` with its block (``level, bx, by, bz, part``), and whether a point
    lies within epsilon of other blocks (``rim``). From one number to the next
    borders move by a third of the largest edge, which is a third or two of any
    edge."""
    at = {c: f"({c} / {float(epsilon)!r}D + {(number - 1) * 2.0**LEVELS / 3!r}D)" for c in AXES}
    cell, block = [*keys, "cx", "cy", "cz"], [*keys, "level", "bx", "by", "bz"]
    placed = free.selectExpr("*", *(f"floor({at[c]}) AS c{c}" for c in AXES))
    cells = sized(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")))
    up = cells.selectExpr("*", f"explode(sequence(0, {LEVELS})) AS level").selectExpr("*", *(f"shiftright(c{c}, level) AS b{c}" for c in AXES))
    small = up.groupBy(*block).agg(F.sum("n").alias("total")).where(F.col("total") <= BLOCK)
    level = up.join(small, block, "left_semi").groupBy(*cell).agg(F.max("level").alias("_level"))
    own = cells.join(level, cell, "left").selectExpr(*(f"`{c}`" for c in cell), "coalesce(_level, 0) AS level", f"IF(_level IS NULL, ceil(n / {BLOCK}), 1) AS parts")
    named = placed.join(F.broadcast(own) if cells._rows <= SMALL else own, cell).selectExpr("*", *(f"shiftright(c{c}, level) AS b{c}" for c in AXES), f"pmod(xxhash64({ID}), parts) AS part")
    rim = " OR ".join(f"{at[c]} - b{c} * pow(2, level) < 1 OR (b{c} + 1) * pow(2, level) - {at[c]} < 1" for c in AXES)
    return named.selectExpr(*(f"`{c}`" for c in free.columns), "level", "bx", "by", "bz", "part", f"(parts > 1 OR {rim}) AS rim")


def grow_one(seed: int, near: np.ndarray, free: np.ndarray, at: np.ndarray, normal: np.ndarray, w: np.ndarray, fit: Fit, first_refit: float, multiplier: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The members of the region grown from a seed, its centre and plane."""
    centre, plane, limit = at[seed], normal[seed], float(first_refit)
    member = np.zeros(len(at), bool)
    member[seed] = True
    front = np.array([seed])
    while len(front):
        new = np.flatnonzero(near[front].any(axis=0) & free & ~member)
        front = new[fit.on(at[new], normal[new], centre, plane)]
        member[front] = True
        inside = np.flatnonzero(member)
        n = w[inside].sum()
        if n < limit:
            continue
        limit *= multiplier
        share = (w[inside] / n)[:, None]
        middle = centre + (share * (at[inside] - centre)).sum(axis=0)
        off = at[inside] - middle
        values, vectors = np.linalg.eigh((off * share).T @ off)
        if values[1] - values[0] > 1e-6 * values[2]:
            centre, plane = middle, vectors[:, 0] * (-1.0 if vectors[:, 0] @ plane < 0 else 1.0)
            member[inside[~fit.on(at[inside], normal[inside], centre, plane)]] = False
            front = front[member[front]]
    return np.flatnonzero(member), centre, plane


def grow_block(b: pd.DataFrame, epsilon: float, fit: Fit, first_refit: float, multiplier: float, min_points: int, spacing: float, tracker_size: int, ratio: float) -> pd.DataFrame:
    """A block's rows with the region they are in, named by its smallest member,
    its plane, and how many attempts failed that they were the seed of. Seeds
    are the points tried least, then flattest, of cubes of edge ``spacing``,
    which halves from pass to pass."""
    b = b.sort_values(ID, ignore_index=True)
    at, normal = b[list(AXES)].to_numpy(float), np.stack(b["normal"].to_numpy()).astype(float)
    w, flat, rim = b["w"].to_numpy(float), b["flat"].to_numpy(float), b["rim"].to_numpy(bool)
    near = sum((a[:, None] - a[None, :]) ** 2 for a in at.T) <= epsilon * epsilon
    region, failed, planes = np.full(len(b), -1), np.zeros(len(b), np.int64), np.zeros((len(b), 6))
    tracker, found = deque([True] * tracker_size, tracker_size), True
    while found or spacing > LEAST_SPACING:
        spacing, found = spacing if found else LEAST_SPACING, False
        left = np.flatnonzero(region < 0)
        left = left[np.lexsort((flat[left], b["tries"].to_numpy()[left] + failed[left]))]
        seeds = left[np.sort(np.unique(np.floor(at[left] / (spacing * epsilon)), axis=0, return_index=True)[1])]
        for s in seeds[region[seeds] < 0]:
            if region[s] >= 0:
                continue
            if sum(tracker) < ratio * tracker_size:
                break
            inside, centre, plane = grow_one(s, near, region < 0, at, normal, w, fit, first_refit, multiplier)
            enough = w[inside].sum() >= min_points
            if enough or not rim[inside].any():
                tracker.append(enough)
            if enough or rim[inside].any():
                region[inside], planes[inside], found = inside[0], [*centre, *plane], True
            else:
                failed[s] += 1
        if sum(tracker) < ratio * tracker_size:
            break
        if found:
            spacing = max(LEAST_SPACING, spacing / 2)
    ids = b[ID].to_numpy()
    out = b.drop(columns=["level", "bx", "by", "bz", "part", "rim"])
    out["region"] = pd.array(np.where(region < 0, 0, ids[region]), "Int64")
    out.loc[region < 0, "region"] = pd.NA
    return out.assign(failed=failed, px=planes[:, 0], py=planes[:, 1], pz=planes[:, 2], plane=list(planes[:, 3:]))


def grow(free: DataFrame, number: int, epsilon: float, fit: Fit, keys: list[str], *how: float) -> DataFrame:
    """Written: the points with the region they are grown into in the round's
    blocks, and the regions' planes."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in free.schema.fields)
    run = lambda b: grow_block(b, epsilon, fit, *how)
    out = blocks(free, epsilon, keys, number).groupBy(*keys, "level", "bx", "by", "bz", "part").applyInPandas(run, f"{kinds}, region long, failed long, px double, py double, pz double, plane array<double>")
    return sized(out)


def _moments(members: DataFrame, regions: DataFrame) -> DataFrame:
    """``region, n``, the centroid and the scatter about it, summed about the
    regions' present centres so that large coordinates lose no digits."""
    off = members.join(few(regions).select("region", "px", "py", "pz"), "region").selectExpr("region", "w", *(f"{c} - p{c} AS d{c}" for c in AXES))
    sums = off.groupBy("region").agg(F.sum("w").alias("n"), *(F.expr(f"sum(w * d{c}) AS t{c}") for c in AXES), *(F.expr(f"sum(w * d{p[0]} * d{p[1]}) AS {p}") for p in SIX))
    return sums.selectExpr("region", "n", *(f"t{c} / n AS t{c}" for c in AXES), *(f"{p} - t{p[0]} * t{p[1]} / n AS {p}" for p in SIX))


def _touching(members: DataFrame, epsilon: float, keys: list[str]) -> DataFrame:
    """``a, b``: regions with members in one cell, or in cells that share a
    face, an edge or a corner."""
    cells = members.select(*keys, "region", *(F.floor(F.col(c) / (CELL * epsilon)).alias("c" + c) for c in AXES)).distinct()
    offs = F.explode(F.array(*[F.struct(*(F.lit(v).cast("long").alias(n) for v, n in zip(o, "ijk", strict=True))) for o in [(0, 0, 0), *HALF_OFFSETS]]))
    moved = cells.select(*keys, F.col("region").alias("r"), "cx", "cy", "cz", offs.alias("o"))
    moved = moved.select(*keys, "r", *((F.col("c" + c) + F.col("o." + k)).alias("c" + c) for c, k in zip(AXES, "ijk", strict=True)))
    both = moved.join(cells, [*keys, "cx", "cy", "cz"]).where("r <> region")
    return both.select(F.least("r", "region").alias("a"), F.greatest("r", "region").alias("b")).distinct()


def merge(members: DataFrame, regions: DataFrame, epsilon: float, fit: Fit, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Written tables ``region, label`` and the labels' planes (``label, n``,
    plane): touching regions put together, each with its best partner if that
    one is larger and joins no other itself, while their centres lie in each
    other's planes, normals agree and the common plane stays as thin as a slab of
    the allowed distance. Works on the regions' moments; points are read once."""
    kept = [f"{p} AS k{p}" for p in SIX]
    sums = eigen_features(_moments(members, regions).selectExpr("*", *kept), normals=True, eigenvals=False)
    plane = f"CASE WHEN n > 3 AND normal IS NOT NULL THEN {towards_sql('normal', 'plane')} ELSE plane END AS plane"
    new = few(regions).select("region", *PLANE).join(sums, "region").selectExpr("region AS label", "n", *(f"p{c} + t{c} AS p{c}" for c in AXES), plane, *(f"k{p} AS {p}" for p in SIX))
    table = sized(new)
    names, steps = table.selectExpr("label AS region"), []
    first = table
    edges = sized(_touching(members, epsilon, keys))
    apart = f"greatest({fit.distance('b_p', 'a_plane', 'a_p')}, {fit.distance('a_p', 'b_plane', 'b_p')})"
    like = f"{fit.like('b_p', 'b_plane', 'a_plane', 'a_p')} AND {fit.like('a_p', 'a_plane', 'b_plane', 'b_p')}"
    cost = f"struct({apart} / {fit.far!r}D + 1 - abs({dot_sql('a_plane', 'b_plane')}) AS c, a, b) AS cost"
    while True:
        a, b = (few(table).toDF(*(p + c for c in table.columns)) for p in ("a_", "b_"))
        both = edges.join(a, F.col("a") == F.col("a_label")).join(b, F.col("b") == F.col("b_label")).where(f"{apart} <= {fit.far!r}D AND {like}")
        thin = eigen_features(_joint(both, "a", "b", cost, "a_n", "b_n"), normals=False, eigenvals=True).where(f"eigenvalues[0] <= n * {fit.far**2 / 3!r}D")
        best = thin.selectExpr("inline(array(struct(a AS r, b AS other, cost, a_n AS rn, b_n AS other_n), struct(b AS r, a AS other, cost, b_n AS rn, a_n AS other_n)))").groupBy("r").agg(F.expr("min_by(struct(other, rn, other_n), cost) AS best"))
        go = sized(best.selectExpr("r AS gone", "best.*").where("rn < other_n OR (rn = other_n AND gone > other)").selectExpr("gone", "other AS keep"))
        pairs = sized(go.join(few(go).selectExpr("gone AS keep"), "keep", "left_anti").select("gone", "keep"))
        discard(go)
        if not pairs._rows:
            discard(edges, pairs)
            break
        steps.append(pairs)
        two = few(pairs).join(b, F.col("gone") == F.col("b_label")).join(a, F.col("keep") == F.col("a_label"))
        two = eigen_features(_gathered(two).selectExpr("*", *kept), normals=True, eigenvals=False)
        joined = two.selectExpr("keep AS label", "n", *("p" + c for c in AXES), f"coalesce({towards_sql('normal', 'a_plane')}, a_plane) AS plane", *(f"k{p} AS {p}" for p in SIX))
        alone = table.join(few(pairs).selectExpr("explode(array(keep, gone)) AS label"), "label", "left_anti")
        later = sized(alone.unionByName(joined)), sized(_renamed(_renamed(edges, "a", pairs), "b", pairs).where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
        discard(edges, None if table is first else table)
        table, edges = later
    # what has joined another joins nothing later: a forest, as deep as there were steps
    up = table.limit(0).selectExpr("label AS gone", "label AS keep")
    for pairs in steps:
        up = up.unionAll(pairs)
    for _ in range(max(len(steps) - 1, 0).bit_length()):
        old, up = up, sized(up.join(up.selectExpr("gone AS keep", "keep AS top"), "keep", "left").selectExpr("gone", "coalesce(top, keep) AS keep"))
        discard(old)
    labels = sized(names.join(up.selectExpr("gone AS region", "keep"), "region", "left").selectExpr("region", "coalesce(keep, region) AS label"))
    discard(up, *steps, None if table is first else first)
    return labels, table


def _renamed(df: DataFrame, c: str, pairs: DataFrame) -> DataFrame:
    """``df`` with ``keep`` for ``gone`` in column ``c``."""
    rest = [x for x in df.columns if x != c]
    return df.join(few(pairs), F.col(c) == F.col("gone"), "left").selectExpr(*rest, f"coalesce(keep, {c}) AS {c}")


def _gathered(pairs: DataFrame) -> DataFrame:
    """``keep, a_plane``, and size, centre and scatter of each region a with all
    regions b that join it."""
    off = {c: f"(b_p{c} - a_p{c})" for c in AXES}
    sums = pairs.groupBy("keep").agg(F.first("a_n").alias("a_n"), F.first("a_plane").alias("a_plane"), F.sum("b_n").alias("m"), *(F.first("a_p" + c).alias("a_p" + c) for c in AXES), *(F.expr(f"sum(b_n * {off[c]}) AS t{c}") for c in AXES), *(F.expr(f"first(a_{p}) + sum(b_{p} + b_n * {off[p[0]]} * {off[p[1]]}) AS {p}") for p in SIX))
    return sums.selectExpr("keep", "a_plane", "a_n + m AS n", *(f"a_p{c} + t{c} / (a_n + m) AS p{c}" for c in AXES), *(f"{p} - t{p[0]} * t{p[1]} / (a_n + m) AS {p}" for p in SIX))


def _joint(both: DataFrame, *keep: str) -> DataFrame:
    """``keep``, and size, centre and scatter of two regions together."""
    off = {c: f"(b_p{c} - a_p{c})" for c in AXES}
    second = [f"a_{p} + b_{p} + a_n * b_n / (a_n + b_n) * {off[p[0]]} * {off[p[1]]} AS {p}" for p in SIX]
    return both.selectExpr(*keep, "a_n + b_n AS n", *(f"a_p{c} + {off[c]} * b_n / (a_n + b_n) AS p{c}" for c in AXES), *second)


def grow_planes(points: DataFrame, epsilon: float = 0.03, k: float = 3.0, alpha: float = 0.15 * math.pi, max_dist: float = 50.0, min_points: int = 80, perform_cca: bool = True, oriented: bool = False, first_refit: int = 4, refit_multiplier: float = 2.0, tracker_size: int = 50, min_success_ratio: float = 0.1, seed_spacing: float = 8.0, max_rounds: int | None = None, chunk: str | None = None, normal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``point_id, region_id`` (and the chunk) of all points, the region named by
    its smallest member or -1; and the regions: ``region_id, n``, and the plane
    that all members lie on (``px, py, pz, plane``).

    A point joins a region within ``epsilon`` of a member if it lies ``k *
    epsilon`` from the plane at most and its normal agrees within ``alpha``,
    less far from the centre (``max_dist``). Planes are fitted at ``first_refit``
    members and each time the size has multiplied. ``tracker_size`` attempts,
    all counted as successes before the first, must succeed with a share of
    ``min_success_ratio``: a seed succeeds if ``min_points`` points or more that
    had no region are kept with it. ``seed_spacing`` is in multiples of epsilon. With
    ``chunk`` regions stay in a chunk, while neighbours of all chunks make the
    normals. ``normal`` names a column of given normals, which ``oriented``
    growth needs to tell sides apart. Points without normal stay at -1, and so
    do all points if there is none, or no region."""
    keys = [chunk] if chunk else []
    fit = Fit(epsilon, k, alpha, max_dist, oriented)
    base = points.select(ID, *AXES, *keys, *([F.col(normal).cast("array<double>").alias("normal")] if normal else []))
    # places stand for their points, which are read again to be told their region
    place, cols = [*keys, *AXES, *(["normal"] if normal else [])], [ID, *keys, *AXES, "normal", "w"]
    places = materialise(base.groupBy(*place).agg(F.min(ID).alias(ID), F.count(F.lit(1)).alias("w")))
    at = places if place == list(AXES) else materialise(positions(base))
    shape = eigen_features(position_sums(at, at, epsilon), normals=True, eigenvals=True)
    shape = shape.select(F.col("q_id").alias(ID), F.coalesce("sphericity", F.lit(1.0)).alias("flat"), *([] if normal else ["normal"]))
    shape = places.join(shape, ID) if at is places else places.join(at.select(ID, *AXES).join(shape, ID).drop(ID), list(AXES))
    whole = free = sized(shape.where("normal IS NOT NULL").select(*cols, "flat", F.lit(0).cast("long").alias("tries")))
    tracker, spacing = deque([True] * tracker_size, tracker_size), max(seed_spacing, LEAST_SPACING)
    held = planes_held = None
    for number in itertools.count(1):
        if not free._rows:
            break
        grown = grow(free, number, epsilon, fit, keys, first_refit, refit_multiplier, min_points, spacing, tracker_size, min_success_ratio)
        members = grown.where("region IS NOT NULL")
        parts, fits = members.selectExpr(*cols, "region", "true AS new"), members.groupBy("region").agg(*(F.first(c).alias(c) for c in PLANE))
        if held is not None:
            parts = parts.unionByName(held.selectExpr(*cols, "region_id AS region", "false AS new"))
            fits = fits.unionByName(planes_held.selectExpr("region_id AS region", *PLANE))
        fits = sized(fits)
        labels, planes = merge(parts, fits, epsilon, fit, keys)
        own = sized(parts.join(few(labels), "region").join(few(planes).select("label", *PLANE), "label").where(fit.holds()).select(*cols, "new", "label"))
        if perform_cca:
            named = voxel_components(own, epsilon, ("label",)).select(ID, "label", F.col("component").alias("region_id"))
        else:
            named = own.join(own.groupBy("label").agg(F.min(ID).alias("region_id")), "label").select(ID, "label", "region_id")
        named = sized(own.drop("label").join(named, ID))
        found = named.groupBy("label", "region_id").agg(F.sum("w").alias("n"), F.sum(F.expr("IF(new, w, 0)")).alias("gain")).where(F.col("n") >= min_points)
        found = sized(found.join(few(planes).select("label", *PLANE), "label"))
        kept = sized(named.join(few(found).select("label", "region_id"), ["label", "region_id"], "left_semi").select(*cols, "region_id"))
        gain = found.groupBy("label").agg((F.sum("gain") >= min_points).alias("good"))
        tries = labels.join(members.select("region").distinct(), "region", "left_semi").select("label").distinct().join(gain, "label", "left")
        tries = tries.select("label", F.coalesce("good", F.lit(False)).alias("good")).unionAll(grown.where("failed > 0").select(ID, F.lit(False)))
        last = [r["good"] for r in tries.orderBy(F.xxhash64("label"), "label").limit(tracker_size).collect()]
        tracker.extend(last)
        rest = whole.drop("tries").join(few(kept).select(ID), ID, "left_anti").join(grown.selectExpr(ID, "tries + failed AS tries"), ID, "left")
        rest = sized(rest.select(*cols, "flat", F.coalesce("tries", F.lit(0)).cast("long").alias("tries")))
        discard(grown, fits, labels, planes, own, named, held, planes_held, None if free is whole else free)
        free, held, planes_held = rest, kept, found
        if number == max_rounds or sum(tracker) < min_success_ratio * tracker_size or not any(last):
            break
    if held is None:
        none = base.select(ID, *keys, F.lit(-1).cast("long").alias("region_id"))
        return none, none.limit(0).select("region_id", F.lit(0).cast("long").alias("n"), *(F.lit(0.0).alias("p" + c) for c in AXES), F.array(F.lit(0.0)).alias("plane"))
    # by its id where each point has a place of its own, else by its place
    by = place if places.where("w > 1").limit(1).count() else [ID]
    named = base.join(few(held).select(*by, "region_id"), by, "left")
    named = named.select(ID, *keys, F.coalesce("region_id", F.lit(-1)).cast("long").alias("region_id"))
    return named, planes_held.select("region_id", "n", *PLANE)


def segment_planes(points: DataFrame, **params) -> DataFrame:
    """``point_id, region_id`` (and the chunk) as grow_planes gives them."""
    return grow_planes(points, **params)[0]


def segment_chunked(points: DataFrame, nx: int, ny: int, nz: int, **params) -> DataFrame:
    """``point_id, chunk_id, region_id, region_number``: the cloud cut into nx x
    ny x nz chunks whose points are segmented within their chunk, with normals
    from neighbours of all chunks. Regions are named by their smallest member
    and numbered 0, 1, 2, ... from chunk to chunk; points without have -1."""
    named = segment_planes(chunk_by_number(points, nx, ny, nz), chunk="chunk_id", **params)
    own = named.where("region_id >= 0").select("chunk_id", "region_id").distinct()
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("region_id")) - 1
    number = own.withColumn("_place", place).join(region_offsets(own), "chunk_id").select("region_id", (F.col("_place") + F.col("region_offset")).cast("long").alias("region_number"))
    return named.join(number, "region_id", "left").select(ID, "chunk_id", "region_id", F.coalesce("region_number", F.lit(-1)).cast("long").alias("region_number"))
