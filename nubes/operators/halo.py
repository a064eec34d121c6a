"""Neighbourhood sums of clouds that are crowded all over, block by block.

Space is cut into cubes whose edge doubles from the radius r on while a cube and
the points within r of it (its halo) are ROOM places at most. A place goes to its
own cube and to those whose halo it lies in, and nothing else is shuffled: no
pair, and no row for a pair of cells. In a cube, cells of r / m take the place of
points. Cells wholly within r of a cell add their moments, by the row; places of
cells at the border are tested one by one. Distances are those of the range join.

Moments are taken about the cube's middle, rounded, so sums are exact on
whole-number coordinates. Places whose smallest cube is too full for a task, or
that lie with more than CELL others in one cell of r, are left to ``moments``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import few, sized

ROOM, CELL, LEVELS = 1 << 20, 1 << 17, 4
FINE, FILLED, AT_ONCE, CELLS = 16, 32, 1 << 18, 2048  # most r / edge of a cell, places in a usual cell, pairs and cells at once
AXES, SIX = ("x", "y", "z"), ("xx", "xy", "xz", "yy", "yz", "zz")
C, B = ["cx", "cy", "cz"], ["bx", "by", "bz"]


def around(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells and the 26 about each."""
    near = cells.select(*keys, *C).selectExpr("*", "explode(sequence(-1, 1)) AS i").selectExpr("*", "explode(sequence(-1, 1)) AS j").selectExpr("*", "explode(sequence(-1, 1)) AS k")
    return near.selectExpr(*keys, "cx + i AS cx", "cy + j AS cy", "cz + k AS cz").distinct()


def halo_sums(query: DataFrame, points: DataFrame, zone: DataFrame, r: float, edge: float, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``q_id`` (and keys) with ``n`` and the six sums, for the query's places in
    the cells of ``zone`` (keys, cx, cy, cz) that blocks have room for; and the
    cells of the others, or None."""
    cell = lambda df, *more: df.selectExpr(*keys, *more, *(f"floor({a} / {edge!r}D) AS {c}" for a, c in zip(AXES, C, strict=True)))
    sides = [points] if query is points else [points, query]
    cells = reduce(DataFrame.unionByName, (cell(s) for s in sides)).groupBy(*keys, *C).agg(F.count(F.lit(1)).alias("n"))
    cells = sized(cells.join(around(zone, keys), [*keys, *C], "left_semi"))
    asked = sized(cells.join(zone.select(*keys, *C), [*keys, *C], "left_semi").select(*keys, *C))
    levels = cells.selectExpr("*", f"explode(sequence(0, {LEVELS})) AS level")
    reach = levels
    for c, b in zip(C, B, strict=True):
        reach = reach.selectExpr("*", f"explode(sequence(shiftright({c} - 1, level), shiftright({c} + 1, level))) AS {b}")
    fits = reach.groupBy(*keys, "level", *B).agg(F.sum("n").alias("total"), F.max("n").alias("most")).where(f"total <= {ROOM} AND most <= {CELL}")
    inside = levels.selectExpr("*", *(f"shiftright({c}, level) AS {b}" for c, b in zip(C, B, strict=True)))
    own = inside.join(fits, [*keys, "level", *B], "left_semi").groupBy(*keys, *C).agg(F.max("level").alias("level"))
    own = own.join(asked, [*keys, *C], "left_semi")
    own = sized(own.selectExpr("*", *(f"shiftright({c}, level) AS {b}" for c, b in zip(C, B, strict=True))))
    over = sized(asked.join(own, [*keys, *C], "left_anti")) if own._rows < asked._rows else None
    blocks = sized(own.select(*keys, "level", *B).distinct().withColumn("block", F.monotonically_increasing_id()))
    near = sized(reach.join(few(blocks), [*keys, "level", *B]).select(*keys, *C, "level", *B, "block"))
    core = own.join(few(blocks), [*keys, "level", *B]).select(*keys, *C, "block")
    told = [*keys, "point_id", *AXES]
    if query is points:
        home = sized(near.join(core.withColumn("core", F.lit(True)), [*keys, *C, "block"], "left").select(*keys, *C, "block", F.coalesce("core", F.lit(False)).alias("core")))
        dealt = cell(points, "point_id", *AXES, "w").join(few(home), [*keys, *C]).select(*told, "w", "block", "core")
    else:
        core = sized(core)
        dealt = cell(points, "point_id", *AXES, "w").join(few(near), [*keys, *C]).select(*told, "w", "block", F.lit(False).alias("core"))
        dealt = dealt.unionByName(cell(query, "point_id", *AXES).join(few(core), [*keys, *C]).select(*told, F.lit(0).cast("long").alias("w"), "block", F.lit(True).alias("core")))
    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"q_id {kinds['point_id']}", "n long", *(f"{p} double" for p in SIX)])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        at, w, core = b[list(AXES)].to_numpy(float), b["w"].to_numpy(float), b["core"].to_numpy(bool)
        own = b.loc[core, [*keys, "point_id"]].rename(columns={"point_id": "q_id"}).reset_index(drop=True)
        data = w > 0
        sums = block_sums(at[core], at[data], w[data], r)
        found = sums[:, 0] > 0
        return own.assign(n=sums[:, 0].astype(np.int64), **dict(zip(SIX, sums[:, 1:].T, strict=True)))[found]

    # a task for each block or few: what a block takes in time is not told by its bytes
    return dealt.repartition(max(1, min(blocks._rows, 2000)), "block").groupBy("block").applyInPandas(run, schema), over


def _runs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges lo to hi - 1, one after another."""
    size = hi - lo
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(lo - ends + size, size)


def block_sums(q: np.ndarray, d: np.ndarray, w: np.ndarray, r: float) -> np.ndarray:
    """For each row of q, over the rows of d within r: the sum of weights, and
    the six weighted products of offsets."""
    out = np.zeros((len(q), 7))
    if not len(q) or not len(d):
        return out
    low, high = np.minimum(q.min(axis=0), d.min(axis=0)), np.maximum(q.max(axis=0), d.max(axis=0))
    m = 1
    while m < FINE:  # halve the edge while cells stay filled, as seen from a place
        c, wide = np.floor((d - low) / (r / (2 * m))).astype(np.int64), np.floor((high - low) / (r / (2 * m))).astype(np.int64) + 1
        _, size = np.unique((c[:, 2] * wide[1] + c[:, 1]) * wide[0] + c[:, 0], return_counts=True)
        if (size.astype(float) ** 2).sum() < FILLED * len(d):
            break
        m *= 2
    h, pad = r / m, m + 2
    qc, dc = (np.floor((v - low) / h).astype(np.int64) + pad for v in (q, d))
    top = np.maximum(qc.max(axis=0), dc.max(axis=0)) + pad + 1
    key = lambda c: (c[:, 2] * top[1] + c[:, 1]) * top[0] + c[:, 0]
    order = np.argsort(key(dc), kind="stable")
    d, w, dc = d[order], w[order], dc[order]
    cells, first = np.unique(key(dc), return_index=True)
    first = np.append(first, len(d))
    # moments about the middle, of each place and, added up, of the cells before each cell
    middle = np.round((low + high) / 2)
    e = d - middle
    each = np.stack([np.ones(len(d)), *e.T, *(e[:, i] * e[:, j] for i in range(3) for j in range(i, 3))], axis=1) * w[:, None]
    before = np.zeros((len(cells) + 1, 10), np.longdouble)
    np.cumsum(np.add.reduceat(each, first[:-1], axis=0), axis=0, out=before[1:], dtype=np.longdouble)
    order = np.argsort(key(qc), kind="stable")
    q, qc = q[order], qc[order]
    own, begin = np.unique(key(qc), return_index=True)
    begin = np.append(begin, len(q))
    occupied = np.isin(np.arange(qc[:, 2].max() + pad + 1), dc[:, 2])
    sums = np.zeros((len(q), 10), np.longdouble)
    for k in range(0, len(own), CELLS):
        _cell_sums(own[k : k + CELLS], begin[k : k + CELLS + 1], q, d, each, cells, first, before, occupied, top, m, r * r, sums)
    u = (q - middle).astype(np.longdouble)
    n, s = sums[:, 0], sums[:, 1:4]
    six = [sums[:, 4 + t] - u[:, i] * s[:, j] - u[:, j] * s[:, i] + n * u[:, i] * u[:, j] for t, (i, j) in enumerate((i, j) for i in range(3) for j in range(i, 3))]
    out[order] = np.stack([n, *six], axis=1).astype(float)
    return out


def _cell_sums(own, begin, q, d, each, cells, first, before, occupied, top, m, r2, sums) -> None:
    """Adds to ``sums`` for the rows of q in the cells ``own``: row by row of
    cells along x, the moments of those wholly within r, and the places of the
    others that are not wholly beyond."""
    whole, z_of, ranges = np.zeros((len(own), 10), np.longdouble), own // (top[0] * top[1]), []
    for dz in range(-m - 1, m + 2):
        use = np.flatnonzero(occupied[z_of + dz])
        for dy in range(-m - 1, m + 2) if len(use) else ():
            row = own[use] + (dz * top[1] + dy) * top[0]
            inner = m * m * (1 - 1e-9) - (abs(dy) + 1) ** 2 - (abs(dz) + 1) ** 2
            outer = m * m * (1 + 1e-9) - max(abs(dy) - 1, 0) ** 2 - max(abs(dz) - 1, 0) ** 2
            if outer < 0:
                continue
            far = int(np.sqrt(outer)) + 1
            lo, hi = np.searchsorted(cells, row - far), np.searchsorted(cells, row + far, "right")
            if inner < 1:
                ranges.append((use, first[lo], first[hi]))
                continue
            near = int(np.sqrt(inner)) - 1
            lo_in, hi_in = np.searchsorted(cells, row - near), np.searchsorted(cells, row + near, "right")
            whole[use] += before[hi_in] - before[lo_in]
            ranges += [(use, first[lo], first[lo_in]), (use, first[hi_in], first[hi])]
    sums[begin[0] : begin[-1]] += np.repeat(whole, np.diff(begin), axis=0)
    los = np.zeros((len(own), len(ranges) + 1), np.int64)
    his = np.zeros_like(los)
    for k, (use, lo, hi) in enumerate(ranges):
        los[use, k], his[use, k] = lo, hi
    for k in range(len(own)):
        near = _runs(los[k], his[k])
        for at in range(0, len(near), AT_ONCE):
            some = near[at : at + AT_ONCE]
            (dx, dy, dz), more = d[some].T, each[some]
            step = max(1, AT_ONCE // len(some))
            for i in range(begin[k], begin[k + 1], step):
                j = min(i + step, begin[k + 1])
                fx, fy, fz = dx - q[i:j, 0, None], dy - q[i:j, 1, None], dz - q[i:j, 2, None]
                sums[i:j] += (fx * fx + fy * fy + fz * fz <= r2).astype(float) @ more
