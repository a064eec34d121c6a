"""Geometry as Column expressions: cells, projection, symmetric 3x3 eigenvalues."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK21 = (1 << 21) - 1


def voxel_key(x: Column, y: Column, z: Column, inv_s: float) -> Column:
    """21 bits a cell coordinate in one BIGINT (coordinates in the positive octant)."""
    cx, cy, cz = ((c * inv_s).cast("long").bitwiseAND(F.lit(MASK21)) for c in (x, y, z))
    return F.shiftleft(cx, 42).bitwiseOR(F.shiftleft(cy, 21)).bitwiseOR(cz)


def flatten_index(ix: Column, iy: Column, iz: Column, ny, nz) -> Column:
    return ix * ny * nz + iy * nz + iz


def unflatten_index(i: Column, ny, nz) -> list[Column]:
    n = F.lit(ny) * F.lit(nz) if not isinstance(ny, Column) else ny * nz
    return [F.floor(i / n), F.floor(F.pmod(i, n) / nz), F.pmod(i, nz if isinstance(nz, Column) else F.lit(nz))]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def squared_distance(a, b) -> Column:
    return dot([p - q for p, q in zip(a, b, strict=True)], [p - q for p, q in zip(a, b, strict=True)])


def project(x: Column, y: Column, z: Column, matrix: Sequence[float], w: float, h: float) -> tuple[Column, Column, Column]:
    """Screen x, y and depth by a row-major 4x4 matrix; null behind the camera."""
    if len(matrix) != 16:
        raise ValueError("matrix must have 16 numbers")
    rows = [x * float(matrix[4 * r]) + y * float(matrix[4 * r + 1]) + z * float(matrix[4 * r + 2]) + float(matrix[4 * r + 3]) for r in range(4)]
    ndc = [F.when(rows[3] > 0, rows[k] / rows[3]) for k in range(3)]
    return (ndc[0] + 1) / 2 * float(w), (ndc[1] + 1) / 2 * float(h), ndc[2]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not written out at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_polygon(px: Column, py: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges, the bounding box first. The
    position is bound once, and the edges are one literal array."""
    if len(polygon) < 3:
        return F.lit(False)
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    ends = zip(polygon, [polygon[-1], *polygon[:-1]], strict=True)
    edges = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("xi", "yi", "xj", "yj"), (*i, *j), strict=True))) for i, j in ends))

    def crossed(p, e):
        at = (e["xj"] - e["xi"]) * (p["y"] - e["yi"]) / (e["yj"] - e["yi"] + 1e-12) + e["xi"]
        return ((p["y"] < e["yi"]) != (p["y"] < e["yj"])).cast("int") * (p["x"] < at).cast("int")

    def inside(p):
        box = p["x"].between(min(xs), max(xs)) & p["y"].between(min(ys), max(ys))
        return box & (F.aggregate(edges, F.lit(0), lambda n, e: n + crossed(p, e)) % 2 == 1)

    return F.coalesce(let(F.struct(px.alias("x"), py.alias("y")), inside), F.lit(False))


def eigenvalues(xx, xy, xz, yy, yz, zz) -> Column:
    """Ascending eigenvalues, an array of three, of a symmetric 3x3 matrix in
    closed form; tiny negative values from rounding become zero."""

    def cosine(q, p):
        a, b, c, d, e, f = (F.try_divide(m, p) for m in (xx - q, yy - q, zz - q, xy, yz, xz))
        det = let(F.array(a, b, c, d, e, f), lambda v: _det(*(F.get(v, F.lit(i)) for i in range(6))))
        return F.greatest(F.least(F.coalesce(det, F.lit(0.0)) / 2, F.lit(1.0)), F.lit(-1.0))

    def roots(q, p, phi):
        both = F.array(q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3))
        return let(both, lambda v: F.array(F.greatest(F.get(v, F.lit(1)), F.lit(0.0)), F.greatest(3 * q - F.get(v, F.lit(0)) - F.get(v, F.lit(1)), F.lit(0.0)), F.get(v, F.lit(0))))

    def spread(q):
        return F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)

    return let((xx + yy + zz) / 3, lambda q: let(spread(q), lambda p: let(F.acos(cosine(q, p)) / 3, lambda phi: roots(q, p, phi))))


def _det(a, b, c, d, e, f):
    return a * (b * c - e * e) - d * (d * c - e * f) + f * (d * e - b * f)


def smallest_normal(xx, xy, xz, yy, yz, zz, values: Column, ambiguous: float = 1e-6) -> Column:
    """Unit eigenvector of the smallest of the eigenvalues (an array), its first
    component beyond 1e-6 positive; null where the two smallest are equal."""
    at = lambda v, i: F.get(v, F.lit(i))

    def longest(low):
        rows = [[xx - low, xy, xz], [xy, yy - low, yz], [xz, yz, zz - low]]
        cands = F.array(*(F.array(*cross(rows[i], rows[j])) for i, j in ((0, 1), (0, 2), (1, 2))))
        return let(cands, lambda c: let(F.transform(c, lambda v: at(v, 0) * at(v, 0) + at(v, 1) * at(v, 1) + at(v, 2) * at(v, 2)), lambda n: F.when((at(n, 0) >= at(n, 1)) & (at(n, 0) >= at(n, 2)), at(c, 0)).when(at(n, 1) >= at(n, 2), at(c, 1)).otherwise(at(c, 2))))

    def unit(v):
        return let(F.sqrt(at(v, 0) * at(v, 0) + at(v, 1) * at(v, 1) + at(v, 2) * at(v, 2)), lambda n: F.transform(v, lambda x: F.try_divide(x, n)))

    def signed(u):
        first = F.when(F.abs(at(u, 0)) > 1e-6, at(u, 0)).when(F.abs(at(u, 1)) > 1e-6, at(u, 1)).otherwise(at(u, 2))
        return let(F.when(first < 0, -1.0).otherwise(1.0), lambda s: F.transform(u, lambda x: x * s))

    normal = let(at(values, 0), lambda low: let(longest(low), lambda v: let(unit(v), signed)))
    return F.when(at(values, 1) - at(values, 0) > ambiguous * at(values, 2), normal)


def steady(v: Column, digits: int = 4) -> Column:
    """Rounded for comparison: borders lie off the decimal grid, so that values
    on the grid do not depend on the last bit."""
    return F.floor(v * float(10**digits) + 0.50005) / float(10**digits)
