"""Colours as Column expressions: colour maps, HSV, label colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GREY_204, GREY_153 = (204, 204, 204), (153, 153, 153)
KNUTH = 2654435761
#: Control points (position, three components) of the colour maps.
COLOR_MAPS: dict[str, tuple[str, list[tuple[float, float, float, float]]]] = {
    "red-green": ("rgb", [(0.0, 1.0, 0.0, 0.0), (1.0, 0.0, 1.0, 0.0)]),
    "gray": ("rgb", [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0)]),
    "viridis": ("rgb", [(0.0, 0.267, 0.005, 0.329), (0.25, 0.283, 0.141, 0.458), (0.5, 0.254, 0.265, 0.530), (0.75, 0.207, 0.372, 0.553), (1.0, 0.993, 0.906, 0.144)]),
    "plasma": ("rgb", [(0.0, 0.050, 0.030, 0.528), (0.25, 0.382, 0.089, 0.725), (0.5, 0.647, 0.165, 0.620), (0.75, 0.902, 0.387, 0.325), (1.0, 0.941, 0.975, 0.131)]),
    "inferno": ("rgb", [(0.0, 0.002, 0.005, 0.014), (0.25, 0.258, 0.038, 0.406), (0.5, 0.578, 0.148, 0.404), (0.75, 0.902, 0.387, 0.161), (1.0, 0.988, 0.998, 0.645)]),
    "magma": ("rgb", [(0.0, 0.001, 0.000, 0.015), (0.25, 0.251, 0.073, 0.377), (0.5, 0.571, 0.186, 0.491), (0.75, 0.901, 0.444, 0.372), (1.0, 0.987, 0.991, 0.749)]),
    "coolwarm": ("rgb", [(0.0, 0.231, 0.298, 0.753), (0.5, 0.865, 0.865, 0.865), (1.0, 0.706, 0.016, 0.150)]),
    "rainbow": ("rgb", [(0.0, 0.5, 0.0, 1.0), (0.2, 0.0, 0.0, 1.0), (0.4, 0.0, 1.0, 1.0), (0.6, 0.0, 1.0, 0.0), (0.8, 1.0, 1.0, 0.0), (1.0, 1.0, 0.0, 0.0)]),
    "jet": ("rgb", [(0.0, 0.0, 0.0, 0.5), (0.35, 0.0, 0.0, 1.0), (0.5, 0.0, 1.0, 0.0), (0.65, 1.0, 1.0, 0.0), (1.0, 0.5, 0.0, 0.0)]),
}


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = F.pmod(i, F.lit(6))
    pick = lambda *c: reduce(lambda w, x: w.when(k == x[0], x[1]), list(enumerate(c))[1:], F.when(k == 0, c[0]))
    return [pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)]


def to_bytes(rgb: list[Column]) -> Column:
    return F.array(*((c * 255).cast("int") for c in rgb))


def apply_colormap(v: Column, name: str, lo, hi, maps=None) -> Column:
    """Piecewise linear between a map's control points stretched to [lo, hi];
    ends clamped; a value that is null, or a range without width, gives the
    lowest colour."""
    maps = maps or COLOR_MAPS
    if name not in maps:
        raise ValueError(f"unknown colour map {name}")
    kind, points = maps[name]
    points = sorted(points)
    first, last = points[0][0], points[-1][0]
    t = F.coalesce(F.try_divide(v - lo, F.lit(hi) - lo if not isinstance(hi, Column) else hi - lo), F.lit(0.0))
    at = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0)) * (last - first) + first
    out = []
    for c in (1, 2, 3):
        e = F.lit(float(points[-1][c]))
        for a, b in reversed(list(zip(points, points[1:], strict=False))):
            e = F.when(at <= b[0], a[c] + (at - a[0]) * ((b[c] - a[c]) / (b[0] - a[0]))).otherwise(e)
        out.append(e)
    return to_bytes(hsv_to_rgb(*out) if kind == "hsv" else out)


def instance_color(i: Column) -> Column:
    """A vivid hue hashed from the id."""
    hue = (F.pmod(i.cast("long"), F.lit(1 << 32)) * KNUTH).bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)
    return to_bytes(hsv_to_rgb(hue, F.lit(0.9), F.lit(0.9)))


def random_color(seed: int) -> Column:
    """A vivid colour of a random hue, which is drawn once for each row."""
    return F.get(F.transform(F.array(F.rand(seed)), lambda hue: to_bytes(hsv_to_rgb(hue, F.lit(0.9), F.lit(0.9)))), F.lit(0))


def component(v: Column, i: int) -> Column:
    """The i-th component of a vector, i clamped to its range."""
    return F.element_at(v, F.least(F.greatest(F.lit(i), F.lit(0)), F.size(v) - 1) + 1)


def blend(a: Column, b: Column, t: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - t) + y * t)


def dark_text(rgb: Column) -> Column:
    """True where black text reads better on the colour."""
    return 0.2126 * F.get(rgb, F.lit(0)) + 0.7152 * F.get(rgb, F.lit(1)) + 0.0722 * F.get(rgb, F.lit(2)) > 128
