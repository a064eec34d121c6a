"""Columns as typed fields: mapping, adding, removing, editing, inspecting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import GREY_153, apply_colormap, component, instance_color
from ..model import FIELD_TYPES, RESERVED, cast_field, check_width, default_type, default_value, field_types, typed
from .labels import class_lookup

ID = "point_id"
#: Input names (lower case) and the field, type and component they fill.
_GROUPS = {
    ("colors", "COLOR"): (("red", "r"), ("green", "g"), ("blue", "b")),
    ("normals", "NORMAL"): (("nx", "normalx", "normal_x"), ("ny", "normaly", "normal_y"), ("nz", "normalz", "normal_z")),
    ("intensity", "INTENSITY"): (("intensity", "intensities", "reflectance", "reflectivity", "luminosity", "luminance"),),
    (None, "SEMANTIC"): (("label", "labels", "class", "classes", "semantic", "semantic_label", "ground_truth", "groundtruth", "gt", "seg", "segmentation", "semantic_segmentation"),),
    (None, "INSTANCE"): (("instance", "instance_id", "instanceid", "object_id", "objectid", "inst"),),
}
AUTO_FIELDS = {name: (field, kind, i) for (field, kind), parts in _GROUPS.items() for i, names in enumerate(parts) for name in names}
#: Input names (lower case) of the three coordinates.
AUTO_COORDS = {
    "x": 0, "y": 1, "z": 2,
    "posx": 0, "posy": 1, "posz": 2,
    "positionx": 0, "positiony": 1, "positionz": 2,
    "coordx": 0, "coordy": 1, "coordz": 2,
}


@dataclass(frozen=True)
class Target:
    """Where an input column goes: a field's component."""

    source: str
    field: str
    kind: str
    index: int = 0


def auto_map(columns: list[str]) -> tuple[dict[int, str], list[Target]]:
    """(coordinate index to column, targets) for the names that are known."""
    coords, out = {}, []
    for c in columns:
        name = c.strip().lower()
        if name in AUTO_COORDS:
            coords.setdefault(AUTO_COORDS[name], c)
        elif name in AUTO_FIELDS:
            field, kind, i = AUTO_FIELDS[name]
            out.append(Target(c, field or c, kind, i))
    return coords, out


def validate_coords(coords: dict[int, str]) -> None:
    if set(coords) != {0, 1, 2}:
        raise ValueError("coordinates need exactly one column for each of x, y and z")


def map_fields(df: DataFrame, coords: dict[int, str], targets: list[Target], skip_missing: bool = True) -> DataFrame:
    """One select: coordinates as FLOAT x, y, z and each field as a typed
    column; components that nothing fills are 0."""
    validate_coords(coords)
    fields: dict[str, dict[int, Target]] = {}
    for t in targets:
        if t.source not in df.columns:
            if skip_missing:
                continue
            raise ValueError(f"no input column {t.source}")
        if t.index < 0 or (FIELD_TYPES[t.kind] or t.index + 1) <= t.index:
            raise ValueError(f"component {t.index} is out of range for {t.kind}")
        fields.setdefault(t.field, {})[t.index] = t
    cols = [F.col(coords[i]).cast("float").alias(c) for i, c in enumerate("xyz")]
    for name, parts in fields.items():
        kind = next(iter(parts.values())).kind
        width = FIELD_TYPES[kind] or max(parts) + 1
        value = [F.coalesce(F.col(parts[i].source).cast("float"), F.lit(0.0)) if i in parts else F.lit(0.0) for i in range(width)]
        cols.append(typed(cast_field(value[0] if width == 1 else F.array(*value), kind, width), name, kind))
    return df.select(*(c for c in ("cloud_id", ID) if c in df.columns), *cols)


def _check_new(df: DataFrame, name: str) -> None:
    if name in RESERVED or name in df.columns:
        raise ValueError(f"field name {name} is taken")


def add_field(df: DataFrame, name: str, kind: str | None = None, width: int = 1, fill: float = 0.0, data: DataFrame | None = None) -> DataFrame:
    """A new field, from a table (point_id, value) with a row for each point or
    filled with its default. Data for other points, or not one row each, is an
    error; a null value becomes the default."""
    _check_new(df, name)
    kind = kind or default_type(width)
    check_width(kind, width)
    rest = default_value(kind, width, fill)
    if data is None:
        return df.withColumn(name, typed(rest, name, kind))
    rows = data.groupBy(ID).agg(F.count(F.lit(1)).alias("n"))
    if df.select(ID, F.lit(1).alias("one")).join(rows, ID, "full").where("one is null or n is null or n > 1").limit(1).count():
        raise ValueError(f"data for {name} must have one row for each point")
    value = data.select(ID, cast_field(F.col("value"), kind, width).alias("_value"))
    return df.join(value, ID, "left").select(*df.columns, typed(F.coalesce("_value", rest), name, kind))


def get_fields(df: DataFrame, names: list[str] | None = None, kind: str | None = None, index: int | None = None) -> list[str]:
    found = [n for n, k in field_types(df).items() if (names is None or n in names) and (kind is None or k == kind)]
    return found if index is None else found[index : index + 1]


def field(df: DataFrame, name: str) -> DataFrame:
    if name not in field_types(df):
        raise KeyError(name)
    return df.select(ID, name)


def remove_fields(df: DataFrame, names: list[str] | None = None, kind: str | None = None) -> DataFrame:
    if names is None and kind is None:
        raise ValueError("names or a type are needed")
    return df.drop(*get_fields(df, names, kind))


def next_field_name(df: DataFrame, base: str = "Field", digits: int = 4) -> str:
    i = 0
    while f"{base}_{i:0{digits}d}" in df.columns:
        i += 1
    return f"{base}_{i:0{digits}d}"


@dataclass(frozen=True)
class Edit:
    """A column of the edited table: from a source (or none), name, type, width."""

    name: str
    kind: str
    width: int = 1
    source: str | None = None


def edit_fields(df: DataFrame, edits: list[Edit]) -> DataFrame:
    """One select that renames, retypes, resizes, duplicates, drops and reorders;
    a change of type or width resets to the default."""
    if len({e.name for e in edits}) < len(edits) or any(e.name in RESERVED for e in edits):
        raise ValueError("field names must be unique and not reserved")
    kinds, cols = field_types(df), []
    for e in edits:
        check_width(e.kind, e.width)
        rest = default_value(e.kind, e.width)
        value = rest
        if e.source is not None and kinds.get(e.source) == e.kind and (df.schema[e.source].dataType.typeName() == "array") == (e.width > 1):
            value = F.col(e.source)
            if e.width > 1:  # a type says array, only the value says how wide
                value = F.when(F.coalesce(F.size(value) == e.width, F.lit(True)), value).otherwise(rest.cast(df.schema[e.source].dataType))
        cols.append(typed(value, e.name, e.kind))
    return df.select(*(c for c in df.columns if c in RESERVED), *cols)


def import_fields(df: DataFrame, new: DataFrame, coords: dict[int, str], targets: list[Target]) -> DataFrame:
    """Attach mapped columns of another table with the same points."""
    if df.join(new, ID, "left_anti").limit(1).count() or new.join(df, ID, "left_anti").limit(1).count():
        raise ValueError("the tables have different points")
    mapped = map_fields(new, coords, targets).drop("x", "y", "z", "cloud_id")
    for c in mapped.columns:
        if c != ID:
            _check_new(df, c)
    return df.join(mapped, ID)


def to_wide(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """A flat record: vectors as one column for each component."""
    cols = [c for c in df.columns if c not in widths]
    parts = [F.get(F.col(c), F.lit(i)).alias(f"{c}_{i}") for c, n in widths.items() for i in range(n)]
    return df.select(*cols, *parts)


def _components(name: str, shown):
    return F.transform(F.col(name), lambda v, i: F.struct(F.lit(name).alias("field"), i.cast("string").alias("component"), shown(v).alias("value")))


def inspect_point(df: DataFrame, point_id: int, semantic: dict[str, DataFrame] | None = None, expand: bool = False) -> DataFrame:
    """``field, component, value`` (text) of one point: coordinates, then every
    field, of vectors the first three components unless ``expand``; labels with
    a class table show the class name."""
    one = df.where(F.col(ID) == point_id)
    row = lambda f, c, v: F.struct(F.lit(f).alias("field"), F.lit(c).alias("component"), v.cast("string").alias("value"))
    number = lambda v: F.format_string("%.4f", v.cast("double"))
    parts = [row("coords", c.upper(), number(F.col(c))) for c in "xyz"]
    arrays = []
    names = {"COLOR": ("Red", "Green", "Blue"), "NORMAL": ("X", "Y", "Z"), "VECTOR": ("0", "1", "2")}
    for f, kind in field_types(df).items():
        if kind == "VECTOR" and expand:
            arrays.append(_components(f, number))
        elif kind in names:
            parts += [row(f, n, number(F.get(F.col(f), F.lit(i)))) for i, n in enumerate(names[kind])]
        elif semantic and f in semantic:
            one = class_lookup(one, f, semantic[f]).withColumnRenamed("class_name", "_name_" + f).drop("rgb")
            ident = F.concat(F.lit("ID="), F.col(f))
            parts.append(row(f, "", F.coalesce(F.concat(F.col("_name_" + f), F.lit(" ("), ident, F.lit(")")), ident)))
        elif df.schema[f].dataType.typeName() in ("integer", "long"):
            parts.append(row(f, "", F.col(f)))
        else:
            parts.append(row(f, "", number(F.col(f))))
    return one.select(F.inline(F.concat(F.array(*parts), *arrays)))


def colorize(df: DataFrame, field_name: str, kind: str, lo: float | None = None, hi: float | None = None, classes: DataFrame | None = None, index: int = 0, cmap: str | None = None) -> DataFrame:
    """Add ``rgb`` (three bytes) to the visible points by the field's type; the
    range of a scalar is that of the visible values unless given."""
    from .select import visible_points

    seen = visible_points(df) if "visible" in df.columns else df
    if kind == "SEMANTIC":
        return class_lookup(seen, field_name, classes).drop("class_name")
    if kind == "INSTANCE":
        return seen.withColumn("rgb", instance_color(F.col(field_name)))
    if kind == "COLOR":
        v = F.col(field_name)
        flags = seen.agg(F.bool_and(F.forall(v, lambda x: x.between(0, 1))).alias("_unit"), F.bool_and(F.forall(v, lambda x: x.between(0, 255))).alias("_byte"))
        scaled = F.when(F.col("_unit"), F.transform(v, lambda x: (x * 255).cast("int"))).when(F.col("_byte"), F.transform(v, lambda x: x.cast("int")))
        return seen.crossJoin(F.broadcast(flags)).withColumn("rgb", scaled).drop("_unit", "_byte")
    if kind in ("SCALAR", "INTENSITY", "VECTOR", "NORMAL"):
        v = component(F.col(field_name), index) if kind in ("VECTOR", "NORMAL") else F.col(field_name)
        v = v.cast("double")
        name = cmap or ("gray" if kind == "INTENSITY" else "rainbow")
        if lo is not None:
            return seen.withColumn("rgb", apply_colormap(v, name, F.lit(float(lo)), F.lit(float(hi))))
        ends = seen.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        return seen.crossJoin(F.broadcast(ends)).withColumn("rgb", apply_colormap(v, name, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return seen.withColumn("rgb", F.array(*map(F.lit, GREY_153)))
