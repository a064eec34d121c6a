"""The data model: points tables with ``cloud_id, point_id, x, y, z`` and typed
field columns; a column's field type is kept in its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD_TYPES = {"SCALAR": 1, "VECTOR": None, "COLOR": 3, "NORMAL": 3, "INTENSITY": 1, "SEMANTIC": 1, "INSTANCE": 1}
COORDS = ("x", "y", "z")
RESERVED = {"points", "cloud_id", "point_id", "doc_name", "visible", *COORDS}
FORMAT_VERSION = 1
UNLABELED, NO_INSTANCE = -1, 0


def default_type(width: int) -> str:
    return "SCALAR" if width == 1 else "VECTOR"


def check_width(kind: str, width: int) -> None:
    if kind not in FIELD_TYPES:
        raise ValueError(f"unknown field type {kind}")
    if FIELD_TYPES[kind] not in (None, width) or width < 1:
        raise ValueError(f"{kind} fields have {FIELD_TYPES[kind] or 'at least 1'} columns, not {width}")


def typed(col: Column, name: str, kind: str) -> Column:
    """The column under a name, with its field type as metadata."""
    return col.alias(name, metadata={"field_type": kind})


def field_types(df: DataFrame) -> dict[str, str]:
    """Field name to type, in column order; a column without metadata gets the
    default of its width."""
    out = {}
    for f in df.schema.fields:
        if f.name not in RESERVED:
            out[f.name] = f.metadata.get("field_type") or ("VECTOR" if f.dataType.typeName() == "array" else "SCALAR")
    return out


def cast_field(col: Column, kind: str, width: int = 1) -> Column:
    """Labels as INT, other fields as FLOAT or ARRAY<FLOAT>."""
    if kind in ("SEMANTIC", "INSTANCE"):
        return col.cast("int")
    return col.cast("float") if width == 1 else col.cast("array<float>")


def default_value(kind: str, width: int = 1, fill: float = 0.0) -> Column:
    if kind in ("SEMANTIC", "INSTANCE"):
        return F.lit(UNLABELED if kind == "SEMANTIC" else NO_INSTANCE).cast("int")
    one = F.lit(fill).cast("float")
    return one if width == 1 else F.array(*[one] * width)
