"""NumPy ``.npy`` arrays (1-D or 2-D) as a Spark data source.

Columns are named from the file's stem: one column takes the stem, three take
nx, ny, nz where the stem speaks of normals and red, green, blue where it
speaks of colours, others take stem_i. ``point_id`` is the row position; row
ranges are partitions, of BYTES bytes at most, also of column-major arrays, and
columns have the array's type. A folder of arrays with equal columns is one table, named
by the folder, whose rows count on from file to file in order of name.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, ByteType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

from . import files

BYTES = 1 << 24  # of a partition, and of what is read of it at once
# NumPy's kinds and sizes, and the type that holds each without change
TYPES: dict[str, DataType] = {"b1": BooleanType(), "i1": ByteType(), "i2": ShortType(), "i4": IntegerType(), "i8": LongType(), "u1": ShortType(), "u2": IntegerType(), "u4": LongType(), "u8": DecimalType(20, 0), "f2": FloatType(), "f4": FloatType(), "f8": DoubleType()}
ARROW = {"u1": pa.int16(), "u2": pa.int32(), "u4": pa.int64(), "f2": pa.float32()}


def column_names(path: str, width: int) -> list[str]:
    stem = os.path.basename(path.rstrip("/")).removesuffix(".npy")
    low = stem.lower()
    if width == 1:
        return [stem]
    if width == 3 and "normal" in low:
        return ["nx", "ny", "nz"]
    if width == 3 and ("color" in low or low == "rgb"):
        return ["red", "green", "blue"]
    return [f"{stem}_{i}" for i in range(width)]


@dataclass
class Header:
    rows: int
    width: int
    kind: np.dtype
    offset: int
    by_column: bool

    @property
    def code(self) -> str:
        return f"{self.kind.kind}{self.kind.itemsize}"


def header(path: str) -> Header:
    """Shape, type, order and where the data begins. Archives, other ranks and
    types that no column holds are refused."""
    if path.endswith(".npz"):
        raise ValueError("archives of arrays are not supported")
    with files.open_file(path) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(f)
        if len(shape) not in (1, 2):
            raise ValueError(f"{path} must be a one- or two-dimensional array")
        out = Header(shape[0], shape[1] if len(shape) == 2 else 1, kind, f.tell(), bool(fortran))
        if out.code not in TYPES:
            raise ValueError(f"{path} has elements of type {kind}, which no column holds")
        return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    before: int


def column(values: np.ndarray, code: str) -> pa.Array:
    """A column of its own type; unsigned numbers in the next wider one."""
    native = values.astype(values.dtype.newbyteorder("="))
    if code == "u8":
        return pa.array([int(v) for v in native], pa.decimal128(20, 0))
    return pa.array(native).cast(ARROW[code]) if code in ARROW else pa.array(native)


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        out, before, first = [], 0, None
        for p in files.list_files(self.path, ".npy"):
            h = header(p)
            first = first or h
            if (h.width, h.code) != (first.width, first.code):
                raise ValueError(f"{p} has other columns than the files before it")
            step = max(1, BYTES // max(1, h.width * h.kind.itemsize))
            out += [Range(p, s, min(h.rows, s + step), before) for s in range(0, h.rows, step)] or [Range(p, 0, 0, before)]
            before += h.rows
        return out

    def read(self, part: Range):
        h, n = header(part.path), part.stop - part.start
        size = h.kind.itemsize
        with files.open_file(part.path) as f:
            if h.by_column:  # a run of rows from each column
                runs = []
                for i in range(h.width):
                    f.seek(h.offset + (i * h.rows + part.start) * size)
                    runs.append(np.frombuffer(f.read(n * size), h.kind))
            else:
                f.seek(h.offset + part.start * h.width * size)
                whole = np.frombuffer(f.read(n * h.width * size), h.kind).reshape(n, h.width)
                runs = [whole[:, i] for i in range(h.width)]
        cols = [column(v, h.code) for v in runs]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.start, part.stop) + part.before), *cols], names=["point_id", *column_names(self.path, h.width)])


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        path = self.options["path"]
        h = header(files.list_files(path, ".npy")[0])
        return StructType([StructField("point_id", LongType()), *(StructField(n, TYPES[h.code]) for n in column_names(path, h.width))])

    def reader(self, schema):
        return NpyReader(self.options["path"])


def read_npy(spark: SparkSession, path: str):
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").load(path)


def cloud_from_arrays(spark: SparkSession, coords: np.ndarray, colors: np.ndarray | None = None):
    """A points table from (N, 3) coordinates and (N, 3) 8-bit colours held by
    the caller."""
    if coords.ndim != 2 or coords.shape[1] != 3:
        raise ValueError("positive_coords must be a (N,3) float array")
    if colors is not None and colors.shape != coords.shape:
        raise ValueError("colors must be a (N,3) array")
    cols = {"point_id": pa.array(np.arange(len(coords)))} | {c: pa.array(coords[:, i].astype(np.float32)) for i, c in enumerate("xyz")}
    if colors is not None:
        cols["colors"] = pa.array(colors.astype(np.int32).tolist(), pa.list_(pa.int32()))
    return spark.createDataFrame(pa.table(cols))
