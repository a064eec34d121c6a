"""PLY point files as a Spark data source.

``spark.read.format("ply").load(path)`` gives ``point_id`` (row position in its
file) and the vertex element's properties of a file, a folder or a pattern, on
local or shared storage. Binary files are cut in row ranges, one partition each.
Rows of an ASCII file are only known by counting: ``read_ply`` reads such files
as text in Spark's splits and numbers the lines by counts per split; through the
plain format an ASCII file is one partition, read in batches.
``df.write.format("ply")`` streams each partition to one binary file: numbers
keep their types, SHORT columns of colour names are uchar, LONG ones uint; a null
or a value that its type can't hold is an error.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType
from pyspark.sql.window import Window

from . import files

#: PLY's scalar types as numpy codes.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
ORDER = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
SPARK = {"i1": ByteType(), "u1": ShortType(), "i2": ShortType(), "u2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "f4": FloatType(), "f8": DoubleType()}
ARROW = {"i1": pa.int8(), "u1": pa.int16(), "i2": pa.int16(), "u2": pa.int32(), "i4": pa.int32(), "u4": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}
COLORS = ("red", "green", "blue", "alpha")
ROWS = 1 << 18


@dataclass
class Header:
    order: str
    count: int
    fields: list[tuple[str, str]]
    offset: int

    def dtype(self) -> np.dtype:
        return np.dtype([(n, (self.order or "<") + t) for n, t in self.fields])


def read_header(path: str) -> Header:
    order, elements, offset = None, [], 0  # elements: name, count, fields
    with files.open_file(path) as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is not PLY")
        while (line := f.readline()) and line.strip() != b"end_header":
            word = line.decode("ascii").split()
            if word[:1] == ["format"]:
                order = ORDER[word[1]]
            elif word[:1] == ["element"]:
                elements.append((word[1], int(word[2]), []))
            elif word[:1] == ["property"] and elements:
                elements[-1][2].append((word[-1], None if word[1] == "list" else TYPES[word[1]]))
        offset = f.tell()
        at = next((i for i, e in enumerate(elements) if e[0] == "vertex"), len(elements))
        for name, n, own in elements[:at]:  # rows of elements before the vertices are passed over
            if order == "":
                for _ in range(n):
                    f.readline()
                offset = f.tell()
            elif n and any(t is None for _, t in own):
                raise ValueError(f"binary element {name} before the vertices has lists, so its size is not known")
            else:
                offset += n * sum(np.dtype(t).itemsize for _, t in own)
    count, fields = (elements[at][1], elements[at][2]) if at < len(elements) else (0, [])
    if any(t is None for _, t in fields):
        raise ValueError("list properties of vertices are not supported")
    missing = {"x", "y", "z"} - {n for n, _ in fields}
    if order is None or missing:
        raise ValueError(f"{path} lacks vertex properties {sorted(missing)}")
    return Header(order, count, fields, offset)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        out = []
        for p in files.list_files(self.path, ".ply"):
            h = read_header(p)
            step = self.rows if h.order else max(1, h.count)
            out += [Range(p, s, min(h.count, s + step)) for s in range(0, h.count, step)]
        return out

    def read(self, part: Range):
        h = read_header(part.path)
        with files.open_file(part.path) as f:
            f.seek(h.offset + (part.start * h.dtype().itemsize if h.order else 0))
            for at in range(part.start, part.stop, ROWS):
                n = min(ROWS, part.stop - at)
                if h.order:
                    a = np.frombuffer(f.read(n * h.dtype().itemsize), h.dtype())
                    cols = [a[name] for name, _ in h.fields]
                else:
                    rows = np.array([f.readline().split()[: len(h.fields)] for _ in range(n)], np.float64).reshape(n, -1)
                    cols = [rows[:, i] for i in range(len(h.fields))]
                arrays = [pa.array(c.astype(ARROW[t].to_pandas_dtype())) for c, (_, t) in zip(cols, h.fields, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *arrays], names=["point_id", *(n for n, _ in h.fields)])


@dataclass
class Written(WriterCommitMessage):
    path: str


class PlyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path = path.rstrip("/")
        code = {"byte": "i1", "short": "i2", "integer": "i4", "float": "f4", "double": "f8", "long": "u4"}
        fields = [f for f in schema.fields if f.name != "point_id"]
        odd = [f.name for f in fields if f.dataType.typeName() not in code]
        if odd:
            raise ValueError(f"no PLY type holds {odd}")
        self.fields = [(f.name, "u1" if f.name in COLORS and f.dataType.typeName() == "short" else code[f.dataType.typeName()]) for f in fields]
        if {"x", "y", "z"} - {n for n, _ in self.fields}:
            raise ValueError("x, y and z are needed")

    def write(self, batches):
        """Rows go to a scratch file first, since the header holds their number."""
        names = {v: k for k, v in TYPES.items() if not k[-1].isdigit()}
        kind, count = np.dtype([(n, "<" + t) for n, t in self.fields]), 0
        to = f"{self.path}/part-{uuid.uuid4().hex}.ply"
        with tempfile.TemporaryFile() as body:
            for b in batches:
                rows = np.empty(b.num_rows, kind)
                for n, t in self.fields:
                    col = b.column(b.schema.get_field_index(n))
                    if col.null_count:
                        raise ValueError(f"{n} has nulls, which PLY can't hold")
                    values = col.to_numpy(zero_copy_only=False)
                    if t in ("u1", "u4") and len(values) and not (0 <= values.min() and values.max() <= np.iinfo(t).max):
                        raise ValueError(f"{n} has values beyond {names[t]}")
                    rows[n] = values
                body.write(rows.tobytes())
                count += len(rows)
            head = ["ply", "format binary_little_endian 1.0", f"element vertex {count}", *(f"property {names[t]} {n}" for n, t in self.fields), "end_header", ""]
            body.seek(0)
            with files.create_file(to + ".tmp") as f:
                f.write("\n".join(head).encode())
                shutil.copyfileobj(body, f, 1 << 20)
        return Written(to)

    def commit(self, messages):
        for m in messages:
            files.move(m.path + ".tmp", m.path)

    def abort(self, messages):
        for m in messages:
            if m:
                files.remove(m.path + ".tmp")


class PlySource(DataSource):
    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        h = read_header(files.list_files(self.options["path"], ".ply")[0])
        return StructType([StructField("point_id", LongType()), *(StructField(n, SPARK[t]) for n, t in h.fields)])

    def reader(self, schema):
        return PlyReader(self.options["path"], int(self.options.get("rowsPerPartition", ROWS * 4)))

    def writer(self, schema, overwrite):
        return PlyWriter(self.options["path"], schema)


def read_ply(spark: SparkSession, path: str, **options):
    spark.dataSource.register(PlySource)
    found = files.list_files(path, ".ply")
    if len(found) == 1 and read_header(found[0]).order == "":
        return read_ascii(spark, found[0])
    return spark.read.format("ply").options(**options).load(path)


def read_ascii(spark: SparkSession, path: str):
    """One ASCII file as text: a line's number is the number of lines in the
    splits before its own and its place in the split. Only the table of splits
    goes through one task."""
    h = read_header(path)
    with files.open_file(path) as f:
        skip = f.read(h.offset).count(b"\n")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("split", "first", before.alias("before"))
    row = (F.col("at") - F.col("first") + F.col("before") - skip).cast("long")
    rows = lines.join(splits, "split").withColumn("point_id", row).where(F.col("point_id").between(0, h.count - 1))
    parts = F.split(F.trim("value"), r"\s+")
    return rows.select("point_id", *(F.get(parts, F.lit(i)).cast("double").cast(SPARK[t]).alias(n) for i, (n, t) in enumerate(h.fields)))


def write_ply(df, path: str) -> None:
    df.sparkSession.dataSource.register(PlySource)
    df.write.format("ply").mode("append").save(path)
