"""What of a document set is visible: one small manifest for each state.

A save writes all its tables below folders of its own first; then one new file
``manifests/<number>.json`` lists the saves that count, in order. Readers take the
manifest with the highest number, so a save is seen whole or not at all, and
what a failed one left is never read. Files of earlier saves are never touched.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    p, fs = file_system(spark, f"{root}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, list[dict]]:
    """(number, saves in order) of the latest state, or of an earlier one; a
    folder without any is number 0 without saves."""
    known = _numbers(spark, root)
    if version is None:
        version = known[-1] if known else 0
    if not version:
        return 0, []
    if version not in known:
        raise ValueError(f"{root} has no version {version}")
    p, fs = file_system(spark, f"{root}/manifests/{version:08d}.json")
    lines = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
    stream = fs.open(p)
    try:
        raw = lines.readFullyToByteArray(stream)
    finally:
        stream.close()
    return version, json.loads(bytes(raw).decode())


def new_save() -> str:
    return f"s{uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, before: int, saves: list[dict]) -> int:
    """Make ``saves`` the state after number ``before``; an error if another
    writer was first."""
    at, fs = file_system(spark, f"{root}/manifests/{before + 1:08d}.json")
    part, _ = file_system(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(json.dumps(saves).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(part, at):
        fs.delete(part, False)
        raise RuntimeError(f"{root} was changed by another writer")
    return before + 1
