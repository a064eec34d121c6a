"""The append-only tool log: JSON lines with tool, action, user, timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "tool string, action string, user string, timestamp string"


def parse_tool_log(log: DataFrame, column: str = "entry") -> DataFrame:
    """Fields of each entry, with ``at`` as a timestamp; works on batches and
    streams alike. A line that is no JSON gives nulls."""
    e = log.select(F.from_json(column, ENTRY).alias("e")).select("e.*")
    return e.withColumn("at", F.try_to_timestamp("timestamp").cast("timestamp_ntz"))


def append_tool_log(entries: DataFrame, path: str, enabled: bool = False) -> None:
    """Append (tool, action, user, timestamp) rows as JSON, if the user opted in."""
    if enabled:
        entries.select(F.to_json(F.struct("tool", "action", "user", "timestamp")).alias("entry")).write.mode("append").parquet(path)


def read_tool_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_tool_log(spark.read.schema("entry string").parquet(path))
