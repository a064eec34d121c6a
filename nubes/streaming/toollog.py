"""The tool log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.toollog import parse_tool_log


def stream_tool_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_tool_log(spark.readStream.schema("entry string").parquet(path))
