"""Point views over the driver's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEM = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE -1 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS point_id",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS timestamp_ntz)) / 86400000000D AS x",
        "value / 10 AS y",
        "cast((user_id % 20) / 2D AS double) AS z",
        f"{SEM} AS sem",
        "cast(user_id % 7 AS int) AS inst",
        "value AS intensity",
    )


def quantised(points: DataFrame, scale: int = 10_000) -> DataFrame:
    """Coordinates as whole numbers of 1e-4 in DOUBLE: their sums are exact."""
    return points.withColumns({c: F.round(F.col(c) * scale) for c in "xyz"})


def points_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [f"cast(element_at(embedding, {i}) AS double) AS {c}" for i, c in enumerate("xyz", 1)]
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS point_id", *at, "label AS sem", "embedding AS vec")


def points_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    a = g.agg(F.min("l_quantity").alias("x"), (F.min("l_extendedprice") / 2000).alias("y"), (F.min("l_discount") * 100).alias("z"), F.min("l_returnflag").alias("flag"))
    ident = "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS point_id"
    return a.selectExpr(ident, "cast(x AS double) AS x", "cast(y AS double) AS y", "cast(z AS double) AS z", "flag")


E_SQL = f"""points_e AS (
  SELECT event_id AS point_id, (epoch_us(ts) - 1704067200000000) / CAST(86400000000 AS DOUBLE) AS x, value / 10 AS y,
    CAST((user_id % 20) / 2.0 AS DOUBLE) AS z, {SEM} AS sem, CAST(user_id % 7 AS INT) AS inst, value AS intensity FROM events)"""
Q_SQL = E_SQL + """, q AS (
  SELECT point_id, round(x * 10000) AS x, round(y * 10000) AS y, round(z * 10000) AS z, sem, inst FROM points_e)"""
V_SQL = """points_v AS (
  SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
    label AS sem, embedding AS vec FROM embeddings)"""
L_SQL = """points_l AS (
  SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS point_id, CAST(min(l_quantity) AS DOUBLE) AS x,
    CAST(min(l_extendedprice) / 2000 AS DOUBLE) AS y, CAST(min(l_discount) * 100 AS DOUBLE) AS z, min(l_returnflag) AS flag
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber)"""
