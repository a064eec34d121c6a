"""Tables written to the session's shared folder, and graph components on them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SMALL = 1 << 17  # rows that may be broadcast


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where the session names
    none, a local session (tests) gets a private temporary folder as that
    directory; on a cluster the setting is needed, since executors don't share
    local folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="nubes-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/nubes-{uuid.uuid4().hex}"


def materialise(df: DataFrame, codec: str = "lz4") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and
    survives the loss of an executor."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def sized(df: DataFrame) -> DataFrame:
    """``materialise``, and the number of rows as ``_rows``. Spark takes the size
    of a written table from its files, which hold long columns of ids or of cells
    in a few bytes a row; tables of more than SMALL rows are marked for a merge
    join, so that none of them is sent whole to the driver and the executors."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")))
    rows, path = seen.get.get("n"), out._written_to
    rows = out.count() if rows is None else rows
    if rows > SMALL:
        out = out.hint("merge")
        out._written_to = path
    out._rows = rows
    return out


def few(table: DataFrame) -> DataFrame:
    """A table that ``sized`` gave, to be sent to what it is joined with if its
    rows are SMALL at most."""
    return F.broadcast(table) if table._rows <= SMALL else table


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialise`` wrote for these tables, once nothing that is
    still to run reads them; other tables and None are left alone."""
    for t in tables:
        path = getattr(t, "__dict__", {}).pop("_written_to", None)
        if path:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for the ends of undirected edges: the smallest node that
    each can reach. Labels spread to neighbours and jump to their labels'
    labels, so the rounds grow with the logarithm of the longest path; each
    round is a written table. Null ends and self-edges add no reach."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = materialise(both.unionAll(both.select("y", "x")).distinct())
    labels = materialise(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"))
    old = labels
    while True:
        seen = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("seen"))
        near = labels.join(seen, F.col("node") == F.col("x")).select("node", "label", F.least("label", "seen").alias("near"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = near.join(jump, F.col("near") == F.col("via"), "left").select("node", F.col("label").alias("old"), F.least("near", F.coalesce("far", "near")).alias("label"))
        new = materialise(new)
        changed = new.where("old <> label").limit(1).count()
        discard(old)
        old, labels = new, new.select("node", "label")
        labels._written_to = new._written_to
        if not changed:
            discard(both)
            return labels


def contract_components(edges: DataFrame, a: str = "a", b: str = "b", write: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As connected_components, for large graphs with long paths.

    By contraction: each node joins the neighbour (or itself) that comes first
    in an order drawn anew each round, and edges are kept between these
    representatives alone. A round leaves three quarters of the nodes at most,
    as is to be expected, whatever the graph looks like, so all rounds together
    write a few times the first one. Then labels are handed back from round to
    round. Every table is written, by ``write``, materialise or sized."""
    write = write or materialise
    ends = edges.selectExpr(f"`{a}` AS x", f"`{b}` AS y").where("x IS NOT NULL AND y IS NOT NULL")
    alone = ends.where("x = y").select(F.col("x").alias("node")).distinct()
    ends = ends.where("x <> y")
    now = write(ends.unionAll(ends.select("y", "x")).distinct())
    rounds: list[DataFrame] = []
    while now.limit(1).count():
        order = f"struct(xxhash64({{0}}, {len(rounds)}L) AS h, {{0}} AS id)"
        first = now.groupBy("x").agg(F.expr(f"min({order.format('y')}) AS m"))
        rounds.append(write(first.selectExpr("x AS node", f"least({order.format('x')}, m).id AS rep")))
        moved = now.join(rounds[-1].selectExpr("node AS x", "rep AS p"), "x").join(rounds[-1].selectExpr("node AS y", "rep AS q"), "y")
        later = write(moved.where("p <> q").selectExpr("p AS x", "q AS y").distinct())
        discard(now)
        now = later
    discard(now)
    if not rounds:
        return write(alone.selectExpr("node", "node AS label"))
    back = rounds.pop()
    while rounds:  # a representative that was no node of the next round stands for itself
        one = rounds.pop()
        up = write(one.join(back.selectExpr("node AS rep", "rep AS top"), "rep", "left").selectExpr("node", "coalesce(top, rep) AS rep"))
        discard(one, back)
        back = up
    least = back.groupBy("rep").agg(F.min("node").alias("label"))
    named = back.join(least, "rep").select("node", "label")
    rest = alone.join(back.select("node"), "node", "left_anti").selectExpr("node", "node AS label")
    out = write(named.unionByName(rest))
    discard(back)
    return out
