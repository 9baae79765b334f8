"""What operators share: settled and scratch tables, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Most bytes of an Arrow batch that goes to Python.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes too, so that long texts do not fill buffers outside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(ARROW_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it has fewer partitions, as one small file has; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside remove their shuffle files when they end, not when the driver's garbage is collected; a session that has a setting for it keeps that."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if name in spark.conf.getAll:
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share.

    The folder is the session's spark.checkpoint.dir; a local one is set only
    where the session names none, as in tests.
    """
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(True)  # planned anew, so that the setting holds for it


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share; see ``settle``."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that writes a table and gives it back as read; at the end the tables are dropped, so that no result may read them."""
    tables: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        tables.append(f"gridloom_{uuid.uuid4().hex}")
        spark.catalog.createTable(tables[-1], source="parquet", schema=df.schema)
        with shuffles_removed(spark):  # which does not reach the query inside saveAsTable
            df.write.insertInto(tables[-1])
        return spark.table(tables[-1])

    try:
        yield keep
    finally:
        for table in tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[str], by: str | None = None) -> DataFrame:
    """``df`` with ``_rank``: each row's place from 0 in ``order`` (nulls first), within ``by`` if given.

    One range sort gives places inside each partition, and running counts of
    the partitions the rest; no task holds more than its own range.
    """
    keys = [by, *order] if by else order
    sorted_ = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = settle(sorted_.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    group = [F.col(by)] if by else [F.lit(0).alias("_all")]
    runs = placed.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    name = by or "_all"
    before = F.coalesce(F.sum("_n").over(W.partitionBy(name).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*([by] if by else []), "_part", "_first", before.alias("_before"))
    joined = placed.join(runs, [*([by] if by else []), "_part"])
    return joined.withColumn("_rank", F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_first", "_before")


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node reached.

    Alternates large-star and small-star steps until the edges stay the same,
    in a number of rounds that grows with the logarithm of the longest path.
    Each step joins edges with one minimum per node, so that a node with many
    neighbours is split like any skewed join; every round is settled.
    """

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = mark(e)
    for _ in range(most_rounds if seen[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))).where("u <> v").distinct()
        e = settle(small)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
