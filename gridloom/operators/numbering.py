"""Places of rows in an order, without a task that holds all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.rounds import stored


def numbered(df: DataFrame, by: str, order: str, name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 0, among the rows of its ``by`` in the order of ``order``.

    One range sort gives places inside each partition; running counts of
    partitions, a row for each and each group in it, give the rest.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(parts, by, order).sortWithinPartitions(by, order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    runs = rows.groupBy(by, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"))
    met = rows.join(runs, rows[by].eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    return met.withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_part", "_by", "_of", "_shift")
