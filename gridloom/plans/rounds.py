"""Tables between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of an Arrow batch that goes to Python.
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes too, so that a batch of large planes does not fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder is set only where the session names none, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gridloom-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again, which cuts its lineage and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
