"""Work that can be called off."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts inside bear ``tag``."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops all running jobs with ``tag``: who waits for them gets an error, and their tasks end."""
    spark.sparkContext.cancelJobsWithTag(tag)
