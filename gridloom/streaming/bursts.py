"""Bursts put together from frames as they arrive.

State holds the frames of each open burst and channel. A burst closes when all
the frames it says it has are there, or ``wait_ms`` after its first one; then
its frames go out together, for ``fuse_burst`` to take from the sink's table. A frame that comes twice, or after its burst has closed, is late
and goes out marked so; closed bursts are remembered for ``keep_ms`` more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAME = "frame int, w int, h int, v array<double>"
OUT = "burst_id string, c int, frame int, w int, h int, v array<double>, late boolean"


def _out(key: tuple, frame: int, w: int, h: int, v: list[float], late: bool) -> Row:
    return Row(burst_id=key[0], c=key[1], frame=frame, w=w, h=h, v=list(v), late=late)


class Collector(StatefulProcessor):
    """Frames of one (burst_id, c); see the module."""

    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", FRAME)
        self.closed = handle.getValueState("closed", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        held = [tuple(r) for r in self.frames.get()] if self.frames.exists() else []
        opened, known, wanted = bool(held), {r[0] for r in held}, None
        done = self.closed.exists()
        fresh = []
        for r in sorted(rows, key=lambda r: r["frame"]):
            one = (r["frame"], r["w"], r["h"], list(r["v"]))
            if done or one[0] in known:
                yield _out(key, *one, True)
                continue
            known.add(one[0])
            fresh.append(one)
            wanted = r["n_frames"] if r["n_frames"] is not None else wanted
        if done:
            return
        for one in fresh:
            self.frames.appendValue(one)
        if wanted is not None and len(known) >= wanted:
            yield from self._close(key, timerValues, held + fresh)
        elif fresh and not opened:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803  Spark's names
        if self.closed.exists():
            self.closed.clear()  # the burst is forgotten
        elif self.frames.exists():
            yield from self._close(key, timerValues, [tuple(r) for r in self.frames.get()])

    def _close(self, key, timers, frames: list[tuple]) -> Iterator[Row]:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        now = timers.getCurrentProcessingTimeInMs()
        self.frames.clear()
        self.closed.update((now,))
        self.handle.registerTimer(now + self.keep_ms)
        for f in sorted(frames, key=lambda f: f[0]):
            yield _out(key, *f, False)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def collected(frames: DataFrame, wait_ms: int = 60_000, keep_ms: int = 600_000) -> DataFrame:
    """Rows ``OUT`` of a stream of frames (burst_id string, frame, c, w, h, v, n_frames): bursts as they close, and late frames."""
    use_rocksdb(frames.sparkSession)
    return frames.groupBy("burst_id", "c").transformWithState(statefulProcessor=Collector(wait_ms, keep_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of frames from Parquet files that arrive in a folder."""
    return spark.readStream.schema("burst_id string, frame int, c int, w int, h int, v array<double>, n_frames int").parquet(folder).where(F.col("frame").isNotNull())
