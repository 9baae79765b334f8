"""Rounds of packed messages between blocks of documents and shards of keys.

Documents are written once as a table bucketed by block, a run of at most
``block_bytes`` bytes of text (or one longer document). In a round every block
sends each shard one packed message about its own keys, sorted and without
repeats, so that a hot key costs a block one entry; a shard merges the
messages it gets and answers each block; the next round finds a block and its
answers together without another shuffle of the texts.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle, shuffle_partitions, small_batches
from .words import blocks

#: Bytes of text of a block.
BLOCK_BYTES = 1 << 21
MESSAGE = "shard int, block long, payload binary"
_codec = pa.Codec("zstd", compression_level=1)


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; integers are split in byte planes."""
    head, parts = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head.append(f"{name}:{a.dtype.str}:{len(a)}")
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    top = ",".join(head).encode()
    raw = len(top).to_bytes(4, "little") + top + b"".join(parts)
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    """The inverse of ``pack``."""
    raw = _codec.decompress(payload[8:], int.from_bytes(payload[:8], "little"), asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, {}
    for item in raw[4:at].decode().split(","):
        name, kind, size = item.split(":")
        kind, size = np.dtype(kind), int(size)
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        at += size * kind.itemsize
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of an ascending array of uint64, the first from 0."""
    return np.diff(x, prepend=np.uint64(0)) if len(x) else x.astype(np.uint64)


def undo_deltas(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x.astype(np.uint64), dtype=np.uint64)


def by_shard(key: np.ndarray, shards: int, bits: int = 64) -> np.ndarray:
    """Cuts of ascending ``bits``-bit keys into equal ranges: shard s has keys cut[s]:cut[s + 1]."""
    edges = np.array([(s << bits) // shards for s in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(key, edges), [len(key)]]).astype(np.int64)


_tables: dict[str, SparkSession] = {}


def release(tables: set[str] | None = None) -> None:
    """Drops the given tables, or all that operators of this process have left."""
    for table in list(_tables) if tables is None else tables:
        with contextlib.suppress(Exception):  # the session may be gone at exit
            _tables[table].sql(f"DROP TABLE IF EXISTS {table}")
        _tables.pop(table, None)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Drops at its end the tables that operators made inside; earlier results keep theirs."""
    before = set(_tables)
    try:
        yield
    finally:
        release(set(_tables) - before)


atexit.register(release)


class Corpus:
    """Documents bucketed by block, in a table that stays until ``release``: results read it when they are asked for."""

    def __init__(self, docs: DataFrame, text: str, columns: list[str], block_bytes: int = BLOCK_BYTES):
        """``columns`` are kept as c0, c1, ...; the text (null: null) as text."""
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.buckets = shuffle_partitions(self.spark)
        self.table = f"gridloom_{uuid.uuid4().hex}"
        cut = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)), F.col(text).alias("text"))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId() << 32
            for b in batches:
                for t in blocks(b.column(b.num_columns - 1), block_bytes):
                    piece = b.slice(t.first, len(t))
                    block += 1
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.full(len(t), block))], names=[*b.schema.names, "block"])

        _tables[self.table] = self.spark
        numbered = cut.mapInArrow(number, f"{fields}, block long")
        # Texts are most of what a round keeps on disk, and zstd takes two thirds of the room that the default codec does.
        numbered.write.bucketBy(self.buckets, "block").sortBy("block").option("compression", "zstd").format("parquet").saveAsTable(self.table)
        self.rows = self.spark.table(self.table)
        size = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.bytes = int(size)
        self._none = self.spark.createDataFrame([], "block long, turn int, shard int, payload binary")

    def each(self, work: Callable[[pa.Table, list[dict[int, bytes]]], pa.Table], schema: str, *answers: DataFrame) -> DataFrame:
        """work(documents, answers of each round by shard) for every block."""
        turns = len(answers)
        names = [p.split()[0] for p in schema.split(", ")]

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            got: list[dict[int, bytes]] = [{} for _ in range(turns)]
            for turn, shard, payload in zip(right["turn"].to_pylist(), right["shard"].to_pylist(), right["payload"].to_pylist(), strict=True):
                got[turn][shard] = payload
            return work(left.combine_chunks(), got).select(names)

        mail = self._none
        for k, a in enumerate(answers):
            mail = mail.unionByName(a.where("block >= 0").select("block", F.lit(k).alias("turn"), "shard", "payload"))
        return self.rows.groupBy("block").cogroup(mail.groupBy("block")).applyInArrow(one, schema)

def answered(messages: DataFrame, work: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """(block, shard, payload): work(shard, payloads in the order of blocks) for each shard, settled.

    One payload more than there are blocks is a note of the shard, with block -1.
    """

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        replies = work(t["shard"][0].as_py(), t["payload"].to_pylist())
        extra = len(replies) - t.num_rows
        return pa.table({"block": pa.array([*t["block"].to_pylist(), *[-1] * extra], pa.int64()), "shard": pa.array([t["shard"][0].as_py()] * len(replies), pa.int32()), "payload": pa.array(replies, pa.binary())})

    return settle(messages.groupBy("shard").applyInArrow(one, "block long, shard int, payload binary"))


def crc32(ids: list) -> np.ndarray:
    """crc32 of each id as text; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.uint32)


def messages(block: int, cuts: np.ndarray, make: Callable[[int, int], bytes]) -> pa.Table:
    """A message to every shard that has keys: make(first, last)."""
    full = [s for s in range(len(cuts) - 1) if cuts[s] < cuts[s + 1]]
    return pa.table({"shard": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int64()), "payload": pa.array([make(cuts[s], cuts[s + 1]) for s in full], pa.binary())})


__all__ = ["BLOCK_BYTES", "MESSAGE", "Corpus", "answered", "by_shard", "crc32", "deltas", "messages", "pack", "release", "released", "undo_deltas", "unpack"]
