"""Exact top-k inner-product search by distributed histogram selection.

Every round scores all vectors against all queries in a grid of blocks and
counts each query's scores in equal bins. The bin that holds the k-th largest
score becomes the next round's range, until bins are one integer wide: then
the k-th value is known, a last pass keeps what reaches it, and ties go to
the smaller id. A task counts only from the top down to its own k-th score,
below which the global k-th score cannot lie, so that a query gets at most k
bins from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settle, shuffle_partitions, small_batches

#: Queries of a block, candidates scored at once, and bins of a histogram.
QUERY_BLOCK, CANDIDATE_BLOCK, BINS = 1024, 1024, 1024
_LOWEST = -(1 << 62)


def quantised(column: str | Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as long; null if the vector is null or has a null or non-finite one."""
    c = F.col(column) if isinstance(column, str) else column
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(c, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, short ones filled with zeros."""
    at = np.asarray(column.offsets, np.int64)
    flat = np.asarray(column.values, np.int64)
    out = np.zeros((len(column), dim), np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(at))
    out[row, np.arange(at[0], at[-1]) - at[row]] = flat[at[0] : at[-1]]
    return out


def _grid(queries: DataFrame, vectors: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Each query block beside each part of the vectors, the queries first."""
    parts_of = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    blocks_of = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    q = queries.select("block", parts_of, F.lit(0).alias("kind"), F.col("slot").alias("id"), F.col("query_id").alias("own"), "vector", "low", "width")
    none = F.lit(None).cast("long")
    c = vectors.select(blocks_of, F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int").alias("part"), F.when(F.col("vec_id").isNull(), 2).otherwise(1).alias("kind"), F.coalesce("vec_id", F.lit(0)).alias("id"), none.alias("own"), "vector", none.alias("low"), none.alias("width"))
    return q.unionByName(c).repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "kind", "id")


class _Pass:
    """Streams sorted grid rows: holds one block of queries, scores candidates against it."""

    def __init__(self, k: int, dim: int, exact_double: bool, last: bool):
        self.k, self.dim, self.last, self.kind = k, dim, last, np.float64 if exact_double else np.int64

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for b in batches:
            block, part, kind = (np.asarray(b.column(n)) for n in ("block", "part", "kind"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if lo == hi:
                    continue
                if here != (block[lo], part[lo]):
                    if here is not None:
                        yield from self.done(here[0])
                    here, held, self.q = (block[lo], part[lo]), [], None
                if kind[lo] == 0:
                    held.append(b.slice(lo, hi - lo))
                else:
                    if self.q is None:
                        self.start(held)
                    for at in range(lo, hi, CANDIDATE_BLOCK):
                        self.score(b.slice(at, min(CANDIDATE_BLOCK, hi - at)), kind[lo] == 2)
        if here is not None:
            yield from self.done(here[0])

    def start(self, held: list[pa.RecordBatch]) -> None:
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        self.q = _matrix(t.column("vector"), self.dim).astype(self.kind)
        self.slot, self.own, self.low, self.width = (np.asarray(t.column(n)) for n in ("id", "own", "low", "width"))
        self.bins = np.zeros((len(self.slot), BINS), np.int64)
        self.best = [np.zeros(0, np.int64)] * 4
        self.met = np.zeros(len(self.slot), bool)

    def others(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Which candidates are not the query's own row: of the rows with its id and vector, which all come to one task, one is."""
        mine = np.ones((len(self.slot), len(ids)), bool)
        for row, col in np.argwhere(self.own[:, None] == ids[None, :]):
            if not self.met[row] and (self.q[row] == vectors[col]).all():
                self.met[row], mine[row, col] = True, False
        return mine

    def score(self, c: pa.RecordBatch, nameless: bool) -> None:
        if self.q is None:
            return
        ids = np.asarray(c.column("id"))
        vectors = _matrix(c.column("vector"), self.dim).astype(self.kind)
        s = (self.q @ vectors.T).astype(np.int64)
        mine = np.ones(s.shape, bool) if nameless else self.others(ids, vectors)
        if self.last:
            row, col = np.nonzero((s >= self.low[:, None]) & mine)
            found = (row, s[row, col], ids[col], np.full(len(row), int(nameless)))
            row, value, vec, none = (np.concatenate(x) for x in zip(self.best, found, strict=True))
            order = np.lexsort((vec, none, -value, row))
            order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < self.k]
            self.best = [row[order], value[order], vec[order], none[order]]
        else:
            n = (s - self.low[:, None]) // self.width[:, None]
            row, col = np.nonzero((n >= 0) & (n < BINS) & mine)
            self.bins += np.bincount(row * BINS + n[row, col], minlength=self.bins.size).reshape(self.bins.shape)

    def done(self, block: int) -> Iterator[pa.RecordBatch]:
        if self.q is None:
            return
        if self.last:
            row, value, vec, none = self.best
            yield pa.RecordBatch.from_arrays([pa.array(self.slot[row]), pa.array(vec, mask=none > 0), pa.array(value)], names=["slot", "vec_id", "score"])
            return
        above = self.bins[:, ::-1].cumsum(1)[:, ::-1] - self.bins
        row, col = np.nonzero((self.bins > 0) & (above < self.k))
        yield pa.RecordBatch.from_arrays([pa.array(self.slot[row]), pa.array(col), pa.array(self.bins[row, col])], names=["slot", "bin", "n"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    ``vectors`` (vec_id long, vector array<long>) and ``queries`` (query_id
    long, vector). One row with the query's id and vector, its own, is no
    candidate, others of its id are; ties go to the smaller vec_id, a null one
    last; fewer than k candidates are all returned. Rows with a null vector
    take no part, nor do queries with a null id; missing components of a shorter vector
    count as 0. Equal rows are candidates each; a query that repeats is
    answered for each row. Scores wrap as 64-bit integers where they do not
    fit in one, which a squared length below 2**62 rules out.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    vectors = vectors.where("vector is not null").select("vec_id", "vector")
    queries = queries.where("query_id is not null and vector is not null").select("query_id", "vector")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most, dim = vectors.agg(F.max(square), F.max(F.size("vector"))).first()
    asked, q_dim, count = queries.agg(F.max(square), F.max(F.size("vector")), F.count("*")).first()
    most, dim = max(most or 0.0, asked or 0.0), max(dim or 0, q_dim or 0, 1)
    reach = min(int(most) + 1, 1 << 61)
    blocks = max(1, -(-count // QUERY_BLOCK))
    parts = max(1, shuffle_partitions(spark) // blocks)
    numbered = queries.withColumn("slot", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("slot"), F.lit(blocks)).cast("int"))
    width = 1  # always a power of BINS, so that a round's bins fill the last one's bin exactly
    while width * BINS < 2 * reach + 1:
        width *= BINS
    state = settle(numbered.withColumns({"low": F.lit(-reach).cast("long"), "width": F.lit(width).cast("long"), "above": F.lit(0).cast("long")}))
    exact = most < 1 << 53
    while True:
        counted = _grid(state, vectors, blocks, parts).mapInArrow(_Pass(k, dim, exact, False).run, "slot long, bin long, n long")
        counted = counted.groupBy("slot", "bin").agg(F.sum("n").alias("n"))
        down = counted.withColumn("reached", F.sum("n").over(W.partitionBy("slot").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)))
        full = down.join(state.select("slot", "above"), "slot").where(F.col("reached") + F.col("above") >= k)
        found = full.groupBy("slot").agg(F.max_by(F.struct("bin", (F.col("reached") - F.col("n")).alias("over")), "bin").alias("at"))
        low = F.when(F.col("at").isNull(), F.lit(_LOWEST)).otherwise(F.col("low") + F.col("at.bin") * F.col("width"))
        after = max(1, width // BINS)
        joined = state.join(found, "slot", "left").select("query_id", "vector", "slot", "block", low.cast("long").alias("low"), F.lit(after).cast("long").alias("width"), (F.col("above") + F.coalesce("at.over", F.lit(0))).alias("above"))
        state = settle(joined)
        if width == 1:
            break
        width = after
    kept = _grid(state, vectors, blocks, parts).mapInArrow(_Pass(k, dim, exact, True).run, "slot long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    best = kept.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(state.select("slot", "query_id"), "slot").select("query_id", "rank", "vec_id", "score")
