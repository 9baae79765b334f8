"""Packing into optimal length buckets and token-budget batches.

Sequences are padded to the boundary of their bucket. A global histogram of
lengths (at most ``max_len`` bins, whatever the data) goes to the driver,
where dynamic programming finds the boundaries with the least padding. Ranks
inside each bucket come from one range sort, and cut it into batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ranked, settle

#: Longest sequence, buckets, and tokens of a batch with its padding.
MAX_LEN, BUCKETS, BATCH_TOKENS = 4096, 16, 65_536


def token_count(text: str = "text") -> Column:
    """Words of the text and one end mark; a null text has the end mark alone."""
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` ascending boundaries, the last the longest length, that leave the least padding.

    Among equal ones, each boundary from the longest down is followed by the smallest possible next.
    """
    if not lengths:
        return []
    m = len(lengths)
    size = np.asarray(lengths, np.int64)
    before = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    # Padding is the sum of boundary times count, less all tokens, which is the same for any choice.
    best = size * before[1:]
    chosen = []
    for _ in range(1, min(buckets, m)):
        came = np.full(m, -1, np.int64)
        new = best.copy()
        for j in range(1, m):
            cost = best[:j] + size[j] * (before[j + 1] - before[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], came[j] = cost[i], i
        chosen.append(came)
        best = new
    at, out = m - 1, [m - 1]
    for came in reversed(chosen):
        if came[at] >= 0:
            at = int(came[at])
            out.append(at)
    return [int(size[i]) for i in reversed(out)]


def pack(docs: DataFrame, key: str = "doc_id", n_tokens: str | Column = "n_tokens", max_len: int = MAX_LEN, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """key, piece, n_tokens, bucket, bucket_len, batch, slot: where each sequence goes.

    A document longer than ``max_len`` is cut into pieces of that length and a
    rest; no token is dropped. A bucket's batches take max(1, batch_tokens //
    bucket_len) sequences each, in the order of key (nulls first), piece and
    length; equal rows keep a place each. An empty table packs to nothing, and
    a null or negative length counts as 0.
    """
    n = F.greatest(F.coalesce(F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens, F.lit(0)).cast("long"), F.lit(0))
    whole = docs.select(F.col(key).alias("_key"), n.alias("_all"))
    pieces = whole.select("_key", "_all", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_all") / max_len) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.select("_key", "piece", F.least(F.lit(max_len), F.col("_all") - F.col("piece").cast("long") * max_len).alias("n_tokens"))
    pieces = settle(pieces)
    histogram = sorted((r[0], r[1]) for r in pieces.groupBy("n_tokens").count().collect())
    bounds = best_boundaries([x for x, _ in histogram], [c for _, c in histogram], buckets) or [0]
    places = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("n_tokens")))
    length = F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1).cast("long")
    fits = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest(length, F.lit(1)))).cast("long")
    placed = ranked(pieces.withColumn("bucket", places), ["_key", "piece", "n_tokens"], "bucket")
    return placed.select(F.col("_key").alias(key), "piece", "n_tokens", "bucket", length.alias("bucket_len"), F.floor(F.col("_rank") / fits).cast("long").alias("batch"), F.pmod("_rank", fits).cast("long").alias("slot"))
