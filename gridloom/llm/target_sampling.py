"""Importance resampling towards a target distribution over hashed n-grams.

Documents become a sparse document-by-bucket count matrix, written once as
CSR blocks, a row for each run of documents of about 1 MB of text. Its column
sums give the raw distribution, those of the target's matrix the target's;
gains are log ratios of the two as whole numbers, and weights the matrix times
the gains. Gumbel noise from a hash of the id makes the draw.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mail import pack, unpack
from .shared import ranked, small_batches, stored
from .words import Texts, blocks, sums_by, words

#: Buckets, words of a feature at most, words of a document that can be drawn, per cent drawn, seed.
BUCKETS, MAX_N, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes up to which features are hashed side by side.
_SHORT = 64

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of data[start[i]:end[i]] for each i: byte by byte for all at once, longest first."""
    size = end - start
    out = np.empty(len(start), np.uint32)
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    short = np.flatnonzero(size <= _SHORT)
    order = short[np.argsort(_SHORT - size[short].astype(np.uint8), kind="stable")]
    at, state = start[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    longer = len(order) - np.cumsum(np.bincount(size[order], minlength=_SHORT + 1))
    for k in range(_SHORT):
        n = int(longer[k])
        if not n:
            break
        part = state[:n]
        state[:n] = _TABLE[(part ^ data[at[:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[order] = ~state
    return out


def counted(texts: Texts, buckets: int = BUCKETS, max_n: int = MAX_N) -> dict[str, np.ndarray]:
    """CSR arrays of a block of texts: indptr, indices and data, and the words of each text."""
    w = words(Texts(_FOLD[texts.data], texts.at, texts.first))
    data, start, end = w.joined()
    doc = w.doc()
    keys = []
    for n in range(1, max_n + 1):
        if len(doc) < n:
            break
        inside = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        keys.append(doc[inside] * buckets + crc32(data, start[inside], end[inside + n - 1]).astype(np.int64) % buckets)
    key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    size = np.uint16 if buckets <= 1 << 16 else np.uint32
    return {"indptr": np.searchsorted(key, np.arange(len(texts) + 1) * buckets).astype(np.uint32), "indices": (key % buckets).astype(size), "data": count.astype(np.uint32), "words": w.counts.astype(np.int64)}


def count_matrix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int = BUCKETS, max_n: int = MAX_N) -> DataFrame:
    """(ids array, csr binary): the count matrix in the shared folder, a row for each block of documents; a null text has no words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in blocks(b.column(1)):
                ids = b.column(0).slice(t.first, len(t))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.concat_arrays([ids])), pa.array([pack(**counted(t, buckets, max_n))], pa.binary())], names=["ids", "csr"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return stored(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"ids array<{kind}>, csr binary"))


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all documents: tasks add up their own blocks, and ``buckets`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for csr in b.column("csr"):
                m = unpack(csr.as_py())
                total += np.bincount(m["indices"], m["data"], buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in matrix.select("csr").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p(target) / p(raw))) of each bucket, one count added in each."""
    buckets, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix times the gains."""
    kind = matrix.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, csr in zip(b.column("ids"), b.column("csr"), strict=True):
                m = unpack(csr.as_py())
                at, data = m["indptr"].astype(np.int64), m["data"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(m["words"]), pa.array(sums_by(at, data)), pa.array(sums_by(at, data * gain[m["indices"]]))], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256(``seed:doc_id``); a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", target_id: str = "item_id", buckets: int = BUCKETS, max_n: int = MAX_N, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank counts the drawn ones from 1, others have null.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in
    lower case; features are all runs of 1 to ``max_n`` words. Of the
    documents with ``least_words`` or more, ``percent`` per cent (rounded down) with
    the highest weight plus noise are drawn, ties by smaller id, null ids
    first. Null, empty and wordless texts have weight 0 and are not drawn;
    rows that repeat, also in id, are each a document; other columns are not
    read. An empty target has the same share in each bucket; no documents give
    no rows. Texts are counted whole.
    """
    matrix = count_matrix(docs, text, doc_id, buckets, max_n)
    gain = gains(column_sums(matrix, buckets), column_sums(count_matrix(target, target_text, target_id, buckets, max_n), buckets))
    out = weighted(matrix, gain)
    out = stored(out.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")))
    can = F.col("n_words") >= least_words
    count = out.where(can).count()
    wanted = count * percent // 100
    # Only rows from a lower bound of the last drawn score on are sorted; the bound is checked.
    bound = out.where(can).agg(F.percentile_approx("score", max(0.0, 1 - (percent + 1) / 100), 10_000)).first()[0] if wanted else None
    if bound is not None and out.where(can & (F.col("score") >= bound)).count() < wanted:
        bound = None
    high = F.col("score") >= bound if bound is not None else F.lit(True)
    placed = ranked(out.where(can & high).withColumn("_down", -F.col("score")), ["_down", "doc_id"]).withColumn("rank", F.when(F.col("_rank") < wanted, F.col("_rank") + 1)).drop("_rank", "_down")
    rest = out.where(~(can & high)).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*rest.columns).unionByName(rest).withColumnRenamed("doc_id", doc_id)


def drawn(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` that are drawn, with their own columns; rows of one id go together, if any of them is drawn."""
    chosen = resample(docs, target, text, doc_id, **options).where("rank is not null").select(F.col(doc_id).alias("_chosen")).distinct()
    return docs.join(chosen, F.col(doc_id).eqNullSafe(F.col("_chosen")), "left_semi")


def oracle_sql() -> str:
    """DuckDB SQL of the query; crc32 as a fold over the bytes of distinct words."""
    split = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"""
with steps as materialized (
  select list(list_reduce(list_prepend(cast(i as bigint), cast(range(8) as bigint[])), lambda c, k: {step}) order by i) as t from range(256) r(i)
), docs as materialized (select row_number() over () as r, doc_id, {split} as w from documents
), aims as (select {split} as w from benchmark
), used as materialized (select 1 as kind, r, unnest(w) as word from docs union all select 2, 0, unnest(w) from aims
), distinct_words as (select word, hex(encode(word)) as x from (select distinct word from used)
), hashed as materialized (
  select word, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(len(x) // 2), lambda i: cast('0x' || x[2 * i + 1 : 2 * i + 2] as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % {BUCKETS} as bucket
  from distinct_words, steps
), sums as (
  select bucket, count(*) filter (kind = 1) as s, count(*) filter (kind = 2) as t from used join hashed using (word) group by bucket
), gained as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from sums) + {BUCKETS}) / ((s + 1)::double * ((select sum(t) from sums) + {BUCKETS})))) as gain from sums
), scored as (
  select r, cast(sum(gain) as bigint) as weight from used join hashed using (word) join gained using (bucket) where kind = 1 group by r
), every as (
  select doc_id, len(w) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || sha256('{SEED}:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) + 0.5::double) / 4294967296))) as bigint) as score
  from docs left join scored using (r)
), placed as (
  select *, row_number() over (order by case when n_features >= {LEAST_WORDS} then 0 else 1 end, score desc, doc_id nulls first) as place from every
)
select doc_id, cast(n_features as bigint) as n_features, weight, score,
       case when n_features >= {LEAST_WORDS} and place <= {PERCENT} * (select count(*) from every where n_features >= {LEAST_WORDS}) // 100 then place end as rank
from placed
"""
