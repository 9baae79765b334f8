"""Quality by importance resampling with hashed n-gram models.

Two generative models, one of target text (labelled good) and one of all raw
text, are bags of hashed n-grams: words, word pairs, and triples of word
shapes. A document's log importance weight is that of ``TOKENS`` words like
its own: the mean log ratio of its n-grams, drawn towards 0 by ``PRIOR`` words
of ratio 0, times ``TOKENS``. Sums over whole texts would be in the thousands,
where noise of a draw decides nothing. Documents are drawn without replacement
in proportion to their weights, by Gumbel top-k. Labels say how many, unless
the caller does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, small_batches, stored
from .words import Texts, blocks, pair, sums_by, words

#: Buckets of word, word-pair and shape-triple hashes; labelled rows used at most; seed of the draw.
WORD_BUCKETS, SHAPE_BUCKETS, LABELLED_ROWS, SEED = 1 << 14, 1 << 12, 20_000, 7
#: Words that a weight stands for, and words of ratio 0 that each text has besides its own.
TOKENS, PRIOR = 16, 20
#: Bins of a histogram of keys, and keys that may reach the driver at the end.
BINS, LAST = 4096, 10_000
_SIZES = (WORD_BUCKETS, WORD_BUCKETS, SHAPE_BUCKETS)
_STARTS = (0, WORD_BUCKETS, 2 * WORD_BUCKETS)
#: What stands for the log weight of a text without words, in keys.
_NO_WORDS = -1e12

_CLASS = np.full(256, 4, np.uint64)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x80:] = 3
_CLASS[[ord(c) for c in ".,;:?"]] = 5


def features(texts: Texts) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of each word's three n-grams, and where each text's words start."""
    w = words(texts)
    h = w.hashes()
    if not len(h):
        return [np.zeros(0, np.int64)] * 3, w.at
    doc = w.doc()

    def back(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(x), np.uint64)
        out[k:] = np.where(doc[k:] == doc[:-k], x[:-k], np.uint64(0)) if k < len(x) else out[k:]
        return out

    data, last = texts.data, w.end - 1
    # First, last and middle characters' classes, length up to 3, and whether the word before is the same.
    same = (back(h, 1) == h).astype(np.uint64)
    shape = _CLASS[data[w.start]] + 6 * (_CLASS[data[last]] + 6 * (_CLASS[data[(w.start + w.end) // 2]] + 6 * (np.minimum(w.end - w.start, 3).astype(np.uint64) * 2 + same)))
    shape = shape.astype(np.uint64) + np.uint64(1)
    triple = pair(pair(back(shape, 2), back(shape, 1), 2), shape, 3)
    ids = [h % np.uint64(WORD_BUCKETS), pair(back(h, 1), h, 1) % np.uint64(WORD_BUCKETS), triple % np.uint64(SHAPE_BUCKETS)]
    return [x.astype(np.int64) + s for x, s in zip(ids, _STARTS, strict=True)], w.at


def _counter(batches):
    counts = np.zeros((2, sum(_SIZES)), np.int64)
    for b in batches:
        good = np.asarray(b.column(1).to_pylist(), dtype=object) == 1
        for t in blocks(b.column(0)):
            ids, at = features(t)
            wanted = np.repeat(good[t.first : t.first + len(t)], np.diff(at))
            for x in ids:
                counts[0] += np.bincount(x, minlength=counts.shape[1])
                counts[1] += np.bincount(x[wanted], minlength=counts.shape[1])
    kind, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(bucket), pa.array(counts[kind, bucket])], names=["kind", "bucket", "n"])


def _ratios(counts: np.ndarray) -> np.ndarray:
    """log p(target) - log p(raw) of each bucket, with half a count added in each."""
    out = np.zeros(counts.shape[1])
    for s, n in zip(_STARTS, _SIZES, strict=True):
        raw, target = (counts[k, s : s + n] + 0.5 for k in (0, 1))
        out[s : s + n] = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return out


def _scorer(ratios: np.ndarray):
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        out = np.full(len(text), np.nan)
        for t in blocks(text):
            ids, at = features(t)
            n = np.diff(at)
            total = sums_by(at, sum((ratios[x] for x in ids), np.zeros(len(ids[0]))))
            out[t.first : t.first + len(t)] = np.where(n > 0, TOKENS * total / (n + PRIOR), np.nan)
        return pa.array(out, mask=np.isnan(out))

    return score


def _cut(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The log weight that splits labelled texts with the fewest errors, in the middle of its gap; x ascending, with counts of each kind."""
    if not bad.sum():
        return -math.inf
    if not good.sum():
        return math.inf
    errors = np.concatenate([[0], np.cumsum(good)]) + bad.sum() - np.concatenate([[0], np.cumsum(bad)])
    at = int(errors.argmin())
    if at in (0, len(x)):
        return -math.inf if at == 0 else math.inf
    return float((x[at - 1] + x[at]) / 2)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the one column of ``keys``, by histograms of ever smaller ranges; -inf if there are fewer.

    A round sends ``BINS`` counts to the driver at most, the last one ``LAST``
    values with their counts.
    """
    c = F.col(keys.columns[0])
    low, high, count = keys.agg(F.min(c), F.max(c), F.count(c)).first()
    if count < k:
        return -math.inf
    above = 0
    while True:
        inside = keys.where((c >= low) & (c <= high))
        step = (high - low) / BINS
        if count <= LAST or not low + step > low:
            for value, n in inside.groupBy(c).count().orderBy(c.desc()).collect():
                above += n
                if above >= k:
                    return value
        place = F.least(F.floor((c - low) / step), F.lit(BINS - 1)).cast("int").alias("bin")
        for _, n, low, high in sorted(inside.groupBy(place).agg(F.count("*"), F.min(c), F.max(c)).collect(), reverse=True):
            if above + n >= k:
                count = n
                break
            above += n


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", count: int | None = None, labelled_rows: int = LABELLED_ROWS, seed: int = SEED) -> DataFrame:
    """``docs`` with a struct ``importance``: log_weight, gumbel_key, drawn (a column of that name is replaced).

    ``labels`` has the id and ``quality`` (1 good, 0 not); at most
    ``labelled_rows`` of them, those with the least hashes, train the target
    model and the default count. A text's log weight is ``TOKENS`` times the
    mean, shrunk by ``PRIOR`` words, of the log ratios of its n-grams, log
    p(target) - log p(raw); ``count`` rows with the
    highest log weight plus Gumbel noise are drawn, which is a draw without
    replacement in proportion to the weights. By default as many are drawn as
    have a weight above the one that best splits labelled rows: all without
    bad labels, none without good ones. Raw counts, weights and the draw cover
    all rows. Null or blank texts have a null weight and are not drawn by
    default, else last; rows equal in id and text have one key and are drawn
    together, even beyond ``count``; very long texts are read whole. An empty
    table gives an empty one.
    """
    small_batches(docs.sparkSession)
    sample = labels.where(f"`{doc_id}` is not null and quality in (0, 1)").groupBy(doc_id).agg(F.max("quality").cast("int").alias("_good"))
    sample = settle(sample.orderBy(F.xxhash64(doc_id), doc_id).limit(labelled_rows).select(F.col(doc_id).alias("_labelled"), "_good"))
    slim = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("_id"))
    # The sample has at most labelled_rows rows of two numbers.
    marked = slim.join(F.broadcast(sample), slim["_id"] == sample["_labelled"], "left")
    summed = marked.select("_text", "_good").mapInArrow(_counter, "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, sum(_SIZES)), np.int64)
    for r in summed.collect():  # at most two rows for each bucket
        counts[r[0], r[1]] = r[2]
    weight = _scorer(_ratios(counts))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 11).cast("double") + 0.5) / float(1 << 53)
    key = F.coalesce(F.col("_w"), F.lit(_NO_WORDS)) - F.log(-F.log(uniform))
    scored = stored(docs.select(weight(F.col(text)).alias("_w"), F.col(doc_id), F.col(text)).select("_w", key.alias("_key"), F.col(doc_id).alias("_id")))
    known = scored.join(F.broadcast(sample), scored["_id"] == sample["_labelled"]).where("_w is not null")
    got = known.groupBy(F.round("_w", 6).alias("x")).agg(F.sum("_good").alias("g"), F.count("*").alias("n")).orderBy(F.xxhash64("x")).limit(labelled_rows).collect()
    x, good, every = (np.array([r[k] for r in sorted(got)], float) for k in range(3))
    cut = _cut(x, good, every - good)
    wanted = count if count is not None else scored.where(F.col("_w") >= cut).count()
    least = kth_largest(scored.select("_key"), wanted) if wanted > 0 else math.inf
    again = weight(F.col(text))
    return docs.withColumn("importance", again).withColumn("importance", F.struct(F.col("importance").alias("log_weight"), (F.coalesce("importance", F.lit(_NO_WORDS)) - F.log(-F.log(uniform))).alias("gumbel_key"))).withColumn("importance", F.struct("importance.*", (F.col("importance.gumbel_key") >= least).alias("drawn")))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs`` with its own columns; documents that are not drawn go."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    given = {"text": "text", "doc_id": "doc_id"} | options
    place = {c: n for c, n in zip(docs.columns, names, strict=True)}
    renamed = labels.withColumnRenamed(given["doc_id"], place[given["doc_id"]])
    out = resample(plain, renamed, **(options | {"text": place[given["text"]], "doc_id": place[given["doc_id"]]}))
    return out.where("importance.drawn").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
