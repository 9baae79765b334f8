"""Document fingerprints by one-permutation MinHash.

Every 5-word shingle of a text is hashed once; the top bits of the hash pick
a bin, which keeps its least value. Empty bins are filled by optimal
densification: bin i takes the value of the first non-empty bin in an order of
its own, random and the same for all texts. Each value
is mixed with its bin's number, so that a value that fills many bins has
other bits in each; the lowest ``BITS`` bits of that are packed. A comparison
takes off the share of bins that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions, small_batches
from .words import blocks, mix, pair, words

#: Bins (a power of 2), packed bits of each, words of a shingle, first probes.
BINS, BITS, SHINGLE_WORDS, PROBES = 512, 4, 5, 12
_MOST = np.uint64((1 << 64) - 1)
#: What each bin adds to its value before the lowest bits are taken.
_OWN = np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
#: Documents that are worked on at once.
_ROWS = 256


def shingle_hashes(w, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word shingles of a block and the text of each; a shorter text has one of all its words."""
    h, n = w.hashes(), w.counts
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.cumsum(count) - count
    first = np.arange(len(doc)) - at[doc] + w.at[doc]
    out = np.full(len(doc), np.uint64(size))
    for k in range(size):
        inside = k < n[doc]
        out = np.where(inside, pair(out, h[np.where(inside, first + k, 0)], 1), out) if len(h) else out
    return out, doc


def _probes() -> tuple[np.ndarray, np.ndarray]:
    """The order in which each bin tries all bins, and where each stands in it."""
    draws = mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)).reshape(BINS, BINS)
    order = draws.argsort(1, kind="stable")
    return order.astype(np.int64), order.argsort(1).astype(np.int64)


_ORDER, _PLACE = _probes()


def _densify(least: np.ndarray, full: np.ndarray, bins: int = BINS) -> None:
    """Fills the empty ones of the first ``bins`` bins of every row that has a full one."""
    row, col = np.nonzero(~full[:, :bins] & full.any(1)[:, None])
    for step in range(PROBES):
        if not len(row):
            return
        to = _ORDER[col, step]
        hit = full[row, to]
        least[row[hit], col[hit]] = least[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    # What is left is in rows with few full bins: the first of those in each bin's order.
    cuts = np.flatnonzero(np.diff(row)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(row)], strict=True):
        if lo < hi:
            some = np.flatnonzero(full[row[lo]])
            cols = col[lo:hi]
            least[row[lo], cols] = least[row[lo], some[_PLACE[cols[:, None], some].argmin(1)]]


def minima(h: np.ndarray, doc: np.ndarray, n: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """The first ``bins`` densified bins of n texts with shingle hashes h of texts doc, and which texts have words."""
    shift = np.uint64(BINS.bit_length() - 1)
    least = np.full(n * BINS, _MOST, np.uint64)
    np.minimum.at(least, doc * BINS + (h >> (np.uint64(64) - shift)).astype(np.int64), h << shift >> shift)
    least = least.reshape(n, BINS)
    full = least != _MOST
    _densify(least, full, bins)
    return least[:, :bins], full.any(1)


def low_bits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ``BITS`` lowest bits of each text's bins, and which texts have words."""
    out, some = np.zeros((len(texts), BINS), np.uint8), np.zeros(len(texts), bool)
    for block in blocks(texts):
        least, rows = minima(*shingle_hashes(words(block.lower())), len(block))
        out[block.first : block.first + len(block)] = (mix(least + _OWN) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        some[block.first : block.first + len(block)] = rows
    return out, some


def packed(bits: np.ndarray, some: np.ndarray) -> list[str]:
    """Hex strings of packed bins; a text without words has the empty string."""
    per = 8 // BITS
    data = np.zeros((len(bits), BINS // per), np.uint8)
    for k in range(per):
        data |= bits[:, k::per] << np.uint8(BITS * k)
    return [row.tobytes().hex() if one else "" for row, one in zip(data, some, strict=True)]


def unpacked(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``packed``."""
    per = 8 // BITS
    some = np.array([bool(f) for f in fingerprints], bool)
    data = np.array([list(bytes.fromhex(f)) if f else [0] * (BINS // per) for f in fingerprints], np.uint8).reshape(len(fingerprints), BINS // per)
    out = np.zeros((len(fingerprints), BINS), np.uint8)
    for k in range(per):
        out[:, k::per] = data >> np.uint8(BITS * k) & np.uint8((1 << BITS) - 1)
    return out, some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness, 0 to 1, without the agreement by chance of ``BITS`` bits.

    Two texts without words are alike (1); one without words is unlike all others (0).
    """
    chance = 2.0**-BITS
    raw = ((a == b).mean(1) - chance) / (1 - chance)
    return np.where(some_a & some_b, np.clip(raw, 0, 1), (some_a == some_b).astype(float))


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint`` of every whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(packed(*low_bits(b.column(b.num_columns - 1))), pa.string())], names=[*b.schema.names[:-1], "fingerprint"])

    small_batches(docs.sparkSession)
    cut = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-1])
    return cut.mapInArrow(run, f"{schema}, fingerprint string")


def beside_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (part, kind, doc_id, text), sorted in each partition so that a document's next one follows it.

    Documents are cut into ranges of doc_id at quantiles; ranges are shuffled
    whole and each gets the first document of the following range (kind 1),
    the last range that of the first. Only a few ids for each range reach the
    driver. Null ids come first; rows of one id are in the order of their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    n = shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c <= order)) if cuts else F.lit(0)
    rows = rows.withColumn("part", part).withColumn("_order", order)
    firsts = [(r[0], r[1]) for r in rows.groupBy("part").agg(F.min("_order").alias("first")).orderBy("part").collect()]
    if not firsts:
        return rows.select("part", F.lit(0).alias("kind"), "doc_id", "text")
    goes_to = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "_order long, part int")
    heads = rows.where(F.col("_order").isin([first for _, first in firsts])).groupBy("_order").agg(F.min("text").alias("text"))
    heads = heads.join(goes_to, "_order").select("part", F.lit(1).alias("kind"), F.col("_order").alias("doc_id"), "text")
    both = rows.select("part", F.lit(0).alias("kind"), "doc_id", "text").unionByName(heads)
    return both.repartition(n, "part").sortWithinPartitions("part", "kind", "doc_id", "text")


def edited_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they are.

    The edited text has the last half of the code points (rounded down)
    replaced by the first as many, or all, of the next document. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty; of one document alone the
    next is itself; no documents give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                rows = held + list(zip(b.column("kind").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True))
                held = rows[-1:]
                bits, some = low_bits(pa.array([r[2] for r in rows], pa.string()))
                own = np.array([i for i in range(len(rows) - 1) if not rows[i][0]], np.int64)
                if not len(own):
                    continue
                edited = []
                for i in own:
                    one, half = rows[i][2], len(rows[i][2]) // 2
                    edited.append(one[: len(one) - half] + rows[i + 1][2][:half])
                new, new_some = low_bits(pa.array(edited, pa.string()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([rows[i][1] for i in own], pa.int64()),
                        "n_chars": pa.array([len(rows[i][2]) for i in own], pa.int64()),
                        "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                        "fingerprint": packed(bits[own], some[own]),
                        "edited_fingerprint": packed(new, new_some),
                        "near_edited": likeness(bits[own], some[own], new, new_some),
                        "near_next": likeness(bits[own], some[own], bits[own + 1], some[own + 1]),
                    }
                )

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    small_batches(docs.sparkSession)
    return beside_next(docs, text, doc_id).mapInArrow(run, out)
