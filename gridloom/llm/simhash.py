"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 bits share a variant: a value
within one bit of either. Every distinct fingerprint emits itself and its
64 one-bit variants; a shuffle on variants brings together all pairs that
can link, at most 65 fingerprints on one variant, whatever the data.

``drop_near_duplicates`` asks for a likeness of word shingles instead, at
which fingerprints differ in more than 2 bits. There prefixes of the sets, in
an order common to all, bring every such pair together, and each link is
verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .minhash import shingle_hashes
from .shared import connected_components, scratch, settle, shuffle_partitions, small_batches, stored
from .words import Texts, blocks, mix, pair, sums_by, words
from .xxh64 import xxh64

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2

#: Least Jaccard likeness, in hundredths, of texts that ``drop_near_duplicates`` links.
LIKE = 80
#: One text in so many is asked which shingles are frequent, how many of those have one, and the most that are told. They
#: say which shingles come last in the order of all, which is right whatever it is, and so steer work alone.
ASKED, FREQUENT, TOLD = 16, 4, 1 << 16
#: Rounds of comparison with pivots go on while a row of a shingle meets more others than this, at most so many rounds.
MEETINGS, ROUNDS = 64, 8
#: Bits of the map of a set of shingles (a multiple of 64).
MAP_BITS = 1024
#: Texts that are worked on at once.
_ROWS = 256
_codec = pa.Codec("zstd", compression_level=1)

#: Writes a table that is dropped when the work is done, see ``scratch``.
Keep = Callable[[DataFrame], DataFrame]


def simhash(texts: Texts, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text, as uint64.

    Words of A-Z-folded text, shingles with repeats; a text of fewer words has
    one shingle of all of them, and a text without words the fingerprint 0.
    """
    w = words(texts.lower())
    data, start, end = w.joined()
    n = w.counts
    shingles = np.where(n == 0, 0, np.maximum(n - shingle_words + 1, 1))
    at = np.concatenate([[0], np.cumsum(shingles)])
    doc = np.repeat(np.arange(len(n)), shingles)
    first = np.arange(at[-1]) - at[doc] + w.at[doc]
    last = np.minimum(first + shingle_words, w.at[doc + 1]) - 1
    h = xxh64(data, start[first], end[last], seed)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), at[some])
            out[some] |= (2 * ones > shingles[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [simhash(t, shingle_words) for t in blocks(b.column(b.num_columns - 1))]
            fp = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], "fp"])

    small_batches(docs.sparkSession)
    cut = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-1])
    return cut.mapInArrow(run, f"{schema}, fp long")


def near_pairs(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that connect all pairs at 2 or fewer bits.

    On each variant all fingerprints are within 2 bits of one another, so that
    links to the smallest of them connect them all.
    """
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    # A given number of partitions, which adaptive execution does not merge; by a hash, as a partitioning by fp itself would be taken for the one at hand.
    spread = fps.repartition(shuffle_partitions(fps.sparkSession), F.xxhash64("fp"))
    variants = spread.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    pairs = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links reach.

    Null and blank texts have fingerprint 0 and link like others; rows that
    repeat get a row each; a null doc_id never names a component unless no
    other id is reached. An empty table gives an empty result.
    """
    fps = settle(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle_words=shingle_words))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    near = connected_components(near_pairs(nodes.select("fp")))
    nodes = nodes.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    nodes = settle(nodes)
    named = nodes.join(nodes.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of shingle hash and text, in order of texts, then hashes."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _sets(texts: pa.Array, shingle_words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for block in blocks(texts):
        h, doc = _distinct(*shingle_hashes(words(block.lower()), shingle_words))
        out += np.split(h, np.searchsorted(doc, np.arange(1, len(block))))
    return out


def _packed(text: pa.Array) -> pa.Array:
    """Each text compressed, so that exchanges carry less; a null text is empty."""
    raw = [b"" if x is None else x for x in text.cast(pa.large_binary()).to_pylist()]
    return pa.array([len(x).to_bytes(8, "little") + _codec.compress(x, asbytes=True) for x in raw], pa.binary())


def _unpacked(packed: pa.Array) -> pa.Array:
    """The inverse of ``_packed``."""
    return pa.array([_codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in packed.to_pylist()], pa.large_binary())


def frequent(docs: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts of rows (doc_id, at, text) have, ascending, and how many of the texts asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                for h in _sets(whole.slice(first, _ROWS).column(0), shingle_words):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["key"])

    some = docs.where(F.pmod("at", F.lit(ASKED)) == 0).dropDuplicates(["at"]).select("text")
    counts = some.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= FREQUENT)
    told = counts.orderBy(F.desc("count"), "key").limit(TOLD).toArrow()
    keys = told["key"].to_numpy().view(np.uint64)
    order = keys.argsort()
    return keys[order], told["count"].to_numpy()[order]


def prefixes(h: np.ndarray, doc: np.ndarray, n: int, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of n texts' distinct shingles (h, doc) the first of each text in the order of all, where each text's begin, the sizes of sets and how many of each are not ``often`` found.

    Shingles go by how ``often`` they are found, then by hash. A text of m
    shingles has so many in its prefix that at most ceil(0.8 m) - 1 are left.
    """
    keys, counts = often
    rank = np.zeros(len(h), np.int64)
    if len(keys):
        at = np.searchsorted(keys, h).clip(max=len(keys) - 1)
        rank = np.where(keys[at] == h, counts[at], 0)
    order = np.lexsort((h, rank, doc))
    h, doc = h[order], doc[order]
    start = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(start)
    most = np.where(size > 0, size + (-LIKE * size // 100) + 1, 0)
    inside = np.arange(len(h)) - start[doc] < most[doc]
    return h[inside], np.concatenate([[0], np.cumsum(most)]), size, np.bincount(doc[rank[order] == 0], minlength=n)


def maps(h: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """For each of n texts with distinct shingles (h, doc) whether an even or odd number of them falls to each of ``MAP_BITS`` bits.

    Sets differ in as many shingles as their maps do in bits, or in more.
    """
    at = doc * MAP_BITS + (h >> np.uint64(64 - (MAP_BITS.bit_length() - 1))).astype(np.int64)
    odd = (np.bincount(at, minlength=n * MAP_BITS) & 1).astype(np.uint8)
    words_ = MAP_BITS // 64
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * words_), pa.array(np.packbits(odd).view(np.int64)))


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, at, fp, name, size, rare, prefix, bits, packed of rows (doc_id, at, text).

    ``name`` is a hash of a text's set of shingles, so that texts of one name
    are alike, ``size`` the size of the set, ``rare`` how many of it are not
    frequent and ``prefix`` its first shingles, see ``prefixes``; a text
    without words has none. ``bits`` is the set's map, see ``maps``.
    """
    often = frequent(docs, shingle_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                b = whole.slice(first, _ROWS)
                fps, names, sizes, rares, keys, counts, bits = [], [], [], [], [], [], []
                for block in blocks(b.column(2)):
                    h, doc = _distinct(*shingle_hashes(words(block.lower()), shingle_words))
                    key, at, size, rare = prefixes(h, doc, len(block), often)
                    fps.append(simhash(block, shingle_words))
                    names.append(sums_by(np.searchsorted(doc, np.arange(len(block) + 1)), mix(h + np.uint64(SEED))))
                    sizes.append(size)
                    rares.append(rare)
                    bits.append(maps(h, doc, len(block)))
                    keys.append(key)
                    counts.append(np.diff(at))
                ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
                columns = {"doc_id": b.column(0), "at": b.column(1), "fp": pa.array(np.concatenate(fps).view(np.int64)), "name": pa.array(np.concatenate(names).view(np.int64))}
                columns |= {"size": pa.array(np.concatenate(sizes).astype(np.int32)), "rare": pa.array(np.concatenate(rares).astype(np.int32)), "prefix": lists, "bits": pa.concat_arrays(bits), "packed": _packed(b.column(2))}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, at long, fp long, name long, size int, rare int, prefix array<long>, bits array<long>, packed binary")


def like_pairs(pairs: DataFrame, shingle_words: int) -> DataFrame:
    """(a, b) of the rows (a, b, packed_a, packed_b) whose sets of shingles have a Jaccard likeness of ``LIKE`` hundredths or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                b = whole.slice(first, _ROWS)
                both = zip(_sets(_unpacked(b.column(2)), shingle_words), _sets(_unpacked(b.column(3)), shingle_words), strict=True)
                shared = [(len(np.intersect1d(x, y, True)), len(x) + len(y)) for x, y in both]
                yield b.select(["a", "b"]).filter(pa.array([100 * n >= LIKE * (total - n) for n, total in shared], pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _can_be_like(a: Column, b: Column) -> Column:
    """Whether texts (less, pos) of a shared shingle can be alike, if it is the first they share: no more than what follows in both is shared."""
    return (100 + LIKE) * F.least(-a["less"] - a["pos"], -b["less"] - b["pos"]) >= LIKE * (-a["less"] - b["less"])


def _maps_allow(a: Column, b: Column, less_a: Column, less_b: Column) -> Column:
    """Whether texts of maps a and b can be alike: sets differ in as many shingles as maps do in bits, or in more."""
    differ = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, MAP_BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))
    return (100 + LIKE) * (-less_a - less_b - differ) >= 2 * LIKE * (-less_a - less_b)


def _linked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle_words: int, keep: Keep) -> DataFrame:
    """The ``pairs`` of names that are alike."""
    asked = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    asked = nodes.select("name", "at").join(asked, "name", "left_semi")
    with scratch(pairs.sparkSession) as briefly:
        texts = briefly(rows.select("at", "packed").join(asked, "at").groupBy("name").agg(F.first("packed").alias("packed")))
        both = pairs.join(texts.select(F.col("name").alias("a"), F.col("packed").alias("packed_a")), "a").join(texts.select(F.col("name").alias("b"), F.col("packed").alias("packed_b")), "b")
        return keep(like_pairs(both.select("a", "b", "packed_a", "packed_b"), shingle_words))


def _placed(shared: DataFrame, links: DataFrame, keep: Keep) -> DataFrame:
    """key, it, group, inside, n of the rows (key, it) of keys with n rows in several groups of ``links``; ``inside`` says whether a row is in the key's largest group."""
    first = connected_components(links)
    placed = shared.join(first, F.col("it.name") == F.col("node"), "left").select("key", "it", F.coalesce("component", "it.name").alias("group"))
    groups = placed.groupBy("key", "group").agg(F.count("*").alias("size"))
    groups = groups.groupBy("key").agg(F.max(F.struct("size", "group")).alias("main"), F.sum("size").alias("n"), F.count("*").alias("groups")).where("groups > 1")
    return keep(placed.join(groups, "key").select("key", "it", "group", (F.col("group") == F.col("main.group")).alias("inside"), "n"))


def _with_pivots(placed: DataFrame, shift: float) -> DataFrame:
    """Pairs (a, b) of texts and the pivot of their shingle and size, the most typical text outside the shingle's largest group.

    Sizes go by steps of a quarter from ``shift`` of a step on.
    """
    banded = placed.withColumn("band", F.floor(F.log(-F.col("it.less")) / F.log(F.lit(100 / LIKE)) + F.lit(shift)))
    pivots = banded.where("not inside").groupBy("key", "band").agg(F.min(F.struct("it", "group")).alias("pivot"))
    both = banded.join(pivots, ["key", "band"]).where((F.col("group") != F.col("pivot.group")) & _can_be_like(F.col("it"), F.col("pivot.it")))
    return both.select(F.least("it.name", "pivot.it.name").alias("a"), F.greatest("it.name", "pivot.it.name").alias("b")).distinct()


def _across(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs (a, b) of texts that share a shingle, are in two groups and can be alike by sizes, places and maps.

    Texts outside a shingle's largest group meet all of its texts, those inside do not meet one another.
    """
    mapped = placed.join(nodes.select("name", "bits"), F.col("it.name") == F.col("name")).select("key", "it", "group", "inside", "bits")
    p, q = mapped.where("not inside").alias("p"), mapped.alias("q")
    apart = F.col("q.inside") | (F.col("p.group") < F.col("q.group"))
    alike = _can_be_like(F.col("p.it"), F.col("q.it")) & _maps_allow(F.col("p.bits"), F.col("q.bits"), F.col("p.it.less"), F.col("q.it.less"))
    met = p.join(q, (F.col("p.key") == F.col("q.key")) & apart & alike)
    return met.select(F.least("p.it.name", "q.it.name").alias("a"), F.greatest("p.it.name", "q.it.name").alias("b")).distinct()


def _kept(whole: DataFrame, shingle_words: int, keep: Keep) -> DataFrame:
    """doc_id, at of the row that stays of each group of rows (doc_id, at, text), see ``drop_near_duplicates``."""
    rows = keep(sketches(whole, shingle_words))
    # The row of the smallest id stands for its name, one without an id only for lack of others.
    nodes = keep(rows.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "fp", "size", "rare", "prefix", "bits")).alias("one")).select("name", "one.*"))

    keys = nodes.select("rare", "size", "name", F.posexplode("prefix").alias("pos", "key")).select("key", F.struct("rare", (-F.col("size")).alias("less"), "name", "pos").alias("it"))
    of_key = W.partitionBy("key")
    shared = keys.withColumns({"least": F.min("it").over(of_key), "n": F.count("*").over(of_key)}).where("n > 1")
    shared = keep(shared.select("key", "it", "least"))
    pairs = shared.where((F.col("it.name") != F.col("least.name")) & _can_be_like(F.col("it"), F.col("least"))).select(F.col("least.name").alias("a"), F.col("it.name").alias("b"))
    least = nodes.groupBy("fp").agg(F.min("name").alias("a"))
    pairs = pairs.unionByName(nodes.join(least, "fp").select("a", F.col("name").alias("b")))
    near = near_pairs(least.select("fp")).withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(least.withColumnRenamed("fp", "x"), "x").join(least.select(F.col("fp").alias("y"), F.col("a").alias("b")), "y")
    pairs = keep(pairs.unionByName(near.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = _linked(pairs, rows, nodes, shingle_words, keep)

    placed, left = _placed(shared.select("key", "it"), links, keep), None
    for k in range(ROUNDS):
        before = left
        n, left = placed.agg(F.count("*"), F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0))).first()
        if left <= MEETINGS * n or before is not None and 10 * left > 9 * before:
            break
        more = keep(_with_pivots(placed, k % 2 / 2).join(pairs, ["a", "b"], "left_anti"))
        pairs, links = pairs.unionByName(more), links.unionByName(_linked(more, rows, nodes, shingle_words, keep))
        placed = _placed(placed.select("key", "it"), links, keep)
    more = keep(_across(placed, nodes).join(pairs, ["a", "b"], "left_anti"))
    links = links.unionByName(_linked(more, rows, nodes, shingle_words, keep))

    groups = connected_components(links).withColumnRenamed("node", "name")
    best = F.min(F.struct("none", "doc_id", "at")).alias("best")
    return nodes.join(groups, "name", "left").groupBy(F.coalesce("component", "name").alias("component")).agg(best).select("best.doc_id", "best.at")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = 5) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their group: one document of each group stays.

    Groups are components of texts whose sets of word shingles have a Jaccard
    likeness of 0.8 or more. Two such texts share a shingle of both their
    prefixes. Texts that share one are first compared with a pivot, the most
    typical of them (fewest rare shingles, then the largest set), those within
    2 bits of one another with the smallest name; while many pairs are left,
    rounds of other pivots follow. Where a shingle's texts are in several
    groups after that, all pairs across groups that sizes, places and maps
    allow are compared, so that no link is left out. Rows equal to the
    kept one in id and text stay with it; rows with a null doc_id stay only
    where no others are in their group. Null and blank texts are one group; an
    empty table gives an empty one.
    """
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("at"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    # Only what is kept outlives this: texts and prefixes are off the disk when the next operator runs.
    with scratch(docs.sparkSession) as keep:
        kept = stored(_kept(whole, shingle_words, keep))
    return docs.join(kept, docs[doc_id].eqNullSafe(kept["doc_id"]) & (F.xxhash64(docs[text]) == kept["at"]), "left_semi")
