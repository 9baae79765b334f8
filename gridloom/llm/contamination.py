"""Benchmark decontamination: windows of test words looked up in training texts.

Built-in DataFrame functions only. Every window of ``WINDOW`` words of a
benchmark item (or all words of a shorter one) is a gram; the distinct grams
are a hash table, broadcast when its counted size is within
``BROADCAST_BYTES`` and joined by a shuffle beyond. Each place of a document
makes one 64-bit hash of the words that follow, inside generated code; places
whose hash is known are verified word by word. What a document's places say
meets in one aggregation, to which only hits and one row a document go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, and most bytes of grams that are broadcast.
WINDOW, BROADCAST_BYTES = 10, 64 << 20

# What is no word, in lower-cased and in other texts.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
_HEAD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and no other letter.

    ``lower`` does this many times faster than ``translate``, but folds other
    capitals too: it is taken where all characters beyond ASCII are of kinds
    that have no lower case.
    """
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{Mn}\p{P}]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null one."""
    return F.filter(F.split(F.coalesce(lowered(text), F.lit("")), _GAP), lambda w: w != "")


def _hash(w: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(w, at + k) for k in range(size)))


def grams(items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(hash, size, gram, items): the distinct windows of all items and the ids, as text, of those that have each."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where((F.size("w") > 0) & F.col("item").isNotNull())
    size = F.least(F.size("w"), F.lit(window))
    cut = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda p: F.slice("w", p, size))).alias("gram"))
    cut = cut.groupBy("gram").agg(F.collect_set("item").alias("items"))
    of_size = F.lit(None).cast("long")
    for n in range(1, window + 1):
        of_size = F.when(F.size("gram") == n, _hash(F.col("gram"), F.lit(0), n)).otherwise(of_size)
    return cut.select(of_size.alias("hash"), F.size("gram").alias("size"), "gram", "items")


def scan(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, ``carried`` columns, n_words, n_hit, spans, items, contaminated.

    A word is hit inside any occurrence of a window of any item; ``spans`` are
    the maximal runs of hit words as structs (first, last), places from 0;
    ``items`` the ids, as text in ascending order, of items with an occurring
    window. Null, empty and wordless texts have no words and no hits; items
    without words or without an id have no windows; rows that repeat, also in
    id, are each a document; items that repeat count once; no items leave all
    documents clean; no documents give no rows. Texts are scanned whole.
    """
    known = grams(items, text="text", item_id=item_id, window=window)
    sizes, size = set(), 0
    for n, count, taken in known.groupBy("size").agg(F.count("*"), F.sum(F.octet_length(F.concat_ws(" ", "gram")) + F.octet_length(F.concat_ws(" ", "items")) + 64)).collect():  # at most ``window`` rows
        sizes.add(n)
        size += taken
    taken = {c: f"_c{k}" for k, c in enumerate((doc_id, *carried))}
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *(F.col(c).alias(n) for c, n in taken.items()), words(F.col(text)).alias("_w"))
    rows = rows.select("_row", *taken.values(), "_w", F.explode(F.sequence(F.lit(-1), F.size("_w") - 1)).alias("_p"))
    # The place -1 stands for the document itself and matches nothing.
    if len(sizes) == 1:
        (n,) = sizes
        rows = rows.withColumns({"_n": F.lit(n), "_h": F.when((F.col("_p") >= 0) & (F.col("_p") + n <= F.size("_w")), _hash(F.col("_w"), F.col("_p"), n))})
    elif sizes:
        ways = [F.struct(F.lit(n).alias("_n"), F.when((F.col("_p") >= 0) & (F.col("_p") + n <= F.size("_w")), _hash(F.col("_w"), F.col("_p"), n)).alias("_h")) for n in sorted(sizes)]
        rows = rows.select("*", F.inline(F.array(*ways)))
    else:
        rows = rows.withColumns({"_n": F.lit(0), "_h": F.lit(None).cast("long")})
    small = F.broadcast(known) if size <= broadcast_bytes else known
    same = (F.col("_h") == F.col("hash")) & (F.col("_n") == F.col("size")) & (F.slice("_w", F.greatest(F.col("_p"), F.lit(0)) + 1, F.col("_n")) == F.col("gram"))
    met = rows.join(small, same, "left").where((F.col("_p") < 0) | F.col("hash").isNotNull())
    own = F.col("_p") < 0
    met = met.select("_row", *(F.when(own, F.col(n)).alias(n) for n in taken.values()), F.when(own, F.size("_w")).alias("_size"), F.when(~own, F.struct(F.col("_p").alias("first"), (F.col("_p") + F.col("_n") - 1).alias("last"))).alias("_at"), "items")
    found = met.groupBy("_row").agg(*(F.max(n).alias(n) for n in taken.values()), F.max("_size").cast("long").alias("n_words"), F.sort_array(F.collect_set("_at")).alias("_hits"), F.collect_set("items").alias("_items"))
    start = F.array().cast("array<struct<first:int,last:int>>")

    def joined(runs: Column, x: Column) -> Column:
        end = F.try_element_at(runs, F.lit(-1))
        longer = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))))
        return F.when((F.size(runs) > 0) & (x["first"] <= end["last"] + 1), longer).otherwise(F.concat(runs, F.array(x)))

    # Runs grow one hit at a time; documents without hits skip the fold.
    spans = F.when(F.size("_hits") > 0, F.aggregate("_hits", start, joined)).otherwise(start)
    out = found.select(*(F.col(n).alias(c) for c, n in taken.items()), "n_words", spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return out.select(doc_id, *carried, "n_words", hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with hit words, and what stands between a hit word and the next word, taken out of their texts.

    Other columns stay; clean texts, null ones too, stay byte by byte.
    """
    names = [f"_d{k}" for k in range(len(docs.columns))]
    place = dict(zip(docs.columns, names, strict=True))
    found = scan(docs.toDF(*names), items, text=place[text], **(options | {"doc_id": names[0]}), carried=tuple(names[1:]))
    t = F.col(place[text])
    kept = F.filter(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0)), lambda _, i: ~F.exists("spans", lambda s: (s["first"] <= i) & (i <= s["last"])))
    cleaned = F.when(F.col("contaminated"), F.concat(F.regexp_extract(t, _HEAD, 0), F.concat_ws("", kept))).otherwise(t)
    return found.select(*((cleaned if c == text else F.col(n)).alias(c) for c, n in place.items()))


def remove_documents(docs: DataFrame, items: DataFrame, text: str = "text", least_hit: int = 1, least_share: float = 0.0, **options) -> DataFrame:
    """``docs`` without those that have ``least_hit`` or more hit words, being ``least_share`` or more of all their words."""
    names = [f"_d{k}" for k in range(len(docs.columns))]
    place = dict(zip(docs.columns, names, strict=True))
    found = scan(docs.toDF(*names), items, text=place[text], **(options | {"doc_id": names[0]}), carried=tuple(names[1:]))
    gone = (F.col("n_hit") >= max(least_hit, 1)) & (F.col("n_hit") >= F.col("n_words") * least_share)
    return found.where(~gone).select(*(F.col(n).alias(c) for c, n in place.items()))


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL of the query: windows as joined strings, hits counted word by word."""
    fold = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
with items as (select cast(item_id as varchar) as item, {fold} as w from benchmark where item_id is not null
), known as (
  select distinct item, least({window}, len(w)) as n, array_to_string(w[p : p + least({window}, len(w)) - 1], ' ') as gram
  from items, lateral (select unnest(range(1, len(w) - least({window}, len(w)) + 2)) as p) where len(w) > 0
), docs as (select row_number() over () as r, doc_id, {fold} as w from documents
), places as (
  select r, p, n, array_to_string(w[p : p + n - 1], ' ') as gram
  from docs, (select distinct n from known), lateral (select unnest(range(1, len(w) - n + 2)) as p) where len(w) >= n
), met as (select r, p, places.n, item from places join known on known.n = places.n and known.gram = places.gram
), hit as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from (select distinct r, p, n from met)) group by r
), named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from met) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)
"""
