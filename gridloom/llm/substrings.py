"""Removal of repeated byte substrings with external suffix arrays.

A substring of ``SPAN`` bytes is keyed by the least hash of the shorter
substrings in it, so that equal substrings have equal keys. Keys that only one
document has rule their substrings out. Runs of the others with one key go as
a segment, with the smallest document that has it, to the key's shard; the
windows of a key with many distinct segments are dealt over many shards. A shard
sorts all suffixes of its distinct segments by external induced sorting;
neighbours in that order with a common prefix of ``SPAN`` bytes are equal
substrings, and each learns whether a smaller document has it too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mail
from .suffixes import gathered, suffix_array
from .words import mix, range_hashes, utf8

#: Bytes of a repeat, of the substrings that key it, bits of a key in the first exchange, bytes of text of a block and for each shard.
SPAN, KEY_BYTES, KEY_BITS, BLOCK_BYTES, SHARD_BYTES = 50, 20, 48, 1 << 22, 1 << 25
#: A shard works on so many keys and on segments of so many bytes at once; these bound its memory, its own size the number of messages.
PART_KEYS, PART_BYTES = 1 << 18, 1 << 21
#: Bytes of segments that differ, over all blocks, beyond which the windows of a key are dealt over several shards.
HOT_BYTES = 1 << 18
#: Bytes of a step in which sizes of segments are told.
SIZE_STEP = 64
_END = 0xFF  # never in UTF-8
#: Windows whose keys are made at once.
_PIECE = 1 << 14


def window_keys(data: np.ndarray, span: int = SPAN, key_bytes: int = KEY_BYTES) -> np.ndarray:
    """The key of the ``span`` bytes from each position where so many follow: the least hash of ``key_bytes`` bytes in them.

    Least hashes are small numbers: ``mix`` spreads them over all shards.
    """
    n = len(data) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = np.empty(n, np.uint64)
    for first in range(0, n, _PIECE):  # pieces that stay in the processor's cache
        last = min(first + _PIECE, n)
        size = last - first + span - key_bytes
        read = lanes[first : first + size + key_bytes - 8].copy()
        at, h = 0, np.zeros(size, np.uint64)
        while at < key_bytes:
            at = min(at, key_bytes - 8)
            h ^= read[at : at + size]
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
            at += 8
        h = mix(h)
        width, have = span - key_bytes + 1, 1
        while 2 * have <= width:
            h = np.minimum(h[: len(h) - have], h[have:])
            have *= 2
        out[first:last] = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    return out


class _Block:
    """Runs of a block: neighbouring windows of one document with one key."""

    def __init__(self, t: pa.Table, span: int):
        self.block = t["block"][0].as_py()
        self.table, self.span = t, span
        self.ids = np.asarray(t["c0"].combine_chunks().fill_null(-(1 << 63)), np.int64)
        self.data, self.at = utf8(t["text"].combine_chunks())
        least = window_keys(self.data, span)
        # Where a document's windows begin, and where the first that leaves it does.
        begin, stop = self.at[:-1], np.maximum(self.at[1:] - span + 1, self.at[:-1])
        fresh = np.ones(len(least) + 1, bool)
        np.not_equal(least[1:], least[:-1], out=fresh[1:-1])
        fresh[begin[begin < len(fresh)]] = True
        fresh[stop[stop < len(fresh)]] = True
        edges = np.flatnonzero(fresh)
        run, size = edges[:-1], np.diff(edges)
        doc = np.searchsorted(self.at, run, "right") - 1
        inside = run < stop[doc]
        self.run, self.run_size, self.doc = run[inside], size[inside], doc[inside]
        self.key = mix(least[self.run])
        short = self.key >> np.uint64(64 - KEY_BITS)
        self.unique, self.of = np.unique(short, return_inverse=True)
        low, high = np.full(len(self.unique), np.iinfo(np.int64).max), np.full(len(self.unique), np.iinfo(np.int64).min)
        ids = self.ids[self.doc]
        np.minimum.at(low, self.of, ids)
        np.maximum.at(high, self.of, ids)
        self.low, self.many = low, low != high

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct segment, in the order of keys: which key has it, its bytes, 16 bits of its hash."""
        start, size = self.run, self.run_size + self.span - 1
        name, first = np.unique(range_hashes(self.data, start, start + size), return_index=True)
        order = np.argsort(self.of[first], kind="stable")
        first = first[order]
        return self.of[first], size[first], (name[order] >> np.uint64(20)).astype(np.uint16)

    def segments(self, fan: np.ndarray) -> None:
        """Runs with shared keys in the order of key, content and id; a group for each distinct segment, its smallest id first.

        ``fan`` is 0 for keys of one document, 1 for others; windows of a key
        with more are segments of their own, dealt over so many keys by content.
        """
        wide = fan[self.of]
        runs, hot = np.flatnonzero(wide == 1), np.flatnonzero(wide > 1)
        windows, each = _spans(self.run[hot], self.run_size[hot]), np.repeat(hot, self.run_size[hot])
        start = np.concatenate([self.run[runs], windows])
        size = np.concatenate([self.run_size[runs] + self.span - 1, np.full(len(windows), self.span)])
        second = range_hashes(self.data, windows, windows + self.span) % wide[each].astype(np.uint64)
        key = np.concatenate([self.key[runs], mix(self.key[each] + (second + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))])
        ids = self.ids[self.doc[np.concatenate([runs, each])]]
        content = range_hashes(self.data, start, start + size)
        order = np.lexsort((ids, size, content, key))
        start, size, key, content, ids = start[order], size[order], key[order], content[order], ids[order]
        lead = np.ones(len(order), bool)
        lead[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (size[1:] != size[:-1])
        self.run_start, self.run_id, self.group = start, ids, np.cumsum(lead) - 1
        self.where, self.size, self.keys, self.first = start[lead], size[lead], key[lead], ids[lead]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of each of ``sizes`` places, behind one another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _fans(answers: dict[int, bytes], cuts: np.ndarray) -> np.ndarray:
    out = np.zeros(cuts[-1], np.int64)
    for s, payload in answers.items():
        out[cuts[s] : cuts[s + 1]] = mail.unpack(payload)["f"]
    return out


def shard_count(size: int, buckets: int, cores: int) -> int:
    """Shards of ``size`` bytes of text. Messages are blocks times shards: no more than their size asks for, or than keep all cores busy."""
    return max(1, min(buckets, 8 * cores), size // SHARD_BYTES)


def _in_two(payloads: list[bytes], hot_bytes: int, part_keys: int = PART_KEYS) -> list[bytes]:
    """For each of a block's keys 0 if one document alone has it, else over how many keys its windows are dealt."""
    parts = [mail.unpack(p) for p in payloads]
    counts = [len(p["d"]) for p in parts]
    key = np.concatenate([mail.undo_deltas(p["d"]) for p in parts])
    many, ids = np.concatenate([np.unpackbits(p["m"])[:n] for p, n in zip(parts, counts, strict=True)]).astype(bool), np.concatenate([p["i"] for p in parts])
    count, size, name = (np.concatenate([p[c] for p in parts]) for c in "cbh")
    del parts
    count = count.astype(np.int64)
    begin = np.cumsum(count) - count
    fan = np.zeros(len(key), np.uint32)
    turns = -(-len(key) // part_keys)
    turn = (key % np.uint64(max(turns, 1))).astype(np.int64)
    for k in range(turns):
        here = np.flatnonzero(turn == k)
        every, inverse = np.unique(key[here], return_inverse=True)
        low, high = np.full(len(every), np.iinfo(np.int64).max), np.full(len(every), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids[here])
        np.maximum.at(high, inverse, ids[here])
        shared = low != high
        shared[inverse[many[here]]] = True
        # A segment that many blocks have counts once; 16 bits tell a key's segments apart well enough to see that it is hot.
        owner, segment = np.repeat(inverse, count[here]), _spans(begin[here], count[here])
        _, once = np.unique(owner << 16 | name[segment], return_index=True)
        total = np.bincount(owner[once], size[segment[once]], len(every)).astype(np.int64) * SIZE_STEP
        fan[here] = np.where(shared, np.minimum(total // hot_bytes + 1, (1 << 32) - 1), 0)[inverse]
    ends = np.cumsum(counts)
    return [mail.pack(f=fan[e - n : e]) for e, n in zip(ends.tolist(), counts, strict=True)]


def common_prefixes(t: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of ``t`` in descending order of suffixes, in pieces, and whether each shares ``span`` symbols with the one before it."""
    padded = np.concatenate([t, np.full(span + 8, _END, np.uint8)])
    lanes = np.ndarray((len(t) + span,), "<u8", padded, strides=(1,))
    offsets = [*range(0, span - 7, 8), span - 8] if span >= 8 else []
    last = None
    for piece in gathered(suffix_array(t), 1 << 16):
        before = np.concatenate([[piece[0] if last is None else last], piece[:-1]])
        same = np.ones(len(piece), bool)
        for o in offsets:
            live = np.flatnonzero(same)
            same[live] = lanes[piece[live] + o] == lanes[before[live] + o]
        for o in range(span if not offsets else 0):
            same &= padded[piece + o] == padded[before + o]
        if last is None:
            same[0] = False
        last = piece[-1]
        yield piece, same


def repeated_in(segments: list[bytes], ids: np.ndarray, span: int) -> list[np.ndarray]:
    """For each window of each distinct segment, whether a segment of smaller id has it too."""
    text = np.frombuffer(b"".join(s + bytes([_END]) for s in segments), np.uint8)
    size = np.array([len(s) for s in segments], np.int64)
    at = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(segments)), size + 1)
    later = np.zeros(len(text), bool)
    held: list[np.ndarray] = []

    def close() -> None:
        if held:
            group = np.concatenate(held)
            who = ids[owner[group]]
            later[group] = who > who.min()
            held.clear()

    for piece, same in common_prefixes(text, span):
        inside = piece - at[owner[piece]] <= size[owner[piece]] - span
        # Windows that reach past their segment are nobody's equal.
        same = same & inside
        piece, same = piece[inside], same[inside]
        if not len(piece):
            continue
        heads = np.flatnonzero(~same)
        if not len(heads) or heads[0] > 0:
            held.append(piece[: heads[0] if len(heads) else len(piece)])
        if len(heads):
            close()
            group = np.cumsum(~same) - 1
            done = (group >= 0) & (group < len(heads) - 1)
            g, p = group[done], piece[done]
            least = np.full(len(heads), np.iinfo(np.int64).max)
            np.minimum.at(least, g, ids[owner[p]])
            later[p] = ids[owner[p]] > least[g]
            held.append(piece[heads[-1] :])
    close()
    return [later[a : a + n - span + 1] for a, n in zip(at.tolist(), size.tolist(), strict=True)]


def _marks(own: list[list[bytes]], ids: list[np.ndarray], keys: list[np.ndarray], span: int) -> list[np.ndarray]:
    """Of each block's segments, with all others of their keys beside them: for each window, whether a smaller document than the segment's first has it."""
    best: dict[bytes, int] = {}
    key_of: dict[bytes, int] = {}
    for segments, first, key in zip(own, ids, keys, strict=True):
        for s, i, k in zip(segments, first.tolist(), key.tolist(), strict=True):
            key_of[s] = k
            if best.get(s, i) >= i:
                best[s] = i
    # The only segment with a key shares its substrings with none: its smallest document is theirs too.
    kinds = Counter(key_of.values())
    marks = {s: np.zeros(len(s) - span + 1, bool) for s, k in key_of.items() if kinds[k] == 1}
    names = [s for s, k in key_of.items() if kinds[k] > 1]
    if names:
        marks.update(zip(names, repeated_in(names, np.array([best[s] for s in names], np.int64), span), strict=True))
    return [np.concatenate([np.zeros(0, bool), *(marks[s] if best[s] == i else np.ones(len(s) - span + 1, bool) for s, i in zip(segments, first.tolist(), strict=True))]) for segments, first in zip(own, ids, strict=True)]


def _smaller_has(span: int, part_bytes: int = PART_BYTES):
    def work(_: int, payloads: list[bytes]) -> list[bytes]:
        """For each window of each block's segments, whether a smaller document than the segment's first has it."""
        parts = [mail.unpack(p) for p in payloads]
        keys = [mail.undo_deltas(x["d"]) for x in parts]
        ends = [np.concatenate([[0], np.cumsum(x["size"], dtype=np.int64)]) for x in parts]
        # Ranges of keys, which are hashes, one after another.
        turns = sum(int(e[-1]) for e in ends) // part_bytes + 1
        low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys) + 1
        edges = np.array([low + (high - low) * j // turns for j in range(1, turns)], np.uint64)
        cuts = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k in keys]
        bits: list[list[np.ndarray]] = [[] for _ in payloads]
        for j in range(turns):
            own = []
            for x, e, c in zip(parts, ends, cuts, strict=True):
                at = e[c[j] : c[j + 1] + 1]
                raw = x["text"][at[0] : at[-1]].tobytes()
                at = (at - at[0]).tolist()
                own.append([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
            here = [slice(c[j], c[j + 1]) for c in cuts]
            for held, more in zip(bits, _marks(own, [x["ids"][h] for x, h in zip(parts, here, strict=True)], [k[h] for k, h in zip(keys, here, strict=True)], span), strict=True):
                held.append(more)
        return [np.packbits(np.concatenate(held)).tobytes() for held in bits]

    return work


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, span: int = SPAN, whole_characters: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and columns ``keep`` as k0, k1, ...: texts without repeats.

    Every byte goes that lies in ``span`` bytes that also start in a document
    with a smaller id; repeats inside one document, or in rows of one id, stay.
    With ``whole_characters`` a character goes only if all its bytes do, so
    that ``kept`` is UTF-8. Null texts are empty; a null id is the smallest. The documents' table stays
    until ``mail.release`` or the end of Python.
    """
    extra = keep or []
    slim = docs.select(F.col(doc_id).cast("long").alias("_id"), *(docs[f"`{c}`"].alias(f"_k{i}") for i, c in enumerate(extra)), F.col(text).alias("_text"))
    corpus = mail.Corpus(slim, "_text", ["_id", *(f"_k{i}" for i in range(len(extra)))], BLOCK_BYTES)
    shards = shard_count(corpus.bytes, corpus.buckets, docs.sparkSession.sparkContext.defaultParallelism)

    def name(t: pa.Table, _: list) -> pa.Table:
        x = _Block(t, span)
        cuts, (of, size, name_) = mail.by_shard(x.unique, shards, KEY_BITS), x.distinct()
        # Sizes go in whole steps, which hardly take any room and see hot keys as well.
        at, size = np.searchsorted(of, np.arange(len(x.unique) + 1)), (-(-size // SIZE_STEP)).astype(np.uint32)
        count = np.diff(at).astype(np.uint32)

        def make(lo: int, hi: int) -> bytes:
            here = slice(at[lo], at[hi])
            return mail.pack(d=mail.deltas(x.unique[lo:hi]), m=np.packbits(x.many[lo:hi]), i=x.low[lo:hi], c=count[lo:hi], b=size[here], h=name_[here])

        return mail.messages(x.block, cuts, make)

    shared = mail.answered(corpus.each(name, mail.MESSAGE), lambda _, payloads: _in_two(payloads, hot_bytes))

    def seen(t: pa.Table, got: list[dict[int, bytes]]) -> tuple[_Block, np.ndarray]:
        x = _Block(t, span)
        x.segments(_fans(got[0], mail.by_shard(x.unique, shards, KEY_BITS)))
        return x, mail.by_shard(x.keys, shards)

    def send(t: pa.Table, got: list[dict[int, bytes]]) -> pa.Table:
        x, cuts = seen(t, got)

        def make(lo: int, hi: int) -> bytes:
            return mail.pack(d=mail.deltas(x.keys[lo:hi]), ids=x.first[lo:hi], size=x.size[lo:hi].astype(np.uint32), text=x.data[_spans(x.where[lo:hi], x.size[lo:hi])])

        return mail.messages(x.block, cuts, make)

    smaller = mail.answered(corpus.each(send, mail.MESSAGE, shared), _smaller_has(span))
    names = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(slim.schema.fields[1:-1]))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + (f", {names}" if names else "")

    def finish(t: pa.Table, got: list[dict[int, bytes]]) -> pa.Table:
        x, cuts = seen(t, got)
        n = x.size - span + 1
        flags = [np.zeros(0, bool)]
        for s in range(len(cuts) - 1):
            if cuts[s] < cuts[s + 1]:
                flags.append(np.unpackbits(np.frombuffer(got[1][s], np.uint8))[: int(n[cuts[s] : cuts[s + 1]].sum())].astype(bool))
        hits = np.flatnonzero(np.concatenate(flags))
        at = np.cumsum(n) - n
        hit_cuts = np.searchsorted(hits, np.append(at, n.sum()))
        # Where a segment's first document is smaller than the run's, all of the run goes; else what the shard marked.
        later = x.run_id > x.first[x.group]
        own = np.flatnonzero(~later)
        count = np.diff(hit_cuts)[x.group[own]]
        marked = hits[_spans(hit_cuts[:-1][x.group[own]], count)] + np.repeat(x.run_start[own] - at[x.group[own]], count)
        begins = np.concatenate([x.run_start[later], marked])
        ends = np.concatenate([x.run_start[later] + x.size[x.group[later]], marked + span])
        length = len(x.data) + 1
        cover = np.bincount(begins, minlength=length) - np.bincount(ends, minlength=length)
        gone = np.cumsum(cover)[:-1] > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        if len(edge):
            edge[x.at[:-1][x.at[:-1] < len(edge)]] = gone[x.at[:-1][x.at[:-1] < len(edge)]]
        total = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(edge)])
        if whole_characters and len(x.data):
            begins = np.flatnonzero((x.data & 0xC0) != 0x80)
            whole = np.minimum.reduceat(gone, begins)
            gone = np.repeat(whole, np.diff(np.append(begins, len(gone))))
        kept = [x.data[a:b][~gone[a:b]].tobytes() for a, b in zip(x.at[:-1], x.at[1:], strict=True)]
        out = {"doc_id": t["c0"], "n_bytes": pa.array(np.diff(x.at)), "n_removed": pa.array(total[x.at[1:]] - total[x.at[:-1]]), "n_spans": pa.array(spans[x.at[1:]] - spans[x.at[:-1]]), "kept": pa.array(kept, pa.binary())}
        return pa.table(out | {f"k{i}": t[f"c{i + 1}"] for i in range(len(extra))})

    return corpus.each(finish, schema, shared, smaller)


def clean(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = SPAN) -> DataFrame:
    """``docs`` with repeats taken out of their texts, in whole characters; a null text stays null."""
    # The text itself is not carried beside its own block, only whether it is there.
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rest = [n for c, n in names.items() if c != text]
    plain = docs.toDF(*names.values()).withColumn("_has", F.col(names[text]).isNotNull())
    out = remove_repeats(plain, names[text], names[doc_id], ["_has", *rest], span, whole_characters=True)
    columns = []
    for c, n in names.items():
        value = F.when(F.col("k0"), F.col("kept").cast("string")) if c == text else F.col(f"k{1 + rest.index(n)}")
        columns.append(value.alias(c))
    return out.select(*columns)


__all__ = ["clean", "remove_repeats", "repeated_in", "window_keys"]
