"""Removal of repeated word windows by recompression.

Rounds of recompression name maximal runs of one symbol and then adjacent
pairs, a left-class symbol before a right-class one. A name is a hash of what
it stands for, so equal word sequences get equal interior symbols in every
document and on every machine. Each symbol knows its context: the words that
alone decide that it stands there. Symbols that occur once in the corpus rule
out every window around their context; windows that are left are named by
128 bits of all their words and meet their equals in shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mail
from .words import Texts, mix, pair, utf8, words

#: Words of a window; rounds of pairing; bits of a symbol's name in the first exchange; bytes of text for each shard.
WINDOW, ROUNDS, NAME_BITS, SHARD_BYTES = 20, 3, 48, 1 << 24
_FAR = 1 << 40


def recompress(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of word hashes after ``rounds``: names, and the contexts [low, high) that decide them.

    A symbol whose context leaves its document has a bound out of reach.
    """
    n = len(h)
    sym, low, high = h, np.arange(n), np.arange(1, n + 1)
    if not n:
        return sym, low, high
    # Runs of one word.
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~same)
    size = np.diff(np.append(first, n))
    sym = np.where(size > 1, pair(h[first], size.astype(np.uint64), 7), h[first])
    doc = doc[first]
    low, high = first - 1, first + size + 1
    edge = np.ones(len(doc), bool)
    edge[1:] = doc[1:] != doc[:-1]
    low = np.where(edge, -_FAR, low)
    high = np.where(np.append(edge[1:], True), _FAR, high)
    for r in range(rounds):
        n = len(sym)
        left = (mix(sym + np.uint64(0x9E37 * (r + 1))) & np.uint64(1)).astype(bool)
        joined = np.zeros(n, bool)
        joined[:-1] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
        taken = np.zeros(n, bool)
        taken[1:] = joined[:-1]
        before, after = np.full(n, -_FAR), np.full(n, _FAR)
        inner = doc[1:] == doc[:-1]
        before[1:] = np.where(inner, low[:-1], -_FAR)
        after[:-1] = np.where(inner, high[1:], _FAR)
        # A right-class symbol alone depends on the one before, a left-class one on the one after.
        new_low = np.where(~left & ~taken, np.minimum(low, before), low)
        new_high = np.where(joined, after, np.where(left, np.maximum(high, after), high))
        name = sym.copy()
        at = np.flatnonzero(joined)
        name[at] = pair(sym[at], sym[at + 1], 11 + r)
        keep = ~taken
        sym, low, high, doc = name[keep], new_low[keep], new_high[keep], doc[keep]
    return sym, low, high


def window_names(h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of the ``size`` words from each position."""
    a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for k in range(size):
        x = h[at + k]
        a = (a + x) * np.uint64(0x9FB21C651E98DF25)
        b = (b ^ mix(x + np.uint64(0x1234567))) * np.uint64(0xD6E8FEB86659FD93)
        b ^= b >> np.uint64(32)
    return mix(a), mix(b)


class _Block:
    """The word windows of a block, in an order that every round repeats."""

    def __init__(self, t: pa.Table, size: int):
        self.block = t["block"][0].as_py()
        self.ids = np.asarray(t["c0"].combine_chunks().fill_null(-(1 << 63)), np.int64)
        data, at = utf8(t["text"].combine_chunks())
        # Rows of a block come in any order; ids and texts put them in one.
        raw = data.tobytes()
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i], raw[at[i] : at[i + 1]]))
        column = t["text"].combine_chunks().take(pa.array(order))
        self.table, self.ids = t.take(pa.array(order)), self.ids[order]
        data, at = utf8(column)
        self.words = words(Texts(data, at, 0))
        self.h, self.doc, self.size = self.words.hashes(), self.words.doc(), size
        self.pos = np.arange(len(self.h)) - self.words.at[self.doc]

    def symbols(self) -> None:
        self.name, self.low, self.high = recompress(self.h, self.doc)
        bound = (self.low >= 0) & (self.high - self.low <= self.size)
        self.name, self.low, self.high = self.name[bound] >> np.uint64(64 - NAME_BITS), self.low[bound], self.high[bound]
        self.unique, self.of, count = np.unique(self.name, return_inverse=True, return_counts=True)
        self.many = count > 1

    def windows(self, shared: np.ndarray) -> None:
        """Windows around no symbol that occurs once, named; the first of each name in the block."""
        n = len(self.h)
        fits = self.words.counts[self.doc] - self.pos >= self.size
        alone = ~shared[self.of]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, np.maximum(self.high[alone] - self.size, 0), 1)
        np.add.at(cover, self.low[alone] + 1, -1)
        start = np.flatnonzero(fits & (np.cumsum(cover)[:n] == 0))
        a, b = window_names(self.h, start, self.size)
        order = np.lexsort((start, b, a))
        a, b, start = a[order], b[order], start[order]
        lead = np.ones(len(a), bool)
        lead[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.a, self.b, self.start, self.lead = a, b, start, lead


def _flags(answers: dict[int, bytes], cuts: np.ndarray) -> np.ndarray:
    out = np.zeros(cuts[-1], bool)
    for s, payload in answers.items():
        out[cuts[s] : cuts[s + 1]] = np.unpackbits(np.frombuffer(payload, np.uint8))[: cuts[s + 1] - cuts[s]]
    return out


def _shared_names(_: int, payloads: list[bytes]) -> list[bytes]:
    """Which of each block's symbols occur more than once in all blocks."""
    parts = [mail.unpack(p) for p in payloads]
    names = [mail.undo_deltas(p["d"]) for p in parts]
    many = [np.unpackbits(p["m"])[: len(x)].astype(bool) for p, x in zip(parts, names, strict=True)]
    every, inverse, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    shared = count > 1
    shared |= np.bincount(inverse, np.concatenate(many), len(every)) > 0
    flags, at = shared[inverse], 0
    out = []
    for x in names:
        out.append(np.packbits(flags[at : at + len(x)]).tobytes())
        at += len(x)
    return out


def _not_first(_: int, payloads: list[bytes]) -> list[bytes]:
    """Which of each block's windows also start earlier in another block."""
    parts = [mail.unpack(p) for p in payloads]
    a = np.concatenate([mail.undo_deltas(p["a"]) for p in parts])
    b = np.concatenate([p["b"] for p in parts])
    doc = np.concatenate([p["ids"][p["doc"]] for p in parts])
    pos = np.concatenate([p["pos"] for p in parts])
    order = np.lexsort((pos, doc, b, a))
    same = np.zeros(len(a), bool)
    x, y = order[1:], order[:-1]
    same[1:] = (a[x] == a[y]) & (b[x] == b[y])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
    first = order[start]
    later = np.zeros(len(a), bool)
    later[order] = (doc[order] != doc[first]) | (pos[order] != pos[first])
    out, at = [], 0
    for p in parts:
        out.append(np.packbits(later[at : at + len(p["b"])]).tobytes())
        at += len(p["b"])
    return out


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (binary): texts without words of windows that also start earlier.

    A window of ``window`` words goes where its words also start in a document
    of smaller id, or earlier in the same one; what is kept is joined by one
    space. Null and blank texts keep nothing of nothing; a null id is the
    smallest; rows with one id compare by position alone, so that rows that
    repeat treat each other's equal positions as the same place.
    The documents' table stays until ``mail.release`` or the end of Python.
    """
    corpus = mail.Corpus(docs.withColumn("_id", F.col(doc_id).cast("long")).select("_id", F.col(text).alias("_text")), "_text", ["_id"])
    shards = max(1, corpus.buckets, corpus.bytes // SHARD_BYTES)

    def name(t: pa.Table, _: list) -> pa.Table:
        x = _Block(t, window)
        x.symbols()
        cuts = mail.by_shard(x.unique, shards, NAME_BITS)
        return mail.messages(x.block, cuts, lambda lo, hi: mail.pack(d=mail.deltas(x.unique[lo:hi]), m=np.packbits(x.many[lo:hi])))

    shared = mail.answered(corpus.each(name, mail.MESSAGE), _shared_names)

    def seen(t: pa.Table, got: list[dict[int, bytes]]) -> tuple[_Block, np.ndarray, np.ndarray]:
        x = _Block(t, window)
        x.symbols()
        x.windows(_flags(got[0], mail.by_shard(x.unique, shards, NAME_BITS)))
        lead = np.flatnonzero(x.lead)
        return x, lead, mail.by_shard(x.a[lead], shards)

    def send(t: pa.Table, got: list[dict[int, bytes]]) -> pa.Table:
        x, lead, cuts = seen(t, got)
        a, b, at = x.a[lead], x.b[lead], x.start[lead]

        def make(lo: int, hi: int) -> bytes:
            used, local = np.unique(x.doc[at[lo:hi]], return_inverse=True)
            return mail.pack(a=mail.deltas(a[lo:hi]), b=b[lo:hi], ids=x.ids[used], doc=local.astype(np.uint32), pos=x.pos[at[lo:hi]].astype(np.uint32))

        return mail.messages(x.block, cuts, make)

    later = mail.answered(corpus.each(send, mail.MESSAGE, shared), _not_first)

    def finish(t: pa.Table, got: list[dict[int, bytes]]) -> pa.Table:
        x, lead, cuts = seen(t, got)
        gone = ~x.lead
        # Within a block, another window of the same id and position is the same place.
        head = lead[np.cumsum(x.lead) - 1] if len(x.lead) else lead
        gone &= (x.ids[x.doc[x.start]] != x.ids[x.doc[x.start[head]]]) | (x.pos[x.start] != x.pos[x.start[head]])
        flags = np.zeros(len(x.lead), bool)
        flags[lead] = _flags(got[1], cuts)
        gone |= flags[head]
        cover = np.zeros(len(x.h) + 1, np.int64)
        np.add.at(cover, x.start[gone], 1)
        np.add.at(cover, x.start[gone] + window, -1)
        keep = np.cumsum(cover)[:-1] == 0
        data, start, end = x.words.joined()
        kept = []
        for lo, hi in zip(x.words.at[:-1], x.words.at[1:], strict=True):
            some = np.flatnonzero(keep[lo:hi]) + lo
            if len(some) == hi - lo:
                kept.append(data[start[lo] : end[hi - 1]].tobytes() if hi > lo else b"")
            else:
                runs = np.split(some, np.flatnonzero(np.diff(some) > 1) + 1)
                kept.append(b" ".join(data[start[r[0]] : end[r[-1]]].tobytes() for r in runs if len(r)))
        removed = x.words.counts - np.array([int(keep[lo:hi].sum()) for lo, hi in zip(x.words.at[:-1], x.words.at[1:], strict=True)], np.int64)
        return pa.table({"doc_id": x.table["c0"], "n_words": pa.array(x.words.counts), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.binary())})

    return corpus.each(finish, "doc_id long, n_words long, n_removed long, kept binary", shared, later)
