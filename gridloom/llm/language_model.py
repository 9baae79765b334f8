"""Language-model scores from Elias-Fano n-gram tries.

The model has single words, pairs and triples. Every fifth document (by crc32
of its id) is held out; all others train. Blocks send their words and then
their triples to shards, which count over all training documents. Words
are numbered by their shards, frequent ones first, and go by number from then
on, which packs well; a shard tells words apart by 64-bit hashes, so that two
words of one hash would count as one. A triple goes with its last two words, so
that one message serves pairs and triples.
Each shard keeps them in memory-mapped tries (word, its successor, the word
before both) and answers with quantised probabilities of pairs, counts of
triples, and rests that make both counts exact. Contexts that are frequent are split over shards, and the words
before a pair of frequent words are a context of their own, split alike.
Weights between pairs and single words, one for each power of 2 of a context's
count, come from leave-one-out expectation maximisation over all training
pairs; pairs are the Dirichlet prior of triples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mail
from .trie import NONE, Trie, at_least, count_codes, counts, probability, quantised
from .words import Texts, mix, pair, sums_by, utf8, words

#: One document of FOLDS is held out; bytes of text for each shard; occurrences of a context that one shard holds.
FOLDS, HELD_OUT, SHARD_BYTES, WHOLE = 5, 1, 1 << 22, 1 << 18
#: Marks of a text's end and begin among word hashes.
_END, _BEGIN = np.uint64(0xE4D0_0000_0000_0001), np.uint64(0xBE61_0000_0000_0001)
_SIZES, _RATIOS = 64, 512
#: Occurrences that the pairs' distribution is worth against a triple's context (mass of the Dirichlet prior).
PRIOR = 4.0
#: Numbers of a text's begin and of no word; words' own come after.
_FIRST, _NOTHING, _WORDS = 0, 1, 2


class _Block:
    def __init__(self, t: pa.Table):
        self.block, self.ids = t["block"][0].as_py(), t["c0"]
        data, at = utf8(t["text"].combine_chunks())
        w = words(Texts(data, at, 0).lower())
        n = w.counts
        self.counts = n + 1
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.tokens = np.full(self.at[-1], _END, np.uint64)
        last = np.zeros(self.at[-1], bool)
        last[self.at[1:] - 1] = True
        self.tokens[~last] = w.hashes()
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[self.at[:-1]] = _BEGIN
        self.held_out = mail.crc32(t["c0"].to_pylist()) % FOLDS == HELD_OUT
        self.train = np.repeat(~self.held_out, self.counts)
        self.unique, self.of = np.unique(self.tokens, return_inverse=True)

    def word_cuts(self, shards: int) -> np.ndarray:
        return mail.by_shard(self.unique, shards)

    def counted(self, answers: dict[int, bytes], shards: int) -> None:
        cuts = self.word_cuts(shards)
        self.c, number = np.zeros(len(self.unique), np.int64), np.zeros(len(self.unique), np.uint64)
        for s, payload in answers.items():
            told, part = mail.unpack(payload), slice(cuts[s], cuts[s + 1])
            self.c[part], number[part] = told["c"], told["i"].astype(np.uint64) * np.uint64(shards) + np.uint64(s + _WORDS)
        self.number = np.concatenate([number, np.array([_FIRST, _NOTHING], np.uint64)])

    def triples(self, total: int, kinds: int, texts: int, whole: int) -> None:
        """Distinct triples, and pairs of them, in the order of their route to shards, successor and word before.

        Records are the tokens and, for those that end a pair of two frequent
        words, one more each with the pair as context and the word before as
        successor; the token's own record then has no word before.
        """
        n, begin, nothing = len(self.tokens), len(self.unique), len(self.unique) + 1
        self.p = (self.c + 0.5) / (total + 0.5 * (kinds + 1))
        # Places in the list of numbers: of the word before, and of the one before that.
        place = np.concatenate([[0], self.of[:-1]]) if n else self.of
        place[self.at[:-1]] = begin
        earlier = np.concatenate([[0], place[:-1]]) if n else place
        earlier[self.at[:-1]] = begin
        self.history = np.concatenate([self.c, [texts]])[place]
        least = np.minimum(self.history, self.c[self.of])
        self.frequent = np.flatnonzero(least >= whole)
        f = self.frequent
        self.size = np.concatenate([self.history, least[f]])
        x = np.concatenate([self.number[place], pair(self.number[place[f]], self.number[self.of[f]], 7) | np.uint64(1 << 63)])
        successor = np.concatenate([self.of, earlier[f]])
        before = np.concatenate([earlier, np.full(len(f), nothing)])
        before[f] = nothing
        fan = (self.size // whole + 1).astype(np.uint64)
        route = mix(x)
        split = np.flatnonzero(fan > 1)
        route[split] = mix(x[split] + mix(self.number[successor[split]]) % fan[split] * np.uint64(0x9E3779B97F4A7C15))
        # In the order of numbers, so that the gaps between them are small.
        rank = np.empty(len(self.number), np.uint64)
        rank[np.argsort(self.number)] = np.arange(len(rank), dtype=np.uint64)
        routes, way = np.unique(route, return_inverse=True)
        bits = len(rank).bit_length()
        if len(routes).bit_length() + 2 * bits <= 64:
            order = np.argsort(way.astype(np.uint64) << np.uint64(2 * bits) | rank[successor] << np.uint64(bits) | rank[before])
        else:
            order = np.lexsort((rank[before], rank[successor], way))
        r, x, s, w = route[order], x[order], self.number[successor[order]], self.number[before[order]]
        lead = np.ones(len(order), bool)
        lead[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1]) | (s[1:] != s[:-1])
        each = lead.copy()
        each[1:] |= w[1:] != w[:-1]
        self.pair_of, self.triple_of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        self.pair_of[order], self.triple_of[order] = np.cumsum(lead) - 1, np.cumsum(each) - 1
        self.first = order[lead]
        self.route, self.x, self.s, self.w = r[lead], x[lead], s[lead], w[each]
        self.begin = np.append(np.flatnonzero(lead[each]), len(self.w))
        train = np.concatenate([self.train, self.train[f]])
        self.k = np.bincount(self.triple_of, train, len(self.w)).astype(np.int64)

    def message(self, lo: int, hi: int) -> bytes:
        """Contexts, pairs lo to hi and their triples."""
        x, r, n = self.x[lo:hi], self.route[lo:hi], len(self.tokens)
        head = np.ones(len(x), bool)
        head[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
        at, token, t = np.flatnonzero(head), self.first[lo:hi], slice(self.begin[lo], self.begin[hi])
        # Records of frequent pairs lie behind the tokens and say nothing about weights.
        said = token < n
        u = np.zeros(hi - lo, np.uint8)
        u[said] = quantised(self.p)[self.of[token[said]]]
        z, y, pairs = np.diff(np.append(at, len(x))), np.diff(self.begin[lo : hi + 1]), self.begin[lo:hi] - self.begin[lo]
        return mail.pack(
            x=_narrow(x[at]), z=_narrow(z), c=_narrow(self.size[token][at]), e=said[at].astype(np.uint8),
            s=_narrow(_gaps(self.s[lo:hi], at)), u=u, y=_narrow(y), w=_narrow(_gaps(self.w[t], pairs)), k=_narrow(self.k[t]),
        )

    def likely(self, codes: np.ndarray, rests: np.ndarray, seen: np.ndarray, weights: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all tokens by single words and by all levels, from codes and rests of pairs and counts of triples."""
        n, single = len(self.tokens), self.p[self.of]
        q = codes[self.pair_of]
        w = np.where(self.history > 0, weights[_power(self.history)], 1.0)
        pairs = at_least(q, self.size) + rests[self.pair_of]
        # Shares too small for a code are told by the rest alone.
        share = np.where(q[:n] == NONE, pairs[:n] / np.maximum(self.history, 1), probability(q[:n]))
        two = (1 - w) * share + w * single
        k = seen[self.triple_of[:n]]
        k[self.frequent] = pairs[n:]
        # The pair before has the context's count.
        c = self.history.astype(float)
        c[1:] = pairs[: n - 1]
        c[self.at[:-1]] = self.history[self.at[:-1]]
        return single, (k + prior * two) / (c + prior)


def _narrow(a: np.ndarray) -> np.ndarray:
    """Integers from 0 up in as few bytes as they need."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _gaps(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differences inside the ascending runs that begin at ``at``; the first of each is kept."""
    out = mail.deltas(a)
    out[at] = a[at]
    return out


def _undo_gaps(d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total, at = mail.undo_deltas(d), np.cumsum(sizes) - sizes
    return total - np.repeat(total[at] - d[at].astype(np.uint64), sizes)


def _count_words(_: int, payloads: list[bytes]) -> list[bytes]:
    parts = [mail.unpack(p) for p in payloads]
    keys = [mail.undo_deltas(p["d"]) for p in parts]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(inverse, np.concatenate([p["c"] for p in parts]), len(every)).astype(np.int64)
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
    out, at = [], 0
    for k in keys:
        mine = inverse[at : at + len(k)]
        out.append(mail.pack(c=_narrow(c[mine]), i=_narrow(rank[mine])))
        at += len(k)
    end = c[every == _END]
    return [*out, f"{(c > 0).sum()},{c.sum()},{end.sum()}".encode()]


def _ratio_bin(r: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(r > 0, np.clip(np.round(4 * np.log2(np.maximum(r, 1e-300))) + 256, 1, _RATIOS - 1), 0).astype(np.int64)


def _power(c: np.ndarray) -> np.ndarray:
    """The power of 2 that a count of 1 or more has reached."""
    return np.frexp(np.maximum(c, 1).astype(float))[1] - 1


def _merged(upper: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (upper, number) in order: both columns, an index of each one's first, and the place of every one given."""
    bits = int(numbers.max()).bit_length() if len(numbers) else 0
    name = upper.astype(np.uint64) << np.uint64(bits) | numbers
    if len(upper) and bits + int(upper.max()).bit_length() > 64:
        words, word = np.unique(numbers, return_inverse=True)
        name = upper * len(words) + word
    order = np.argsort(name)
    lead = np.ones(len(name), bool)
    lead[1:] = name[order[1:]] != name[order[:-1]]
    first = order[lead]
    place = np.empty(len(name), np.int64)
    place[order] = np.cumsum(lead) - 1
    return upper[first], numbers[first], first, place


def _score_triples(_: int, payloads: list[bytes]) -> list[bytes]:
    """Codes and rests of each block's pairs and triples from tries of the shard's training text, and evidence for the weights."""
    parts = [mail.unpack(p) for p in payloads]
    join = lambda f: np.concatenate([f(p) for p in parts])
    # Mixed, contexts are even over all values, as the trie's sequences like them.
    every, context = np.unique(join(lambda p: mix(p["x"].astype(np.uint64) + np.uint64(1))), return_inverse=True)
    sizes = join(lambda p: p["z"]).astype(np.int64)
    # Blocks ask for the same pairs and triples: each is searched for once.
    x, s, first, pair_of = _merged(np.repeat(context, sizes), join(lambda p: _undo_gaps(p["s"], p["z"].astype(np.int64))))
    of, w, _, triple_of = _merged(np.repeat(pair_of, join(lambda p: p["y"]).astype(np.int64)), join(lambda p: _undo_gaps(p["w"], p["y"].astype(np.int64))))
    k3 = np.bincount(triple_of, join(lambda p: p["k"]), len(of))
    k = np.bincount(of, k3, len(x))
    c, evident, u = np.repeat(join(lambda p: p["c"]), sizes)[first].astype(np.int64), np.repeat(join(lambda p: p["e"]), sizes)[first] > 0, join(lambda p: p["u"])[first]
    two, three = k > 0, k3 > 0
    known, starts = np.unique(x[two], return_index=True)
    share = quantised(k[two] / np.maximum(c[two], 1))
    pairs = Trie(every[known], np.append(starts, two.sum()), s[two], share, _narrow(k[two] - at_least(share, c[two])))
    codes, node = pairs.find(every, s, np.bincount(x, minlength=len(every)))
    rests = pairs.rest(node)
    pairs.close()
    known, starts = np.unique(node[of[three]], return_index=True)
    rough = count_codes(k3[three])
    triples = Trie(known, np.append(starts, three.sum()), w[three], rough, _narrow(k3[three] - counts(rough)))
    seen, leaf = triples.find(node, w, np.bincount(of, minlength=len(x)))
    seen_rests = triples.rest(leaf)
    triples.close()
    out, done, past = [], 0, 0
    for p in parts:
        two_of, three_of = pair_of[done : done + len(p["s"])], triple_of[past : past + len(p["w"])]
        out.append(mail.pack(q=codes[two_of], a=_narrow(rests[two_of]), r=seen[three_of], b=_narrow(seen_rests[three_of])))
        done, past = done + len(p["s"]), past + len(p["w"])
    again = two & evident & (c > 1)
    ratio = (k[again] - 1) / (c[again] - 1) / probability(u[again]).clip(1e-12)
    cell = _power(c[again] - 1) * _RATIOS + _ratio_bin(ratio)
    total = np.bincount(cell, k[again], _SIZES * _RATIOS)
    return [*out, ";".join(f"{i}:{int(total[i])}" for i in np.flatnonzero(total)).encode()]


def _weights(cells: dict[int, int]) -> np.ndarray:
    """The single-word weight for each power of 2 of a context's count, by expectation maximisation."""
    table = np.zeros((_SIZES, _RATIOS))
    for i, n in cells.items():
        table[i // _RATIOS, i % _RATIOS] += n
    ratio = np.concatenate([[0.0], 2.0 ** ((np.arange(1, _RATIOS) - 256) / 4)])
    w = np.full(_SIZES, 0.5)
    for _ in range(100):
        share = w[:, None] / (w[:, None] + (1 - w[:, None]) * ratio)
        w = ((table * share).sum(1) + 1.0) / (table.sum(1) + 1.5)
    return np.clip(w, 1e-3, 1.0)


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prior: float = PRIOR, whole: int = WHOLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row: log10 probabilities.

    Words of A-Z-folded text and one end are tokens. ``base_score`` is the
    smoothed single-word model; ``score`` the interpolated one, a probability
    of the text, summing to at most 1 over all texts with all unknown words as one. Null and blank texts have
    the end alone; a null id trains; rows that repeat count each. Without
    training documents all tokens are unknown. ``prior`` is how many occurrences
    the pairs are worth against a triple's context, ``whole`` how many occurrences
    of a context one shard holds; scores do not depend on it. The documents' table stays until ``mail.release`` or the end of Python.
    """
    corpus = mail.Corpus(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")), "_text", ["_id"])
    shards = max(1, corpus.bytes // SHARD_BYTES)

    def send_words(t: pa.Table, _: list) -> pa.Table:
        b = _Block(t)
        c = np.bincount(b.of, b.train, len(b.unique)).astype(np.uint32)
        return mail.messages(b.block, b.word_cuts(shards), lambda lo, hi: mail.pack(d=mail.deltas(b.unique[lo:hi]), c=c[lo:hi]))

    counted = mail.answered(corpus.each(send_words, mail.MESSAGE), _count_words)
    note = F.split(F.col("payload").cast("string"), ",")
    sums = counted.where("block < 0").select(*(note[i].cast("long").alias(n) for i, n in enumerate("vnt"))).agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in "vnt")).first()
    kinds, total, texts = (int(x) for x in sums)

    def send_triples(t: pa.Table, got: list[dict[int, bytes]]) -> pa.Table:
        b = _Block(t)
        b.counted(got[0], shards)
        b.triples(total, kinds, texts, whole)
        return mail.messages(b.block, mail.by_shard(b.route, shards), b.message)

    found = mail.answered(corpus.each(send_triples, mail.MESSAGE, counted), _score_triples)
    parts = F.explode(F.split(F.col("payload").cast("string"), ";")).alias("part")
    cells = found.where("block < 0 and length(payload) > 0").select(parts).select(F.split("part", ":").alias("x")).groupBy(F.col("x")[0].cast("long")).agg(F.sum(F.col("x")[1].cast("long")))
    weights = _weights(dict(cells.collect()))  # at most _SIZES * _RATIOS rows

    def finish(t: pa.Table, got: list[dict[int, bytes]]) -> pa.Table:
        b = _Block(t)
        b.counted(got[0], shards)
        b.triples(total, kinds, texts, whole)
        cuts = mail.by_shard(b.route, shards)
        codes, rests, seen = np.full(len(b.first), NONE, np.uint8), np.zeros(len(b.first)), np.zeros(len(b.w))
        for s, payload in got[1].items():
            told = mail.unpack(payload)
            codes[cuts[s] : cuts[s + 1]] = told["q"]
            rests[cuts[s] : cuts[s + 1]] = told["a"]
            seen[b.begin[cuts[s]] : b.begin[cuts[s + 1]]] = counts(told["r"]) + told["b"]
        single, all_levels = b.likely(codes, rests, seen, weights, prior)
        n = len(b.counts)
        return pa.table(
            {
                "doc_id": b.ids,
                "held_out": pa.array(b.held_out),
                "n_tokens": pa.array(b.counts),
                "n_known": pa.array(sums_by(b.at, (b.c[b.of] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(n, total)),
                "base_score": pa.array(np.add.reduceat(np.log10(single), b.at[:-1])),
                "score": pa.array(np.add.reduceat(np.log10(all_levels), b.at[:-1])),
            }
        )

    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return corpus.each(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", counted, found)

