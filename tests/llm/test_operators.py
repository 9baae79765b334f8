"""Each operator against brute force, and on null, empty, long, tied, repeated and missing rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import bpe, language_model, licenses, mail, minhash, packing, quality, recompress, simhash, substrings, suffixes, topk, trie
from gridloom.llm.shared import connected_components
from gridloom.llm.words import blocks, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, fp string"


def corpus():
    """Texts with copies, near copies, shared passages, runs, nulls, blanks and one long text; clashing extra columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rare = lambda n: " ".join("".join(rng.choice("bcdfghjkßü") for _ in range(6)) for _ in range(n))
    passage = rare(60)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    texts += [rare(30) + " " + passage + "\n" + rare(20), rare(10) + " " + passage, passage + "  " + passage]
    near = rare(120).split()
    texts += [" ".join(near), " ".join(near[:60] + ["changed"] + near[61:]), " ".join(near)]
    texts += ["", "   \n\t", None, "one", "two words", "la " * 200, "x" * 3000, "AB ab " * 40, "ab AB " * 40, rare(4000)]
    texts += texts[:3]
    table = [(i * 7 % 1000, t, "en", "s", None if t is None else len(t), 1, "f") for i, t in enumerate(texts)]
    # Rows that repeat, and rows without an id.
    return table + table[1:3] + table[42:43] + [(None, t, "en", "s", None, 1, "f") for t in (texts[0], texts[41], None)]


def order(i):
    """Ids as the operators order them: null first."""
    return -(1 << 63) if i is None else i


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows():
    return sorted((order(r[0]), (r[1] or "").encode()) for r in corpus())


def test_words_match_split():
    column = pa.array([None, " a\x0bb ", "", "é x\ty"] * 3).slice(1)
    for b in blocks(column, 4):
        w = words(b)
        raw = b.data.tobytes()
        assert [raw[s:e] for s, e in zip(w.start, w.end)] == [x for i in range(len(b)) for x in raw[b.at[i] : b.at[i + 1]].split()]


# 1


def brute_padding(lengths, buckets):
    distinct = sorted(set(lengths))
    best = {(0, 0): 0}
    for b in range(1, buckets + 1):
        for j in range(1, len(distinct) + 1):
            best[b, j] = min((best[b - 1, i] + sum(distinct[j - 1] - x for x in lengths if distinct[i] <= x <= distinct[j - 1]) for i in range(j) if (b - 1, i) in best), default=math.inf)
    return min(best[b, len(distinct)] for b in range(1, buckets + 1) if (b, len(distinct)) in best)


def test_packing_is_optimal_and_whole(docs, empty):
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 25))]
        seen = Counter(lengths)
        for k in (1, 2, 4, 40):
            bounds = packing.best_boundaries(sorted(seen), [seen[x] for x in sorted(seen)], k)
            assert sum(min(b for b in bounds if b >= x) - x for x in lengths) == brute_padding(lengths, k) and len(bounds) <= k
    counted = docs.select("doc_id", packing.token_count().alias("n_tokens"))
    out = packing.pack(counted, max_len=64, buckets=4, batch_tokens=256).collect()
    want = Counter()
    for i, t in rows():
        want[i] += len(t.split()) + 1
    got = Counter()
    for r in out:
        got[order(r["doc_id"])] += r["n_tokens"]
        assert r["n_tokens"] <= r["bucket_len"] <= 64
    assert got == want
    groups = defaultdict(list)
    for r in out:
        groups[r["bucket"], r["batch"]].append(r)
    assert all(len(g) * g[0]["bucket_len"] <= 256 and sorted(r["slot"] for r in g) == list(range(len(g))) for g in groups.values())
    last = {b: max(k for c, k in groups if c == b) for b, _ in groups}
    assert all(len(g) == 256 // g[0]["bucket_len"] for (b, k), g in groups.items() if k < last[b])
    assert packing.pack(empty.select("doc_id", packing.token_count().alias("n_tokens"))).count() == 0


# 2


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(90)] + [(200 + i, [0.25] * 6) for i in range(20)] + [(200, [0.25] * 6)]
    data += [(60, [0.1] * 6), (60, [0.1] * 6), (60, [0.2] * 6), (300, None), (301, [0.1, None]), (302, [float("nan")]), (303, [float("inf")]), (None, [0.5] * 6), (304, [0.5]), (305, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    vectors = df.select("vec_id", topk.quantised("embedding").alias("vector"))
    got = topk.top_k(vectors, vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), 5).collect()
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for n, (q, a) in enumerate(ok):
        if q is not None and q % 10 == 0:
            scored = sorted(((-sum(p * r for p, r in zip(a, b)), i) for m, (i, b) in enumerate(ok) if m != n), key=lambda x: (x[0], x[1] is None, x[1]))[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(scored))
    assert Counter(map(tuple, got)) == want
    few = vectors.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), 5).count() == 2
    assert topk.top_k(vectors.limit(0), few.withColumnRenamed("vec_id", "query_id"), 5).count() == 0
    assert topk.top_k(vectors, few.limit(0).withColumnRenamed("vec_id", "query_id"), 5).count() == 0


# 3


def test_bpe_matches_the_library(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    ours, theirs = bpe.Tokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "aAbBéÉΣσςİßǅ ﬁ①½漢字각\x1c\x1f\x85 \n\t'<|>.,!$01́å😀\x00's'll're"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "a" * 4000, "ab" * 500, "áß" * 300]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want
        assert ours.decode(want).decode() == theirs.decode(want, skip_special_tokens=False)
    got = bpe.encode(docs, path, decoded=True)
    told = Counter((order(r["doc_id"]), bytes(r["ids"])) for r in got.collect())
    assert told == Counter((i, bpe._packed(theirs.encode(t.decode(), add_special_tokens=False).ids)) for i, t in rows())
    assert bpe.decode(got.select("doc_id", "ids"), path).exceptAll(got.select("doc_id", "decoded")).count() == 0
    assert bpe.encode(empty, path).count() == 0


# 4


def brute_windows(texts, size=20):
    """Rows in order of (id, text); removed by an earlier (id, position)."""
    split = [(i, t.split()) for i, t in texts]
    first = {}
    for i, w in split:
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = Counter()
    for i, w in split:
        gone = {q for p in range(len(w) - size + 1) if first[tuple(w[p : p + size])] != (i, p) for q in range(p, p + size)}
        out[i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone)] += 1
    return out


def test_recompression_removes_repeated_windows(spark, docs, empty):
    got = recompress.remove_repeats(docs).collect()
    assert Counter((order(r[0]), r[1], r[2], bytes(r[3])) for r in got) == brute_windows(rows())
    rng = random.Random(9)
    for alphabet in ("a", "ab", "abc"):
        texts = [(i, " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))).encode()) for i in range(25)]
        df = spark.createDataFrame([(i, t.decode()) for i, t in texts], "doc_id long, text string").repartition(4)
        assert Counter((r[0], r[1], r[2], bytes(r[3])) for r in recompress.remove_repeats(df).collect()) == brute_windows(texts)
    assert recompress.remove_repeats(empty).count() == 0


def test_equal_sequences_get_equal_interior_symbols():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 50, 60).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 50, 13).astype(np.uint64), shared, rng.integers(0, 50, 9).astype(np.uint64)])
    b = np.concatenate([rng.integers(0, 50, 5).astype(np.uint64), shared])
    inside = []
    for x, start in ((a, 13), (b, 5)):
        name, low, high = recompress.recompress(x, np.zeros(len(x), np.int64))
        inside.append({(int(n), int(l) - start, int(h) - start) for n, l, h in zip(name, low, high) if l >= start and h <= start + 60})
    assert inside[0] == inside[1] and len(inside[0]) > 3


# 5


def test_elias_fano_and_trie():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        for bits in (6, 40, 63):
            v = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
            e = trie.EliasFano(*trie.EliasFano.arrays(v))
            q = np.concatenate([v, v + np.uint64(1), rng.integers(0, 1 << 63, 50, dtype=np.uint64)])
            at, equal = e.successor(q)
            assert (e.values() == v).all() and (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()
    contexts = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    sizes = rng.integers(1, 40, len(contexts))
    words_ = rng.integers(0, 1 << 40, 500, dtype=np.uint64)
    after = [np.sort(rng.choice(words_, n, replace=False)) for n in sizes]
    codes = rng.integers(0, 255, sizes.sum()).astype(np.uint8)
    held = trie.Trie(contexts, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(after), codes)
    asked = np.concatenate([contexts, contexts + np.uint64(1)])
    tried = [rng.choice(words_, 20) for _ in asked]
    known = {(int(c), int(w)): int(x) for (c, w), x in zip(((c, w) for c, a in zip(contexts, after) for w in a), codes)}
    got, places = held.find(asked, np.concatenate(tried), np.full(len(asked), 20))
    held.close()
    assert got.tolist() == [known.get((int(c), int(w)), trie.NONE) for c, t in zip(asked, tried) for w in t]
    inside = got != trie.NONE
    assert (codes[places[inside].astype(int)] == got[inside]).all() and (places[~inside] == len(codes)).all()
    k = np.array([0, *range(1, 12), 500, 1 << 31, 1 << 40])
    back = trie.counts(trie.count_codes(k))
    assert (back[:12] == k[:12]).all() and (back <= k).all() and (back[:-1] >= 0.9 * k[:-1]).all()
    many = np.random.default_rng(5).integers(1, 1 << 40, 5000)
    many = np.unique(np.concatenate([many, many % 1000 + 1, 1 << np.arange(40)]))
    for whole in (1 << 41, many, 3 * many):
        assert (trie.at_least(trie.quantised(many / whole), whole) <= many).all()
    assert (trie.counts(trie.count_codes(many)) <= many).all()
    p = np.array([1.0, 0.5, 0.3, 1e-12, 0.0])
    back = trie.probability(trie.quantised(p))
    assert (back <= p + 1e-12).all() and (back[:3] >= p[:3] * 0.9).all()


@pytest.mark.parametrize("whole", [language_model.WHOLE, 20])
def test_language_model(spark, docs, whole):
    got = Counter((order(r[0]), *r[1:5], round(r["base_score"], 6), round(r["score"], 6)) for r in language_model.score(docs, whole=whole).collect())
    texts = [(i, [*t.lower().split(), None]) for i, t in rows()]
    held = {i: zlib.crc32(b"" if i == order(None) else str(i).encode()) % 5 == 1 for i, _ in texts}
    c = Counter(w for i, t in texts if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    # The whole model, triple by triple.
    single = {w: (c[w] + 0.5) / (n + 0.5 * (v + 1)) for _, t in texts for w in t}
    grams = lambda t: zip([b"<", b"<"] + t, [b"<"] + t, t)
    triples = Counter(g for i, t in texts if not held[i] for g in grams(t))
    pairs = Counter()
    for (_, a, b), k in triples.items():
        pairs[a, b] += k
    c[b"<"] = pairs[b"<", b"<"] = sum(not held[i] for i, _ in texts)
    code = lambda k, of: trie.quantised(np.array([k / max(1, of)]))
    told = lambda k, of: float(trie.probability(code(k, of))[0])
    cells = Counter()
    for (a, b), k in pairs.items():
        if c[a] > 1 and b != b"<":
            ratio = (k - 1) / (c[a] - 1) / max(told(single[b], 1), 1e-12)
            cells[int(language_model._power(np.array([c[a] - 1]))[0]) * language_model._RATIOS + int(language_model._ratio_bin(np.array([ratio]))[0])] += k
    weights = language_model._weights(cells)
    want = Counter()
    for i, t in texts:
        base = every = 0.0
        for a, b, d in grams(t):
            w = weights[int(language_model._power(np.array([c[b]]))[0])] if c[b] else 1.0
            two = (1 - w) * told(pairs[b, d], c[b]) + w * single[d]
            k, of = triples[a, b, d], c[b] if b == b"<" else pairs[a, b]
            assert k <= of
            base += math.log10(single[d])
            every += math.log10((k + language_model.PRIOR * two) / (of + language_model.PRIOR))
        want[i, held[i], len(t), sum(c[w] > 0 for w in t), n, round(base, 6), round(every, 6)] += 1
    close = lambda x, y: x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-4 and abs(x[6] - y[6]) < 1e-4
    for x, y in zip(sorted(got.elements()), sorted(want.elements()), strict=True):
        assert close(x, y), (x, y)


def test_language_model_learns(spark, empty):
    assert language_model.score(empty).count() == 0
    rng = random.Random(4)
    follow = {w: [rng.choice("abcdefghij") for _ in range(2)] for w in "abcdefghij"}
    chain = []
    for i in range(200):
        w, text = "a", []
        for _ in range(40):
            text.append(w)
            w = rng.choice(follow[w])
        chain.append((i, " ".join(text)))
    scored = language_model.score(spark.createDataFrame(chain, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > 0.6 * scored[1]
    # A source whose words depend on the two before: pairs alone (a prior without end) know much less of held-out texts.
    follow = {(a, b): rng.choice("abcdefghij") for a in "abcdefghij" for b in "abcdefghij"}
    chain = []
    for i in range(300):
        text = rng.choices("abcdefghij", k=2)
        for _ in range(40):
            text.append(follow[text[-2], text[-1]] if rng.random() < 0.8 else rng.choice("abcdefghij"))
        chain.append((i, " ".join(text)))
    second = spark.createDataFrame(chain, "doc_id long, text string")
    three, two = (language_model.score(second, prior=p).where("held_out").agg(F.sum("score")).first()[0] for p in (language_model.PRIOR, 1e12))
    assert three > 0.7 * two
    # All texts over a tiny vocabulary have a probability of at most 1 together.
    tiny = [(i, t) for i, t in enumerate(["a b", "b a", "a", "b", "a a", "b b", ""] * 4)]
    out = language_model.score(spark.createDataFrame(tiny, "doc_id long, text string")).join(spark.createDataFrame(tiny, "doc_id long, text string"), "doc_id")
    assert sum(10 ** r["score"] for r in out.dropDuplicates(["text"]).collect()) <= 1


# 6


PROSE = """This library helps you to read and to write the tables of a small shop, and it is one of the few that do so without a
server. In the first part of the guide you will find out how to install it and how to use it in your own project; the
second part is for those who want to know what happens in the background when an order is made.

If you have any questions, or if you are not sure that the software does what you need, you may ask on the mailing
list. We do not promise to answer all of them in time, but we read every one, and the most useful answers are put into
the documentation for others to read. The conditions of use of the list are the same as those of other lists.

To build it from source you need a compiler and the usual tools. The results of a build are in the folder of that
name, and the version of the package is part of the file names. In no case should you copy files from one version to
the other: the form in which they are kept may be different, and with the next release it will be different again."""


def wrapped(text, size=12):
    w = text.split()
    return "\n".join(" ".join(w[k : k + size]) for k in range(0, len(w), size))


def best_dice(text, template):
    """The best coefficient over all windows of a text, by trying all starts and ends at bigrams of the template."""
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    bigrams, known = list(zip(w, w[1:])), {tuple(b.split()) for b in licenses.template_bigrams(template)}
    at = [i for i, b in enumerate(bigrams) if b in known]
    best = 0.0
    for k, a in enumerate(at):
        seen, hits, last = set(), set(), a
        for z in at[k:]:
            if z - a > 2 * len(known):
                break
            seen.update(bigrams[last : z + 1])
            hits.add(bigrams[z])
            last = z + 1
            best = max(best, 2 * len(hits) / (len(seen) + len(known)))
    return best


def test_license_scan(spark, docs, empty):
    notice = licenses.TEMPLATES["Apache-2.0 notice"]
    scan = lambda data: {(r[0], r[1]): (r[2], r[3]) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    got = scan([(1, f"some other text that is here\n{notice}\nand then even more of it"), (2, licenses.TEMPLATES["MIT"].replace("\n", " ")), (3, "Licensed under the Apache"), (4, None), (5, ""), (6, f"{notice}\n{PROSE}\n{notice.upper()}"), (7, "x " * 5000), (8, PROSE)])
    assert got == {(1, "Apache-2.0 notice"): (1, 1.0), (2, "MIT"): (1, 1.0), (6, "Apache-2.0 notice"): (2, 1.0)}
    names = [n for n in licenses.TEMPLATES if "notice" not in n]
    code = "\n".join(f"    value_{k} = compute(value_{k - 1}, {k})" for k in range(60))

    def inside(text, mark):
        lines = wrapped(text, 9).split("\n")
        lines[len(lines) // 3 : len(lines) // 3] = [""]
        lines[2 * len(lines) // 3 : 2 * len(lines) // 3] = [""]
        return f"{code}\n" + "\n".join(f"{mark} {x}" for x in lines) + f"\n{code}"

    files = [(10 * k + j, inside(licenses.TEMPLATES[name], mark)) for k, name in enumerate(names) for j, mark in enumerate((" *", "#", "//", ""))]
    files += [(10 * k + 4, wrapped(PROSE) + "\n\n" + wrapped(licenses.TEMPLATES[name]) + "\n\n" + wrapped(PROSE)) for k, name in enumerate(names)]
    found = scan(files)
    assert {i for i, _ in found} == {i for i, _ in files}
    assert all(found.pop((10 * k + j, name))[1] >= 0.95 for k, name in enumerate(names) for j in range(5)) and not found
    repeated = [(1, notice), (1, notice), (None, notice)]
    assert {(r[0], r[2]) for r in licenses.scan(spark.createDataFrame(repeated, "doc_id long, text string")).collect() if r[1] == "Apache-2.0 notice"} == {(1, 2), (None, 1)}
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs, templates={}).count() == 0
    for n in range(1, 60):
        lo, hi = licenses.size_bounds(n)
        assert all((2 * min(k, n) / (k + n) >= 0.8 - 1e-12) == (lo <= k <= hi) for k in range(1, 200))


def test_license_texts_and_edits_against_all_windows(spark):
    """Whole texts in prose, and damaged notices: found where some window reaches the threshold clearly, not where none does."""
    rng = random.Random(14)
    whole = licenses.whole_texts()
    files = [(k, f"{wrapped(PROSE)}\n\n{wrapped(t, 11)}\n\n{wrapped(PROSE)}") for k, t in enumerate(whole.values())]
    scan = lambda data, **o: {(r[0], r[1]): r[3] for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string"), **o).collect()}
    found = scan(files)
    assert {(i, n) for i, n in found if n in whole} == {(k, n) for k, n in enumerate(whole)} and min(found[k, n] for k, n in enumerate(whole)) >= 0.98
    names = ["MIT", "ISC", "zlib", "GPL-3.0-or-later", "Apache-2.0"]
    edited, clear = [], 0
    for k in range(60):
        w = licenses.TEMPLATES[names[k % 5]].split()
        for _ in range(rng.randint(0, len(w) // 4)):
            w[rng.randrange(len(w))] = rng.choice(PROSE.split())
        w[len(w) // 2 : len(w) // 2] = PROSE.split()[: rng.choice([0, 0, 10, 60])]
        edited.append((k, f"{PROSE}\n{' '.join(w)}\n{PROSE}"))
    found = scan(edited, templates={n: licenses.TEMPLATES[n] for n in names})
    for k, t in edited:
        best = best_dice(t, licenses.TEMPLATES[names[k % 5]])
        got = found.get((k, names[k % 5]), 0)
        clear += best >= 0.82
        assert best >= 0.8 - 1e-9 or not got
        assert got <= best + 1e-6 and (best < 0.82 or got >= best - 0.02), (k, best, got)
    assert 10 < clear < 60


# 7


def brute_substrings(texts, span=50):
    first = {}
    for i, t in texts:
        for p in range(len(t) - span + 1):
            first[t[p : p + span]] = min(first.get(t[p : p + span], i), i)
    out = Counter()
    for i, t in texts:
        keep = bytearray(b"\1" * len(t))
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < i:
                keep[p : p + span] = bytes(span)
        runs = sum(1 for q in range(len(t)) if not keep[q] and (q == 0 or keep[q - 1]))
        out[i, len(t), len(t) - sum(keep), runs, bytes(a for a, b in zip(t, keep) if b)] += 1
    return out


def test_suffix_arrays(monkeypatch):
    rng = np.random.default_rng(3)
    for trial in range(150):
        t = rng.integers(0, rng.integers(1, 6), rng.integers(1, 150)).astype(np.uint8)
        t = np.tile(t[: max(1, len(t) // 7)], 8) if trial % 3 == 0 else t
        monkeypatch.setattr(suffixes.Queues.__init__, "__defaults__", (5,) if trial % 4 == 0 else (1 << 22,))
        monkeypatch.setattr(suffixes, "PIECE", 3 if trial % 4 == 0 else 1 << 18)
        got = np.concatenate(list(suffixes.suffix_array(t, base=(0, 1, 1000)[trial % 3])))[::-1].tolist()
        b = t.tobytes()
        assert got == sorted(range(len(b)), key=lambda i: b[i:])


def test_substrings_are_removed(spark, docs, empty):
    got = substrings.remove_repeats(docs).collect()
    assert Counter((order(r[0]), r[1], r[2], r[3], bytes(r[4])) for r in got) == brute_substrings(rows())
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() * rng.randint(1, 6)) for i in range(30)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in texts], "doc_id long, text string").repartition(4)
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in substrings.remove_repeats(df).collect()) == brute_substrings(texts)
    assert substrings.remove_repeats(empty).count() == 0
    clean = substrings.clean(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count() and clean.where("text is null").count() == 2


def test_a_hot_key_is_dealt_over_shards(spark):
    rng = random.Random(12)
    own = lambda: "".join(rng.choice("bcdfghjkü") for _ in range(60))
    line = "every document of this table has the same line, and it is long enough"
    texts = [(i, f"{own()}{line}{own()}".encode()) for i in range(200)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in texts], "doc_id long, text string").repartition(3)
    for hot in (100, 2000):
        got = substrings.remove_repeats(df, hot_bytes=hot).collect()
        assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == brute_substrings(texts)
    # One segment in every block is one segment; as many that differ are hot.
    blocks_ = [substrings._Block(pa.table({"block": [k] * 2, "c0": [2 * k, 2 * k + 1], "text": [line] * 2}), 50) for k in range(300)]

    def told(x, salt=0):
        of, size, name = x.distinct()
        return mail.pack(d=mail.deltas(x.unique), m=np.packbits(x.many), i=x.low, c=np.bincount(of, minlength=len(x.unique)).astype(np.uint32), b=(size // substrings.SIZE_STEP + 1).astype(np.uint32), h=name + np.uint16(salt))

    fans = lambda payloads: {int(f) for p in substrings._in_two(payloads, 2000) for f in mail.unpack(p)["f"]}
    assert fans([told(x) for x in blocks_]) == {1} and min(fans([told(x, k) for k, x in enumerate(blocks_)])) > 1
    block = substrings._Block(pa.table({"block": [1] * 200, "c0": [i for i, _ in texts], "text": [t.decode() for _, t in texts]}), 50)
    shared = block.many
    block.segments(shared.astype(np.int64))
    few = len(np.unique(block.keys))
    block.segments(np.where(shared, 50, 0))
    assert len(np.unique(block.keys)) > 20 * few


def test_messages_of_substrings_are_few_and_shards_work_in_parts():
    # 6 GB of Parquet hold about 10 GB of text: with blocks of 1 MB and shards of 4 MB there were 26 million pairs.
    assert -(-10_200_000_000 // substrings.BLOCK_BYTES) * substrings.shard_count(10_200_000_000, 600, 12) < 1_000_000
    assert substrings.shard_count(0, 4, 4) == 4 and substrings.shard_count(1 << 30, 600, 2) == 32
    rng = random.Random(21)
    common = ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(20)]
    text = lambda: "".join(rng.choice(common)[rng.randint(0, 60) :] + rng.choice("xyz") for _ in range(4))
    blocks_ = [substrings._Block(pa.table({"block": [k] * 9, "c0": [9 * k + i for i in range(9)], "text": [text() for _ in range(9)]}), 50) for k in range(5)]
    told = []
    for x in blocks_:
        of, size, name = x.distinct()
        told.append(mail.pack(d=mail.deltas(x.unique), m=np.packbits(x.many), i=x.low, c=np.bincount(of, minlength=len(x.unique)).astype(np.uint32), b=(size // substrings.SIZE_STEP + 1).astype(np.uint32), h=name))
    whole = substrings._in_two(told, 200)
    assert substrings._in_two(told, 200, 7) == whole
    sent = []
    for x, p in zip(blocks_, whole, strict=True):
        x.segments(mail.unpack(p)["f"].astype(np.int64))
        sent.append(mail.pack(d=mail.deltas(x.keys), ids=x.first, size=x.size.astype(np.uint32), text=x.data[substrings._spans(x.where, x.size)]))
    marks = substrings._smaller_has(50)(0, sent)
    assert substrings._smaller_has(50, 300)(0, sent) == marks and any(any(m) for m in marks)


# 8


def test_quality_on_held_out_labels(spark, empty):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = lambda: " ".join(word() for _ in range(40)) + "."
    junk = lambda k: [" ".join(word() + "$$$" for _ in range(40)), " ".join([word()] * 40), " | ".join(word() for _ in range(20))][k % 3]
    data = [(i, good() if i % 4 else junk(i // 4)) for i in range(600)] + [(900, None), (901, " ")]
    data += [data[1], data[5], (None, good()), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("quality", "_key", "_w", "importance", "_labelled", "_good")})
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 600, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality.resample(df, labels).select("doc_id", "text", "importance.*").collect()
    assert sum(r["drawn"] != (r["doc_id"] % 4 > 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 600) <= 2
    # Counts and ratios bucket by bucket, and the draw by sorting.
    marked = {i for i in range(0, 600, 2) if i % 4 > 0}
    buckets = [[x.tolist() for x in quality.features(next(blocks(pa.array([r["text"]]))))[0]] if r["text"] else [[]] * 3 for r in out]
    ratio = {}
    for kind, size in enumerate(quality._SIZES):
        raw, target = Counter(), Counter()
        for r, b in zip(out, buckets, strict=True):
            raw.update(b[kind])
            target.update(b[kind] if r["doc_id"] in marked else [])
        ratio |= {x: math.log((target[x] + 0.5) / (target.total() + 0.5 * size)) - math.log((raw[x] + 0.5) / (raw.total() + 0.5 * size)) for x in raw}
    for r, b in zip(out, buckets, strict=True):
        weight = quality.TOKENS * sum(ratio[x] for part in b for x in part) / (len(b[0]) + quality.PRIOR) if any(b) else None
        assert (r["log_weight"] is None) == (weight is None) and (weight is None or abs(r["log_weight"] - weight) < 1e-6)
        assert weight is None or -3.5 < r["gumbel_key"] - weight < 12
    count = sum(r["drawn"] for r in out)
    assert sorted((r["gumbel_key"] for r in out), reverse=True)[:count] == sorted((r["gumbel_key"] for r in out if r["drawn"]), reverse=True)
    noise = [r["gumbel_key"] - r["log_weight"] for r in out if r["log_weight"] is not None]
    assert abs(np.mean(noise) - 0.5772) < 0.2
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id >= 900").count() == 0 and kept.where("_key = 'clash'").count() == kept.count() > 0
    assert quality.resample(df, labels, count=10).where("importance.drawn").count() == 10
    assert quality.keep_good(empty, labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).count() == df.where("trim(text) <> ''").count()
    assert quality.keep_good(df, labels.where("quality = 0")).count() == 0


def test_quality_draws_by_weight(spark):
    """Two seeds draw other rows, how often a row is drawn follows its weight, and the k-th key is that of a sort."""
    rng = random.Random(3)
    word = lambda v: rng.choice(v)
    both = [[f"g{k}" for k in range(30)], [f"r{k}" for k in range(30)]]
    data = [(i, " ".join(word(both[rng.random() > i / 300]) for _ in range(30))) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").cache()
    labels = spark.createDataFrame([(i, int(i > 150)) for i in range(300)], "doc_id long, quality int")
    draws, weights = [], {}
    for seed in range(5):
        out = quality.resample(df, labels, count=60, seed=seed).select("doc_id", "importance.*").collect()
        draws.append({r["doc_id"] for r in out if r["drawn"]})
        weights = {r["doc_id"]: r["log_weight"] for r in out}
    best = {i for i in sorted(weights, key=lambda i: -weights[i])[:60]}
    assert all(len(d) == 60 and d != best for d in draws) and len({frozenset(d) for d in draws}) == 5
    order_ = sorted(weights, key=lambda i: weights[i])
    share = [sum(i in d for d in draws for i in order_[a : a + 100]) for a in (0, 100, 200)]
    assert share[0] < share[1] < share[2]
    # The share of top-k draws that weights foretell: exponential races, simulated.
    race = np.array([weights[i] for i in order_])[None, :] - np.log(-np.log(np.random.default_rng(1).random((4000, 300))))
    told = (race.argsort(1).argsort(1) >= 240).mean(0)
    assert abs(sum(told[200:]) - share[2] / 5) < 8 and abs(sum(told[:100]) - share[0] / 5) < 6
    for values in ([1.0] * 50 + [2.0] * 3, [rng.gauss(0, 1e6) for _ in range(3000)], [-1e12] * 9 + [1e-9 * k for k in range(900)]):
        keys = spark.createDataFrame([(v,) for v in values], "k double")
        for at in (1, 3, 5, 51, len(values), len(values) + 1):
            want = sorted(values, reverse=True)[at - 1] if at <= len(values) else -math.inf
            with pytest.MonkeyPatch.context() as m:
                m.setattr(quality, "LAST", 20)
                assert quality.kth_largest(keys, at) == want


# 9


def brute_simhash(t):
    w = t.lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_components(docs, empty):
    got = simhash.components(docs).collect()
    prints = [(i, brute_simhash(t)) for i, t in rows()]
    assert Counter((order(r[0]), r[1] & (1 << 64) - 1) for r in got) == Counter(prints)
    name = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 2 and name[a] != name[b]:
                    name[a] = name[b] = min(name[a], name[b])
                    changed = True
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in zip(name, prints):
        least[k] = min(least[k], i if i != order(None) else 10**9)
    assert Counter((order(r[0]), r[2]) for r in got) == Counter((i, least[k]) for k, (i, _) in zip(name, prints))
    clash = docs.withColumns({c: F.lit(c) for c in ("_kept", "name", "at", "bands", "packed")})
    kept = simhash.drop_near_duplicates(clash)
    assert kept.columns == clash.columns and kept.select(docs.columns).exceptAll(simhash.drop_near_duplicates(docs)).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_beside_texts_that_are_nearly_so(spark):
    """Two texts at 0.8 whose common shingles 60 others have too, which are at 0.76 from both and all others."""
    texts = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(49)]
        texts += [" ".join([*base[:20], f"f{family}{x}", *base[21:]]) for x in "ab"]
        texts += [" ".join([*base[:20], f"f{family}x{k}", f"f{family}y{k}", *base[22:]]) for k in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r[0] for r in simhash.drop_near_duplicates(table).collect()}
    assert set(range(len(texts))) - kept == {62 * family + 1 for family in range(6)}


def test_near_duplicates_at_four_fifths(spark):
    rng = random.Random(5)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    texts = []
    for k in range(60):
        w = [f"w{rng.randrange(5000)}" for _ in range(120 + k)]
        for edits in (0, 2, 4, 9):  # every edited word changes five shingles
            v = list(w)
            for at in range(edits):
                v[10 + 12 * at] = f"e{k}x{at}x{edits}"
            texts.append(" ".join(v))
    texts += ["one two three four", "ONE two three  four", "one two three five", "", None, "  "]
    sets = [shingles(t or "") for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = list(range(len(texts)))
    for a in range(240):
        for b in range(a // 4 * 4, a):
            if like(a, b):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    group[241], group[244], group[245] = 240, 243, 243
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r[0] for r in simhash.drop_near_duplicates(table).collect()) == sorted(set(group))


def test_near_duplicates_of_one_text_are_compared_with_it(spark, monkeypatch):
    """Of 300 edited copies of a text, alike and unlike one another, few pairs are compared, and no link is left out."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(300):
        w = list(base)
        for at in rng.sample(range(4, 116), 1 + k % 4):
            w[at] = f"e{k}x{at}" if k % 3 else "same"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    group = list(range(len(texts)))
    alike = 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                alike += 1
                if group[a] != group[b]:
                    group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert 2 < len(set(group)) < 150 and alike > 10 * len(texts)
    compared, linked = [], simhash._linked

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return linked(pairs, *rest)

    monkeypatch.setattr(simhash, "_linked", counted)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for meetings in (64, 1):  # without rounds of pivots and with some
        monkeypatch.setattr(simhash, "MEETINGS", meetings, raising=False)
        compared.clear()
        assert sorted(r[0] for r in simhash.drop_near_duplicates(table).collect()) == sorted(set(group))
        assert sum(compared) < 8 * len(texts)
    assert len(compared) > 2


def test_maps_allow_all_that_are_alike(spark):
    """Bits in which maps differ are no more than shingles in which sets differ, and nearly as many for small sets."""
    rng = np.random.default_rng(4)
    for size, most in ((5, 1), (150, 30), (3000, 600)):
        base = rng.integers(0, 1 << 64, size + most, np.uint64, endpoint=False)
        sets = [np.unique(base[k : k + size]) for k in range(0, most + 1, max(1, most // 10))]
        h, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        bits = [np.array(x, np.int64).view(np.uint8) for x in simhash.maps(h, doc, len(sets)).to_pylist()]
        differ = [(len(np.setxor1d(sets[0], x)), int(np.unpackbits(bits[0] ^ y).sum())) for x, y in zip(sets, bits, strict=True)]
        assert all(got <= want for want, got in differ) and (size > 150 or all(got >= 0.8 * want for want, got in differ))


def test_chains_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (7, 7)], "a long, b long")
    assert {tuple(r) for r in connected_components(chain).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (103, 100), (105, 100)}


# 10


def slow_fingerprint(text):
    """Bin by bin, each empty one filled from the first full one in its order."""
    h = [int(x) for b in blocks(pa.array([text])) for x in minhash.shingle_hashes(words(b.lower()))[0]]
    if not h:
        return ""
    size, per = minhash.BINS, 8 // minhash.BITS
    shift = size.bit_length() - 1
    least = {}
    for x in h:
        least[x >> (64 - shift)] = min(least.get(x >> (64 - shift), 1 << 64), x & (1 << (64 - shift)) - 1)
    filled = [least[k] if k in least else least[next(int(j) for j in minhash._ORDER[k] if int(j) in least)] for k in range(size)]
    bits = [int(minhash.mix(np.array([(x + k * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0]) & (1 << minhash.BITS) - 1 for k, x in enumerate(filled)]
    return bytes(sum(bits[k + j] << (minhash.BITS * j) for j in range(per)) for k in range(0, size, per)).hex()


def test_fingerprints(docs, empty):
    got = minhash.edited_likeness(docs).collect()
    ordered = sorted(((r[0], r[1] or "") for r in corpus()), key=lambda x: (order(x[0]), x[1]))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r[0], r[1], r[2]) for r in got) == want
    prints = {r["fingerprint"] for r in got}
    assert prints == {slow_fingerprint(t) for _, t in ordered}
    assert minhash.edited_likeness(empty).count() == 0
    one = minhash.edited_likeness(docs.limit(1)).first()
    assert one["near_next"] == 1.0
    rng = random.Random(2)
    off = []
    for n in (3, 30, 300, 2000):
        a = [str(rng.random()) for _ in range(n)]
        b = a[: n * 2 // 3] + [str(rng.random()) for _ in range(n - n * 2 // 3)]
        x, y = ({tuple(t[i : i + 5]) for i in range(max(1, n - 4))} for t in (a, b))
        bits, some = minhash.low_bits(pa.array([" ".join(a), " ".join(b), " ".join(a)]))
        off.append(abs(minhash.likeness(bits[:1], some[:1], bits[1:2], some[1:2])[0] - len(x & y) / len(x | y)))
        assert (bits[0] == bits[2]).all()
    assert max(off) < 0.12
    for n in (1, 5, 6, 8, 40):  # texts of one shingle, two, four, many: none is like another
        texts = [" ".join(f"w{k}x{j}" for j in range(n)) for k in range(200)]
        bits, some = minhash.low_bits(pa.array(texts))
        near = np.concatenate([minhash.likeness(bits[k + 1 :], some[k + 1 :], np.repeat(bits[k : k + 1], 199 - k, 0), np.repeat(some[k : k + 1], 199 - k)) for k in range(199)])
        assert near.max() < 0.2 and near.mean() < 0.01, (n, near.max(), near.mean())
    hexes = minhash.packed(*minhash.low_bits(pa.array(["a b c d e f", None])))
    assert hexes[1] == "" and (minhash.unpacked(hexes)[0][0] == minhash.low_bits(pa.array(["a b c d e f"]))[0][0]).all()


# shared


def test_messages_round_trip():
    a = {"x": np.arange(5, dtype=np.uint64) << np.uint64(40), "y": np.zeros(0, np.uint8), "z": np.array([-1, 2], np.int32)}
    back = mail.unpack(mail.pack(**a))
    assert all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in a.items())
    v = np.array([3, 9, 1 << 63], np.uint64)
    assert (mail.undo_deltas(mail.deltas(v)) == v).all()
