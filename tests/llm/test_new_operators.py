"""Decontamination, target sampling and hard negatives against brute force and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import contamination, hard_negatives, target_sampling

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id long, label long, w string, rank long, _row long"


def words(text):
    return WORD.findall((text or "").translate(A_Z))


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdÉéßİ") for _ in range(rng.randint(1, 3)))
    line = lambda n: rng.choice([" ", ", ", "\n-"]).join(word() for _ in range(n))
    items = [(1, line(30)), (2, line(12)), (10, "One two three"), (11, "solo"), (12, ""), (13, None), (None, line(12)), (14, "... !"), (2, line(14)), (15, "a b a b a b a b a b a b a b")]
    items.append((16, items[0][1]))
    docs = [line(rng.randint(0, 80)) for _ in range(25)]
    docs += [line(5) + " " + items[0][1] + "! " + line(5), items[1][1].upper(), "x One, TWO three? y", "one two four three", "Solo", " solo SOLO ", "(" + items[8][1] + ")" + line(3), "a b " * 30, "b a " * 4]
    docs += [" ".join(items[0][1].split()[5:16]), line(4000) + items[1][1] + line(10), None, "", "  \n", "Ⅻ Ⓐ ǅ Ω ΑΣ", "x" * 3000 + " " + "Yz" * 40]
    table = [(k, t, 5, 6, "w", 7, 8) for k, t in enumerate(docs)]
    return table + table[25:28] + [(None, docs[25], 5, 6, "w", 7, 8), (None, None, 5, 6, "w", 7, 8)], items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = corpus()
    return spark.createDataFrame(docs, DOCS).repartition(3).cache(), spark.createDataFrame(items, "item_id long, text string").cache()


def brute_hits(docs, items, window):
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if i is not None and n:
            for p in range(len(w) - n + 1):
                known[tuple(w[p : p + n])].add(str(i))
    out = []
    for i, t, *_ in docs:
        w, hit, met = words(t), set(), set()
        for n in {len(k) for k in known}:
            for p in range(len(w) - n + 1):
                if (found := known.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    met |= found
        out.append((i, len(w), sorted(hit), sorted(met)))
    return out


@pytest.mark.parametrize("window, broadcast_bytes", [(10, 1 << 26), (3, 0), (1, 1 << 26)])
def test_contamination_matches_brute_force(tables, window, broadcast_bytes):
    docs, items = tables
    got = contamination.scan(docs, items, window=window, broadcast_bytes=broadcast_bytes, carried=("label", "_row")).collect()
    rows, known = corpus()
    want = Counter((i, n, tuple(h), tuple(m)) for i, n, h, m in brute_hits(rows, known, window))
    assert Counter((r["doc_id"], r["n_words"], tuple(p for s in r["spans"] for p in range(s["first"], s["last"] + 1)), tuple(r["items"])) for r in got) == want
    assert all(r["n_hit"] == sum(s["last"] - s["first"] + 1 for s in r["spans"]) and r["contaminated"] == (r["n_hit"] > 0) and (r["label"], r["_row"]) == (6, 8) for r in got)
    assert all(a["last"] + 1 < b["first"] for r in got for a, b in zip(r["spans"], r["spans"][1:]))


def test_contaminated_spans_and_documents_go(tables, spark):
    docs, items = tables
    rows, known = corpus()
    hits = brute_hits(rows, known, 10)
    cleaned = contamination.remove_spans(docs, items)
    assert cleaned.columns == docs.columns
    want = Counter()
    for (i, t, *_), (_, _, hit, _) in zip(rows, hits, strict=True):
        if hit:
            pieces = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*", t)
            t = re.match(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*", t)[0] + "".join(p for k, p in enumerate(pieces) if k not in set(hit))
        want[i, t] += 1
    assert Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == want
    left = contamination.remove_documents(docs, items)
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter((i, t) for (i, t, *_), h in zip(rows, hits, strict=True) if not h[2])
    some = contamination.remove_documents(docs, items, least_share=0.5)
    assert some.count() == sum(len(h[2]) == 0 or 2 * len(h[2]) < h[1] for h in hits)
    empty = spark.createDataFrame([], DOCS)
    assert contamination.scan(empty, items).count() == 0 and contamination.remove_spans(empty, items).count() == 0
    alone = contamination.scan(docs, items.limit(0)).collect()
    assert len(alone) == len(rows) and not any(r["contaminated"] or r["items"] for r in alone)


def test_contamination_stays_in_the_jvm(tables):
    docs, items = tables
    plan = contamination.scan(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def brute_weights(docs, items, max_n, buckets):
    def features(t):
        w = words(t)
        return Counter(zlib.crc32(" ".join(w[p : p + n]).encode()) % buckets for n in range(1, max_n + 1) for p in range(len(w) - n + 1)), len(w)

    raw, target = Counter(), Counter()
    each = [features(t) for _, t, *_ in docs]
    for f, _ in each:
        raw += f
    for _, t in items:
        target += features(t)[0]
    s, t = sum(raw.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in raw}
    out = []
    for (i, *_), (f, n) in zip(docs, each, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        out.append((i, n, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize("max_n, buckets, percent", [(1, 10_000, 10), (3, 64, 50)])
def test_target_sampling_matches_brute_force(tables, max_n, buckets, percent):
    docs, items = tables
    got = target_sampling.resample(docs, items, max_n=max_n, buckets=buckets, percent=percent).collect()
    want = brute_weights(*corpus(), max_n, buckets)
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(want)
    order = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], -1 if x[0] is None else x[0]))[: sum(x[1] >= 20 for x in want) * percent // 100]
    assert [(r["doc_id"], r["score"]) for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == [(x[0], x[4]) for x in order]
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == list(range(1, len(order) + 1))


def test_target_sampling_of_odd_tables(tables, spark):
    docs, items = tables
    assert target_sampling.resample(spark.createDataFrame([], DOCS), items).count() == 0
    lone = target_sampling.resample(docs, items.limit(0)).collect()
    assert len(lone) == len(corpus()[0])
    kept = target_sampling.drawn(docs, items, percent=50)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    alike = spark.createDataFrame([(i, "la " * 30) for i in range(200)], "doc_id long, text string")
    a, b = ({r["doc_id"] for r in target_sampling.resample(alike, items, seed=k).where("rank is not null").collect()} for k in (1, 2))
    assert len(a) == len(b) == 20 and a != b


def test_target_weights_raise_documents_like_the_target(spark):
    rng = random.Random(4)
    of = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    near, far = [f"n{k}" for k in range(50)], [f"f{k}" for k in range(50)]
    docs = spark.createDataFrame([(i, of(near if i % 10 == 0 else far, 40)) for i in range(400)], "doc_id long, text string")
    out = target_sampling.resample(docs, spark.createDataFrame([(1, of(near, 400))], "item_id long, text string")).where("rank is not null").collect()
    assert len(out) == 40 and all(r["doc_id"] % 10 == 0 for r in out)


def test_crc32_of_ranges():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(5000))
    cuts = [(a, a + rng.choice([0, 1, 5, 63, 64, 65, 300])) for a in (rng.randrange(4000) for _ in range(300))]
    got = target_sampling.crc32(np.frombuffer(data, np.uint8), np.array([a for a, _ in cuts]), np.array([b for _, b in cuts]))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in cuts]


def brute_mined(rows, positives, negatives):
    ok = [(n, i, v, y, a) for n, (i, v, y, a) in enumerate(rows) if v is not None and y is not None]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    for n, i, v, y, a in ok:
        if a and i is not None:
            scored = [(dot(v, w), j, z) for m, j, w, z, _ in ok if m != n]
            for s, p, _ in sorted((x for x in scored if x[2] == y), key=order)[:positives]:
                window = sorted((x for x in scored if x[2] != y and 30 * s <= 100 * x[0] <= 90 * s), key=order)[:negatives]
                out.update((i, p, k + 1, j, s, t) for k, (t, j, _) in enumerate(window))
    return out


@pytest.mark.parametrize("chunk_rows, scale, labels", [(8, 40, 4), (256, 40, 30), (16, 1 << 28, 3)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, chunk_rows, scale, labels):
    monkeypatch.setattr(hard_negatives, "FIRST", 2)
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(k, [int(x) for x in np.floor(scale * (centres[k % 6] + rng.normal(0, 0.3, 8)))], int(rng.integers(labels)), k % 9 == 0) for k in range(300)]
    rows += [(500 + k, rows[0][1], rows[0][2], False) for k in range(40)] + [(18, rows[18][1], 1, True), (18, rows[18][1], 1, True)]
    rows += [(900, None, 1, True), (901, [1] * 8, None, True), (None, rows[9][1], 2, True), (902, [scale], 0, True), (903, [], 1, True), (904, rows[3][1], -5, None)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, vector array<long>, label long, anchor boolean, n long, req string").repartition(3)
    got = Counter(map(tuple, hard_negatives.mine(df, chunk_rows=chunk_rows).collect()))
    assert got == brute_mined(rows, 5, 10)


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id long, vector array<long>, label long, anchor boolean"
    none = spark.createDataFrame([], schema)
    assert hard_negatives.mine(none).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1], 1, True)], schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [3], 1, True), (2, [3], 1, False), (3, [2], 2, False)], schema)).collect() == [(1, 2, 1, 3, 9, 6)]


def test_bounds_rule_out_cells_of_clustered_rows(spark, monkeypatch):
    """Boxes of tight clusters leave most pairs of nodes unscored, and bounds hold every inner product."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(-9, 9, (20, 5)), rng.integers(-9, 9, (30, 5))
    low, high = hard_negatives.interval(a.min(0), a.max(0), b.min(0), b.max(0))
    assert low <= (a @ b.T).min() and high >= (a @ b.T).max()
    x = np.concatenate([rng.normal(c, 0.01, (64, 4)) for c in np.outer([0, 10, 20, 30], [1, 0, 0, 0])])
    tree = hard_negatives.fit_tree(x, 4)
    leaf = hard_negatives.leaf_of(tree, x)
    assert len(tree) == 3 and all(len(set(leaf[k * 64 : k * 64 + 64])) == 1 for k in range(4)) and len(set(leaf)) == 4
    assert hard_negatives.leaf_of([], x).tolist() == [0] * 256 and hard_negatives.fit_tree(np.ones((50, 3)), 8) == []
    seen, real = [], hard_negatives._pairs
    monkeypatch.setattr(hard_negatives, "_pairs", lambda *a: seen.append(real(*a).count()) or real(*a))
    centres = rng.normal(0, 1, (8, 32))
    rows = [(k, [int(v) for v in 1000 * (centres[k % 8] + rng.normal(0, 0.01, 32))], 0, k < 8) for k in range(1024)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, label long, anchor boolean")
    assert hard_negatives.mine(df, chunk_rows=32).count() == 0
    chunks = 1024 // 32
    assert sum(seen) < 8 * chunks / 2


def test_hard_negatives_meet_shelves_not_chunks(spark, monkeypatch):
    """Without structure every group meets every row: payloads go to shelves of many chunks, in rounds, and k rows come back from each."""
    monkeypatch.setattr(hard_negatives, "FIRST", 4)
    rng = np.random.default_rng(4)
    rows = [(k, [int(x) for x in rng.integers(-40, 40, 6)], int(rng.integers(2)), k % 60 == 0) for k in range(600)]
    seen, real = [], hard_negatives._pairs
    monkeypatch.setattr(hard_negatives, "_pairs", lambda *a: seen.append(real(*a).count()) or real(*a))
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, label long, anchor boolean")
    assert Counter(map(tuple, hard_negatives.mine(df, chunk_rows=4).collect())) == brute_mined(rows, 5, 10)
    chunks, groups = 600 // 4, 2
    assert max(seen) < groups * chunks / 3
    cells = {"leaf": np.array([0, 0, 1, 2, 2]), "n": np.array([3, 4, 2, 30, 1])}
    first, number = hard_negatives._shelves(cells, 10)
    assert first.tolist() == [0, 0, 0, 1, 1] and number.tolist() == [1, 1, 1, 4, 4]
    monkeypatch.setattr(hard_negatives, "GROW", 2)
    monkeypatch.setattr(hard_negatives, "SHELF_VALUES", 60)
    assert Counter(map(tuple, hard_negatives.mine(df, chunk_rows=4).collect())) == brute_mined(rows, 5, 10)


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64])
def test_rows_taken_from_a_shelf(monkeypatch, kind):
    monkeypatch.setattr(hard_negatives, "HELD", 20)
    monkeypatch.setattr(hard_negatives, "SCORED_ROWS", 16)
    rng = np.random.default_rng(5)
    m, label, n = rng.integers(-9, 9, (200, 3)), rng.integers(0, 3, 200), np.arange(200)
    held = [(c, hard_negatives.pack(n=n[c::4], id=n[c::4] // 2, none=(n[c::4] > 190).astype(np.uint8), label=label[c::4], m=m[c::4].reshape(-1).astype(np.int16))) for c in range(4)]
    shelf = hard_negatives._Shelf(held, 3, kind)
    far = 1 << 62
    who = np.repeat(np.arange(4), [1, 2, 3, 1]).astype(np.int32)
    q = {"who": who, "n": n[:4], "m": m[:4].reshape(-1), "label": label[who], "least": np.array([-far, 5, -20, 0, 30, -far, 9]), "high": np.array([far, 60, 10, 50, 90, far, 9])}
    for same in (True, False):
        for cells in ([0, 1, 2, 3], [1, 3]):
            row, place, score = hard_negatives._taken(shelf, np.array(cells), q, 3, kind, same, 4)
            want = set()
            for r, w in enumerate(who):
                s = m @ m[w]
                ok = [x for x in n if x % 4 in cells and x != w and (label[x] == label[w]) == same and q["least"][r] <= s[x] <= q["high"][r]]
                want |= {(r, x, s[x]) for x in sorted(ok, key=lambda x: (-s[x], x > 190, x // 2, x))[:4]}
            assert set(zip(row.tolist(), shelf.n[place].tolist(), score.tolist(), strict=True)) == want
