"""Hard negatives by dual-tree search: exact inner products under bounds of node pairs.

A binary tree of median cuts, fitted on a bounded sample, deals all rows into
leaves; a leaf's rows of one label class are a cell, cut into chunks of a
bounded number of rows, and neighbouring leaves share shelves of a bounded
size. Requests (an anchor, a label rule, a window of scores, k) are grouped by
coarser nodes of the same tree. Every node has a box, the least and most of
each component, and two boxes bound the inner products of all their pairs: a
group meets a cell only where the upper bound reaches the least k-th score
that the group still waits for and the lower bound lies within its windows.
Each group looks at its most promising cells first, then in rounds at ``GROW``
times as many rows, so that k-th scores prune by what was found before. A task
holds one shelf's rows, groups stream past and are scored exactly: rows are
not carried to each group, and a group leaves k rows a request in a shelf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .mail import pack, unpack
from .shared import shuffle_partitions, small_batches, stored
from .topk import _matrix

#: Rows of a chunk, requests of a group, leaves and sampled rows of the tree at most, classes of labels.
CHUNK_ROWS, GROUP_ROWS, LEAVES, SAMPLE_ROWS, CLASSES = 256, 256, 512, 8192, 16
#: Candidates that a group looks at first, as a multiple of its k, and times as many in each round after it.
FIRST, GROW = 16, 32
#: Components of a shelf's rows at most (a leaf's last shelf may have one chunk a class more), rows scored at once, candidates held before they are cut to k.
SHELF_VALUES, SCORED_ROWS, HELD = 1 << 23, 2048, 1 << 18


def fit_tree(sample: np.ndarray, leaves: int) -> list[tuple[np.ndarray, float, int, int]]:
    """Nodes (direction, cut, left, right) of a tree with at most ``leaves`` leaves; children below 0 are leaves, -1 the first.

    The largest node is cut at the median along the direction of most spread;
    leaves are numbered from left to right, so that near numbers share nodes.
    """
    tree: dict[int, tuple[np.ndarray, float, int, int]] = {}
    open_nodes = [(len(sample), 0, sample)]
    count, fresh = 1, 1
    while open_nodes and count < leaves:
        open_nodes.sort(key=lambda x: (-x[0], x[1]))
        _, at, rows = open_nodes.pop(0)
        middle = rows - rows.mean(0)
        direction = middle[np.abs(middle).sum(1).argmax()]
        for _ in range(6):  # towards the main axis
            turned = middle.T @ (middle @ direction)
            if not np.linalg.norm(turned) > 0:
                break
            direction = turned / np.linalg.norm(turned)
        place = rows @ direction
        cut = float(np.median(place))
        left = place <= cut
        if left.all():
            continue
        tree[at] = (direction, cut, fresh, fresh + 1)
        open_nodes += [(int(left.sum()), fresh, rows[left]), (int((~left).sum()), fresh + 1, rows[~left])]
        count, fresh = count + 1, fresh + 2
    # Number nodes anew from left to right.
    out: list = []
    seen = [0]

    def put(at: int) -> int:
        if at not in tree:
            seen[0] += 1
            return -seen[0]
        mine = len(out)
        out.append(None)
        direction, cut, a, b = tree[at]
        out[mine] = (direction, cut, put(a), put(b))
        return mine

    put(0)
    return out


def leaf_of(tree: list[tuple[np.ndarray, float, int, int]], x: np.ndarray) -> np.ndarray:
    """The leaf, from 0, of each row."""
    at = np.zeros(len(x), np.int64) if tree else np.full(len(x), -1)
    for k, (direction, cut, left, right) in enumerate(tree):  # children come after their node
        here = np.flatnonzero(at == k)
        if len(here):
            at[here] = np.where(x[here] @ direction <= cut, left, right)
    return -at - 1


def interval(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most inner products of vectors in boxes a and b (the last axis holds components), with slack for rounding."""
    ends = np.stack([a_lo * b_lo, a_lo * b_hi, a_hi * b_lo, a_hi * b_hi])
    slack = np.abs(ends).max(0).sum(-1) * 1e-12
    return ends.min(0).sum(-1) - slack, ends.max(0).sum(-1) + slack


def _boxes(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.values if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().values
    return np.asarray(flat, float).reshape(-1, dim)


def _chunked(df: DataFrame, keys: list[str], rows: int, by: Column) -> DataFrame:
    """``df`` with ``chunk``: rows of one key are dealt by the hash ``by`` over as many chunks as keep ``rows`` on average.

    There are at most leaves times classes keys, whose counts are broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(F.broadcast(counts), keys).withColumn("chunk", F.pmod(by, F.ceil(F.col("_n") / F.lit(rows))).cast("int")).drop("_n")


def _narrow(most: float) -> type:
    """Integers for components of vectors with squared lengths up to ``most``."""
    return np.int16 if most < 1 << 30 else np.int64


def _packed_chunks(rows: DataFrame, dim: int, kind: type) -> DataFrame:
    """(leaf, cls, chunk, n, low_label, high_label, lo, hi, payload): the rows of each chunk as one."""

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        m = _matrix(t["vector"].combine_chunks() if t.num_rows else t["vector"], dim)
        ids = t["vec_id"]
        none = np.asarray(ids.is_null()).astype(np.uint8)
        label = np.asarray(t["label"])
        payload = pack(n=np.asarray(t["n"]), id=np.asarray(ids.fill_null(0)), none=none, label=label, m=m.reshape(-1).astype(kind))
        lists = lambda x: pa.array([x], pa.list_(pa.int64()))
        head = {k: t[k].slice(0, 1) for k in ("leaf", "cls", "chunk")}
        return pa.table(head | {"n": pa.array([t.num_rows], pa.int64()), "low_label": pa.array([label.min()], pa.int64()), "high_label": pa.array([label.max()], pa.int64()), "lo": lists(m.min(0)), "hi": lists(m.max(0)), "payload": pa.array([payload], pa.binary())})

    return rows.groupBy("leaf", "cls", "chunk").applyInArrow(one, "leaf int, cls int, chunk int, n long, low_label long, high_label long, lo array<long>, hi array<long>, payload binary")


def _cells(chunks: DataFrame, dim: int) -> dict[str, np.ndarray]:
    """Boxes, counts and label ranges of all cells: at most leaves times classes, whatever the number of rows."""
    flat = chunks.select("leaf", "cls", "n", "low_label", "high_label", F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "e"))
    per = flat.groupBy("leaf", "cls", "d").agg(F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi"), F.sum("n").alias("n"), F.min("low_label").alias("low_label"), F.max("high_label").alias("high_label"))
    whole = per.groupBy("leaf", "cls").agg(F.sort_array(F.collect_list(F.struct("d", "lo", "hi"))).alias("e"), F.first("n").alias("n"), F.min("low_label").alias("low_label"), F.max("high_label").alias("high_label"))
    t = whole.select("leaf", "cls", "n", "low_label", "high_label", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")).toArrow()
    out = {k: np.asarray(t[k]) for k in ("leaf", "cls", "n", "low_label", "high_label")}
    return out | {k: np.array([np.asarray(x.values, float) for x in t[k]]).reshape(len(t), dim) for k in ("lo", "hi")}


def _groups(requests: DataFrame, dim: int, leaves: int, total: int, classes: int, kind: type) -> DataFrame:
    """(g, cls, ..., payload): requests (req, n, label, leaf, cls, vector, low, high, least) in groups that share a node and a class."""
    nodes = max(1, min(leaves, total // (GROUP_ROWS * classes)))
    node = F.floor(F.col("leaf") * F.lit(nodes) / F.lit(leaves)).cast("int")
    cut = _chunked(requests.withColumn("node", node), ["node", "cls"], GROUP_ROWS, F.xxhash64("n"))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "ascending"), ("req", "ascending")]).combine_chunks()
        m = _matrix(t["vector"].combine_chunks(), dim)
        own, first, who = np.unique(np.asarray(t["n"]), return_index=True, return_inverse=True)
        label, low, high, least = (np.asarray(t[k]) for k in ("label", "low", "high", "least"))
        payload = pack(req=np.asarray(t["req"]), who=who.astype(np.int32), n=own, m=m[first].reshape(-1).astype(kind), label=label, low=low, high=high, least=least)
        lists = lambda x: pa.array([x], pa.list_(pa.int64()))
        name = f"{t['node'][0]}/{t['cls'][0]}/{t['chunk'][0]}"
        return pa.table({"g": pa.array([name]), "cls": t["cls"].slice(0, 1), "low_label": pa.array([label.min()], pa.int64()), "high_label": pa.array([label.max()], pa.int64()), "wanted": pa.array([least.min()], pa.int64()), "most": pa.array([high.max()], pa.int64()), "lo": lists(m.min(0)), "hi": lists(m.max(0)), "payload": pa.array([payload], pa.binary())})

    return cut.groupBy("node", "cls", "chunk").applyInArrow(one, "g string, cls int, low_label long, high_label long, wanted long, most long, lo array<long>, hi array<long>, payload binary")


def _shelves(cells: dict[str, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell the first of its leaf's shelves and their number: small leaves share one while it has less than ``rows`` rows, large ones take several."""
    first, number = np.zeros(len(cells["n"]), np.int64), np.ones(len(cells["n"]), np.int64)
    fresh, held = 0, 0
    for leaf in np.unique(cells["leaf"]):
        here = cells["leaf"] == leaf
        n = int(cells["n"][here].sum())
        if held and held + n > rows:
            fresh, held = fresh + 1, 0
        first[here], number[here] = fresh, -(-n // rows)
        if n >= rows:
            fresh, held = fresh + -(-n // rows), 0
        else:
            held += n
    return first, number


def _pairs(groups: DataFrame, cells: dict[str, np.ndarray], dim: int, same: bool, after: int, until: int | None) -> DataFrame:
    """(shelf, cells, payload): each group beside each shelf that has some of its cells.

    A group's cells are in the order of their upper bounds; those go that hold
    its best ``after`` rows, and those beyond ``until`` rows (None: beyond none)
    or below the scores it waits for.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi = _boxes(b.column("lo"), dim), _boxes(b.column("hi"), dim)
            for i, (cls, low_label, high_label, wanted, most) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cls", "low_label", "high_label", "wanted", "most")), strict=True)):
                down, up = interval(lo[i], hi[i], cells["lo"], cells["hi"])
                if same:
                    open_ = (cells["cls"] == cls) & (cells["low_label"] <= high_label) & (cells["high_label"] >= low_label)
                else:
                    open_ = ~((cells["low_label"] == cells["high_label"]) & (low_label == high_label) & (cells["low_label"] == low_label))
                open_ &= down <= most
                place = np.flatnonzero(open_)
                place = place[np.lexsort((cells["cls"][place], cells["leaf"][place], -up[place]))]
                total = np.cumsum(cells["n"][place])
                cuts = [0 if n == 0 else len(place) if n is None else int(np.searchsorted(total, n)) + 1 for n in (after, until)]
                place = place[cuts[0] : cuts[1]]
                place = place[up[place] >= wanted]
                number = cells["number"][place]
                cell = np.repeat(place, number)
                shelf = np.repeat(cells["first"][place], number) + np.arange(len(cell)) - np.repeat(np.cumsum(number) - number, number)
                order = np.argsort(shelf, kind="stable")
                shelf, cell = shelf[order], cell[order]
                names, at = np.unique(shelf, return_index=True)
                at = np.append(at, len(shelf))
                for k in range(0, len(names), 128):
                    n = len(names[k : k + 128])
                    own = pa.ListArray.from_arrays(pa.array(at[k : k + n + 1] - at[k], pa.int32()), pa.array(cell[at[k] : at[k + n]], pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(names[k : k + n], pa.int32()), own, b.column("payload").take(pa.array(np.full(n, i)))], names=["shelf", "cells", "payload"])

    spread = groups.repartition(shuffle_partitions(groups.sparkSession))
    return spread.mapInArrow(meet, "shelf int, cells array<int>, payload binary")


class _Shelf:
    """The rows of a shelf, those of a cell side by side."""

    def __init__(self, held: list[tuple[int, bytes]], dim: int, kind: type):
        held = sorted(held, key=lambda x: x[0])
        parts = [unpack(p) for _, p in held]
        self.m = np.concatenate([x["m"].reshape(-1, dim).astype(kind) for x in parts])
        self.n, self.id, self.none, self.label = (np.concatenate([x[c] for x in parts]) for c in ("n", "id", "none", "label"))
        cell = np.repeat([c for c, _ in held], [len(x["n"]) for x in parts])
        self.cells, first = np.unique(cell, return_index=True)
        self.at = np.append(first, len(cell))

    def runs(self, cells: np.ndarray) -> Iterator[np.ndarray]:
        """Places of the cells' rows, at most ``SCORED_ROWS`` at once."""
        here = np.flatnonzero(np.isin(self.cells, cells))
        if len(here):
            place = np.concatenate([np.arange(self.at[c], self.at[c + 1]) for c in here])
            for k in range(0, len(place), SCORED_ROWS):
                yield place[k : k + SCORED_ROWS]


def _taken(shelf: _Shelf, cells: np.ndarray, q: dict[str, np.ndarray], dim: int, kind: type, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(request, place, score): the k best rows of the cells that each request of a group takes."""
    m, least, high = q["m"].reshape(-1, dim).astype(kind), q["least"].copy(), q["high"]
    # Requests of one anchor follow one another; its scores are first held against all of their windows at once.
    begin = np.searchsorted(q["who"], np.arange(len(m) + 1))
    found: list[tuple[np.ndarray, ...]] = []
    held = 0

    def cut() -> tuple[np.ndarray, ...]:
        row, at, s = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))
        order = np.lexsort((shelf.n[at], shelf.id[at], shelf.none[at], -s, row))
        row, at, s = row[order], at[order], s[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], at[keep], s[keep]

    edge = 1 << 24 if kind is np.float32 else (1 << 62)
    for place in shelf.runs(cells):
        low_of, high_of = np.minimum.reduceat(least, begin[:-1]).clip(-edge, edge), np.maximum.reduceat(high, begin[:-1]).clip(-edge, edge)
        whole = place[-1] - place[0] + 1 == len(place)
        scores = m @ (shelf.m[place[0] : place[-1] + 1] if whole else shelf.m[place]).T
        as_kind = lambda x: x.astype(kind)[:, None]
        who, col = np.nonzero((scores >= as_kind(low_of)) & (scores <= as_kind(high_of)))
        score, at = scores[who, col].astype(np.int64), place[col]
        other = q["n"][who] != shelf.n[at]
        who, score, at = who[other], score[other], at[other]
        number = begin[who + 1] - begin[who]
        ends = np.cumsum(number)
        row = np.repeat(begin[who] - (ends - number), number) + np.arange(ends[-1] if len(ends) else 0)
        score, at = np.repeat(score, number), np.repeat(at, number)
        good = (score >= least[row]) & (score <= high[row]) & ((q["label"][row] == shelf.label[at]) == same)
        found.append((row[good], at[good], score[good]))
        held += len(found[-1][0])
        if held > HELD:
            found[:] = [cut()]
            row, _, score = found[0]
            held = len(row)
            full = np.flatnonzero(np.bincount(row, minlength=len(least)) == k)
            last = np.searchsorted(row, full, "right") - 1
            least[full] = np.maximum(least[full], score[last])
    return cut()


def _scored(pairs: DataFrame, chunks: DataFrame, dim: int, most: float, same: bool, k: int) -> DataFrame:
    """(req, n, vec_id, score): for each pair of a group and a shelf the k best rows that each request takes."""
    # Sums of products are whole numbers of at most ``most`` in size, whatever their order: exact in the first kind that holds it.
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, shelf = None, [], None
        for b in batches:
            name, cells, payload = b.column("shelf").to_pylist(), b.column("cells"), b.column("payload")
            for i, (at, cell) in enumerate(zip(name, b.column("cell").to_pylist(), strict=True)):
                if at != here:
                    here, held, shelf = at, [], None
                if cell is not None:
                    held.append((cell, payload[i].as_py()))
                    continue
                if shelf is None:
                    if not held:
                        continue
                    shelf, held = _Shelf(held, dim, kind), [(-1, b"")]
                q = unpack(payload[i].as_py())
                row, place, s = _taken(shelf, np.asarray(cells[i].values), q, dim, kind, same, k)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(q["req"][row]), pa.array(shelf.n[place]), pa.array(shelf.id[place], mask=shelf.none[place] > 0), pa.array(s)], names=["req", "n", "vec_id", "score"])

    rows = chunks.select("shelf", "cell", F.lit(None).cast("array<int>").alias("cells"), "payload")
    both = rows.unionByName(pairs.select("shelf", F.lit(None).cast("int").alias("cell"), "cells", "payload"))
    dealt = both.repartition(shuffle_partitions(chunks.sparkSession), "shelf").sortWithinPartitions("shelf", F.asc_nulls_last("cell"))
    return dealt.mapInArrow(run, "req long, n long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("req").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "n")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(requests: DataFrame, chunks: DataFrame, cells: dict[str, np.ndarray], dim: int, leaves: int, most: float, same: bool, k: int) -> DataFrame:
    """(req, rank, n, vec_id, score): the k best rows of each request (req, n, label, leaf, cls, vector, low, high)."""
    total = requests.count()
    if not total or not len(cells["n"]):
        return requests.sparkSession.createDataFrame([], "req long, n long, vec_id long, score long, rank int")
    rows, classes = int(cells["n"].sum()), len(np.unique(cells["cls"]))
    steps = [0, FIRST * k]
    while steps[-1] * GROW < rows // (classes if same else 1):
        steps.append(steps[-1] * GROW)
    best = None
    for after, until in zip(steps, [*steps[1:], None], strict=True):
        known = requests.withColumn("least", F.col("low"))
        if best is not None:
            reached = best.where(F.col("rank") == k).select("req", F.col("score").alias("_kth"))
            known = requests.join(reached, "req", "left").withColumn("least", F.greatest("low", F.coalesce("_kth", "low"))).drop("_kth")
        groups = stored(_groups(known, dim, leaves, total, classes, _narrow(most)))
        found = _scored(_pairs(groups, cells, dim, same, after, until), chunks, dim, most, same, k)
        best = stored(_best(found if best is None else best.drop("rank").unionByName(found), k))
    return best


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``rows`` has vec_id (long), vector (array<long>), label (long) and anchor
    (boolean). An anchor's positives are the ``positives`` rows of its label,
    other than itself, with the highest inner products; a positive's negatives
    are the first ``negatives`` rows of other labels whose score, times 100,
    lies between ``low_percent`` and ``high_percent`` times the positive's.
    Ties go to the smaller vec_id, null ids last. Rows with a null vector or
    label take no part, anchors of null id neither; rows that repeat are each
    an anchor, a positive and a negative; missing components of a shorter
    vector count as 0. A positive without negatives gives no row, as does one
    of a negative score, whose window is empty. No rows give none. Scores
    wrap as 64-bit integers where they do not fit in one.
    """
    spark = rows.sparkSession
    small_batches(spark)
    valid = rows.where("vector is not null and label is not null").select("vec_id", "vector", F.col("label").cast("long").alias("label"), (F.coalesce("anchor", F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor"))
    valid = stored(valid.withColumn("n", F.monotonically_increasing_id()))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most, dim, count, classes = valid.agg(F.max(square), F.max(F.size("vector")), F.count("*"), F.count_distinct(F.pmod("label", F.lit(CLASSES)))).first()
    dim, most = max(dim or 0, 1), most or 0.0
    wanted = max(1, min(LEAVES, (count or 0) // (chunk_rows * max(classes or 1, 1))))
    sample = valid.select("vector").orderBy(F.xxhash64("n", F.lit(1)), "n").limit(SAMPLE_ROWS).toArrow() if wanted > 1 else None
    tree = fit_tree(_matrix(sample["vector"].combine_chunks(), dim).astype(float), wanted) if sample is not None else []
    leaves = len(tree) + 1

    @F.arrow_udf("int")
    def leaf(v: pa.Array) -> pa.Array:
        return pa.array(leaf_of(tree, _matrix(v, dim).astype(float)), pa.int32())

    placed = stored(valid.withColumn("leaf", leaf("vector")).withColumn("cls", F.pmod("label", F.lit(CLASSES)).cast("int")))
    chunks = stored(_packed_chunks(_chunked(placed, ["leaf", "cls"], chunk_rows, F.xxhash64("n")), dim, _narrow(most)))
    cells = _cells(chunks, dim)
    rows_of = max(1, min(SHELF_VALUES // dim, -(-(count or 0) // (4 * spark.sparkContext.defaultParallelism))))
    cells["first"], cells["number"] = _shelves(cells, rows_of)
    named = spark.createDataFrame([(k, *(int(cells[c][k]) for c in ("leaf", "cls", "first", "number"))) for k in range(len(cells["n"]))], "cell int, leaf int, cls int, first long, number long")
    chunks = chunks.join(F.broadcast(named), ["leaf", "cls"]).withColumn("shelf", (F.col("first") + F.pmod("chunk", "number")).cast("int"))
    far = F.lit(1 << 62).cast("long")
    asked = placed.where("anchor").select(F.col("n").alias("req"), "n", "label", "leaf", "cls", "vector", (-far).alias("low"), far.alias("high"))
    near = stored(_search(asked, chunks, cells, dim, leaves, most, True, positives))
    pairs = near.select(F.col("req").alias("n"), "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(placed.where("anchor").select("n", F.col("vec_id").alias("anchor_id"), "label", "leaf", "cls", "vector"), "n")
    p = F.col("positive_score").cast("decimal(38,0)")
    window = {"low": F.ceil(p * low_percent / 100).cast("long"), "high": F.floor(p * high_percent / 100).cast("long")}
    pairs = stored(pairs.withColumns(window).where("low <= high").withColumn("req", F.monotonically_increasing_id()))
    far_ones = _search(pairs.select("req", "n", "label", "leaf", "cls", "vector", "low", "high"), chunks, cells, dim, leaves, most, False, negatives)
    named = far_ones.select("req", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(pairs.select("req", "anchor_id", "positive_id", "positive_score"), "req").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
