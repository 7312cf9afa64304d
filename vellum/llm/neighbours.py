"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

1. Tree: from the root each node's vectors are split around ``BRANCH`` centroids or fewer, until a leaf holds as
   many as the root of the table's size, ``LEAST_LEAF`` to ``MOST_LEAF``. All vectors take part in every Lloyd
   round, as one pass that sums by node; a table of the nodes goes to every executor, and ``MOST_NODES`` checks
   its size by letting leaves grow. Every table of more than 2 * LEAST_LEAF vectors has a tree.
2. Search: a priority queue holds nodes by the distance of their centroids. The nearest is taken; a node
   adds its children, a leaf is visited. Empty leaves don't count, and a search goes on until the leaves that
   it visited hold more than k vectors.
3. Calibration: for ``PROBES`` vectors, spread over the table by hash, the true neighbours are found by brute
   force over all vectors. The leaves to visit are the fewest with which the recall of what they hold is
   ``RECALL`` at least.
4. Every vector goes once to the bucket of its leaf. Leaves that are near in the tree share buckets; a leaf that
   can't be split (of equal vectors) is cut over several by the hash of its ids. A query goes once to each bucket
   that has leaves of its search; there it is compared with their vectors, block by block, and the k nearest of
   each bucket are merged.

Queries are the vectors whose vec_id is divisible by ``every``, against all vectors. Distances are Euclidean,
of float32 vectors. Defined results: null vectors, vectors with null, NaN or infinite entries and vectors of
another length than the most frequent (of equally frequent ones the longest) are neither query nor neighbour; a
query is not its own neighbour, but equal vectors of other ids are, at distance 0; ties go to the lesser id; with
fewer than k other vectors all of them are neighbours; an id in several rows is as many neighbours, which are not
each other's, and asks once, with its least vector. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import blobs
from vellum.llm.text_kernel import mix
from vellum.session import least_by_hash, ship, written

K = 10
EVERY = 20
LEAST_LEAF, MOST_LEAF = 25, 500
BRANCH = 16
ROUNDS = 4
PROBES = 400
RECALL = 0.96
MOST_NODES = 1 << 20
#: Bytes of vectors that a bucket is expected to hold, and vectors of one block of a product.
BUCKET, BLOCK = 64 << 20, 4096
SCHEMA = "vec_id long, neighbour_id long, distance double, rank int"
_SENT = "bucket int, slots binary, ids binary, vectors binary, visits binary"
_NAMES = ["slots", "ids", "vectors", "visits"]


class Tree:
    """Nodes in levels; children of node i are child[i][0] .. child[i][1] (none: a leaf); ``count`` vectors are at
    each leaf."""

    def __init__(self, width: int):
        self.centroid = np.zeros((1, width), np.float32)
        self.child: list[tuple[int, int]] = [(0, 0)]
        self.count = np.ones(1, np.int64)

    def leaves(self) -> np.ndarray:
        """The leaves that are not empty."""
        return np.array([i for i, (a, b) in enumerate(self.child) if a == b and self.count[i]], np.int64)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = [i for i in np.unique(at).tolist() if self.child[i][0] < self.child[i][1]]
            if not inner:
                return at
            for i in inner:
                a, b = self.child[i]
                own = np.flatnonzero(at == i)
                at[own] = a + _squares(x[own], self.centroid[a:b]).argmin(1)

    def orders(self, x: np.ndarray, visits: int, least: int = 0) -> list[list[int]]:
        """The first ``visits`` leaves of each vector's best-bin-first search, and more until they hold ``least``."""
        small = len(self.centroid) <= 4096
        every = _squares(x, self.centroid).tolist() if small else None
        count = self.count
        out = []
        for q in range(len(x)):
            row = every[q] if small else None
            queue = [(0.0, 0)]
            seen: list[int] = []
            held = 0
            while queue and (len(seen) < visits or held < least):
                _, i = heapq.heappop(queue)
                a, b = self.child[i]
                if a == b:
                    if count[i]:
                        seen.append(i)
                        held += count[i]
                    continue
                near = row[a:b] if row is not None else _squares(x[q : q + 1], self.centroid[a:b])[0].tolist()
                for j, v in enumerate(near):
                    heapq.heappush(queue, (v, a + j))
            out.append(seen)
        return out


class Layout:
    """Slots and their buckets: a leaf has a slot for each ``most`` vectors it holds; slots follow each other as
    leaves do in the tree, and a bucket has as many of them as make up its share of the vectors."""

    def __init__(self, tree: Tree, n: int):
        most = max(MOST_LEAF, -(-int(tree.count.sum()) // (4 * n)))
        self.parts = np.maximum(1, -(-tree.count // most))
        self.first = np.cumsum(self.parts) - self.parts
        weight = np.repeat(tree.count / self.parts, self.parts)
        before = np.cumsum(weight) - weight
        self.bucket = np.minimum((before * n / max(1.0, weight.sum())).astype(np.int64), n - 1)

    def slot(self, leaf: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[leaf] + (mix(ids.view(np.uint64)) % self.parts[leaf].astype(np.uint64)).astype(np.int64)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, never below 0."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :], 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values, np.float32).reshape(-1, width)


def _vectors(df: DataFrame) -> tuple[DataFrame, int]:
    """Vectors that count, with the table's width."""
    good = F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    d = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v")).where(good & F.col("vec_id").isNotNull() & (F.size("v") > 0))
    sizes = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = sizes[0][0] if sizes else 0
    return d.where(F.size("v") == width), width


def _sums(tree, nodes, width: int):
    """(node, count, sum) of this task's vectors, for the nodes that are being split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        t = tree.value
        for b in batches:
            x = _matrix(b.column(0), width)
            at = t.nearest(x)
            for i in np.unique(at).tolist():
                own = x[at == i]
                s = total.setdefault(i, [0, np.zeros(width)])
                s[0] += len(own)
                s[1] = s[1] + own.sum(0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([i % nodes for i in total], pa.int32()), pa.array(list(total), pa.int64()), pa.array([s[0] for s in total.values()], pa.int64()), pa.array([s[1].tobytes() for s in total.values()], pa.binary())], ["bucket", "node", "n", "total"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for b in batches:
        for i, n, s in zip(b.column("node").to_pylist(), b.column("n").to_pylist(), blobs.arrays(b.column("total"), np.float64)):
            t = total.setdefault(i, [0, np.zeros(len(s))])
            t[0] += n
            t[1] = t[1] + s
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([s[0] for s in total.values()], pa.int64()), pa.array([s[1].tobytes() for s in total.values()], pa.binary())], ["node", "n", "total"])


def build(vectors: DataFrame, width: int, leaf: int | None = None) -> Tree:
    """The tree over all vectors."""
    spark = vectors.sparkSession
    n = vectors.count()
    leaf = max(leaf or min(max(math.isqrt(n), LEAST_LEAF), MOST_LEAF), n // MOST_NODES)
    tree, parts = Tree(width), blobs.partitions(vectors)
    held = {0: n}
    rng = np.random.RandomState(1)

    def counts(tree: Tree) -> list:
        shared = spark.sparkContext.broadcast(tree)
        return vectors.select("v").mapInArrow(_sums(shared, parts, width), "bucket int, node long, n long, total binary").repartitionById(parts, F.col("bucket")).mapInArrow(_merge, "node long, n long, total binary").collect()

    while split := [i for i, (a, b) in enumerate(tree.child) if a == b and held.get(i, 0) > 2 * leaf]:
        # Centroids begin at the node's own, moved a little apart along random directions of the data's size.
        spread = np.sqrt(max(1e-12, float(vectors.select(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")).alias("s")).agg(F.avg("s")).collect()[0][0] or 0) / width))
        for i in split:
            k = int(min(BRANCH, max(2, -(-held[i] // leaf))))
            a = len(tree.centroid)
            tree.child[i] = (a, a + k)
            tree.child += [(0, 0)] * k
            tree.centroid = np.concatenate([tree.centroid, tree.centroid[i] + rng.normal(0, spread, (k, width)).astype(np.float32)])
        for _ in range(ROUNDS):
            rows = counts(tree)
            held = {r[0]: r[1] for r in rows}
            for i, m, s in rows:
                if i > 0:
                    tree.centroid[i] = (np.frombuffer(s, np.float64) / m).astype(np.float32)
        # A node whose vectors all went to one child (equal vectors) is not split again.
        for i in split:
            a, b = tree.child[i]
            if max(held.get(j, 0) for j in range(a, b)) >= sum(held.get(j, 0) for j in range(a, b)):
                held = {j: (0 if a <= j < b else m) for j, m in held.items()}
    tree.count = np.zeros(len(tree.child), np.int64)
    for i, m, _ in counts(tree):
        tree.count[i] = m
    return tree


def _brute(queries, tree, width: int, k: int):
    """(q, d, vec_id, leaf): the k nearest of this task's vectors for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, q = queries.value
        d, i, v = np.full((len(qi), k), np.inf, np.float32), np.zeros((len(qi), k), np.int64), np.zeros((len(qi), k, width), np.float32)
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), width)
            for begin in range(0, len(ids), BLOCK):
                own, y = ids[begin : begin + BLOCK], x[begin : begin + BLOCK]
                e = _squares(q, y)
                e[qi[:, None] == own[None, :]] = np.inf
                cut = np.argpartition(e, min(k, len(own)) - 1, 1)[:, :k]
                e = np.concatenate([d, np.take_along_axis(e, cut, 1)], 1)
                both, vectors = np.concatenate([i, own[cut]], 1), np.concatenate([v, y[cut]], 1)
                best = np.lexsort((both, e), axis=-1)[:, :k]
                d, i = np.take_along_axis(e, best, 1), np.take_along_axis(both, best, 1)
                v = np.take_along_axis(vectors, best[:, :, None], 1)
        ok = np.isfinite(d)
        if ok.any():
            leaf = tree.value.nearest(v[ok])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(qi, k).reshape(-1, k)[ok], d[ok].astype(np.float64), i[ok], leaf)], ["q", "d", "vec_id", "leaf"])

    return run


def calibrate(vectors: DataFrame, tree: Tree, width: int, k: int, recall: float) -> tuple[int, float]:
    """(leaves to visit for the recall, the recall measured with them)."""
    spark = vectors.sparkSession
    leaves = len(tree.leaves())
    rows = least_by_hash(vectors, "vec_id", PROBES, "v").dropDuplicates(["vec_id"]).collect()
    if leaves <= 1 or not rows:
        return 1, 1.0
    qi, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32)
    shared, nodes = spark.sparkContext.broadcast((qi, q)), spark.sparkContext.broadcast(tree)
    near = vectors.mapInArrow(_brute(shared, nodes, width, k), "q long, d double, vec_id long, leaf long").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id", "leaf"))), 1, k).alias("best"))
    want = {r[0]: r[1] for r in near.select("q", "best.leaf").collect()}  # k leaves for each probe
    visits = 8
    while True:
        order = {i: {x: j for j, x in enumerate(o)} for i, o in zip(qi.tolist(), tree.orders(q, visits))}
        place = np.sort([order[i].get(x, leaves) for i, xs in want.items() for x in xs])
        if not len(place):
            return 1, 1.0
        last = int(place[math.ceil(recall * len(place)) - 1])
        if last < min(visits, leaves):
            return last + 1, float((place <= last).mean())
        visits *= 4


def _members(tree, layout):
    """Each vector to the bucket of its slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, where = tree.value, layout.value
        width = t.centroid.shape[1]
        box = blobs.Outbox(int(where.bucket[-1]) + 1)
        send = lambda slot, ids, x: blobs.scatter(where.bucket[slot], [slot.astype(np.int32), ids, x, None], _NAMES)
        for b in batches:
            ids, x = b.column(0).to_numpy().astype(np.int64), _matrix(b.column(1), width)
            if box.add(where.slot(t.nearest(x), ids), ids, x.view(np.dtype((np.void, 4 * width))).reshape(-1)):
                yield send(*box.take())
        if (last := box.take()) is not None:
            yield send(*last)

    return run


def _queries(tree, layout, visits: int, k: int):
    """Each query to every bucket that has slots of the leaves of its search, with these slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, where = tree.value, layout.value
        width = t.centroid.shape[1]
        for b in batches:
            ids, x = b.column(0).to_numpy().astype(np.int64), _matrix(b.column(1), width)
            orders = t.orders(x, visits, k + 1)
            leaf = np.array([i for o in orders for i in o], np.int64)
            query = np.repeat(np.arange(len(ids)), [len(o) for o in orders])
            many = where.parts[leaf]
            slot = np.repeat(where.first[leaf] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            query = np.repeat(query, many)
            bucket = where.bucket[slot]
            order = np.lexsort((slot, query, bucket))
            slot, query, bucket = slot[order], query[order], bucket[order]
            edge, size = blobs.runs(bucket * len(ids) + query)
            q, n = query[edge], bucket[edge]
            rows, _ = blobs.runs(n)
            ends, flat = np.append(rows, len(n)), np.append(edge[rows], len(slot))
            columns = [blobs.packed(slot.astype(np.int32), flat), *(blobs.packed(a, ends) for a in (ids[q], x[q].view(np.dtype((np.void, 4 * width))).reshape(-1), size.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(n[rows].astype(np.int32)), *columns], ["bucket", *_NAMES])

    return run


def _nearest(q: np.ndarray, qi: np.ndarray, m: np.ndarray, mi: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) of the k nearest vectors, which are in order of their ids, for each query."""
    d = _squares(q, m)
    d[qi[:, None] == mi[None, :]] = np.inf
    if k < len(mi):
        keep = d <= np.partition(d, k - 1, 1)[:, k - 1 : k]
        for j in np.flatnonzero(keep.sum(1) > k).tolist():  # ties at the k-th distance: the least ids
            far = d[j][keep[j]].max()
            less, same = np.flatnonzero(d[j] < far), np.flatnonzero(d[j] == far)
            keep[j] = False
            keep[j, less] = keep[j, same[: k - len(less)]] = True
        return np.nonzero(keep & np.isfinite(d))
    return np.nonzero(np.isfinite(d))


def _first(q: np.ndarray, i: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each query the k least by (distance, id), with their rank from 0."""
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    edge, size = blobs.runs(q)
    rank = np.arange(len(q)) - np.repeat(edge, size)
    keep = rank < k
    return q[keep], i[keep], d[keep], rank[keep]


def _answer(n: int, width: int, k: int):
    """A bucket's answers to its queries, sent on by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, asking = [], []
        for b in batches:
            for j in range(b.num_rows):
                own = b.slice(j, 1)
                (members if own.column("visits").null_count else asking).append(own)
        void = np.dtype((np.void, 4 * width))
        slot, ids, x = (blobs.joined(members, c, t) for c, t in (("slots", np.int32), ("ids", np.int64), ("vectors", void)))
        del members
        order = np.lexsort((ids, slot))
        slot, ids, x = slot[order], ids[order], x[order].view(np.float32).reshape(-1, width)
        qi, q, visits, want = (blobs.joined(asking, c, t) for c, t in (("ids", np.int64), ("vectors", void), ("visits", np.int32), ("slots", np.int32)))
        q = q.view(np.float32).reshape(-1, width)
        who = np.repeat(np.arange(len(qi)), visits)
        order = np.argsort(want, kind="stable")
        want, who = want[order], who[order]
        found: list[tuple] = []
        held = 0
        for f, m in zip(*(v.tolist() for v in blobs.runs(want))):
            a, b = np.searchsorted(slot, want[f], "left"), np.searchsorted(slot, want[f], "right")
            for begin in range(a, b, BLOCK):
                y, yi = x[begin : min(b, begin + BLOCK)], ids[begin : min(b, begin + BLOCK)]
                for start in range(f, f + m, 1024):
                    w = who[start : min(f + m, start + 1024)]
                    i, j = _nearest(q[w], qi[w], y, yi, k)
                    found.append((w[i], yi[j], ((q[w[i]].astype(np.float64) - y[j]) ** 2).sum(1)))
                    held += len(i)
                    if held > 2_000_000:
                        found = [_first(*(np.concatenate(c) for c in zip(*found)), k)[:3]]
                        held = len(found[0][0])
        if held:
            w, i, d, _ = _first(*(np.concatenate(c) for c in zip(*found)), k)
            to = blobs.buckets_of(mix(qi[w].view(np.uint64)), n)
            yield blobs.scatter(to, [qi[w], i, d], ["queries", "ids", "squares"])

    return run


def _top(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        q, i, d, rank = _first(*(blobs.joined(parts, c, t) for c, t in (("queries", np.int64), ("ids", np.int64), ("squares", np.float64))), k)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(np.sqrt(d)), pa.array((rank + 1).astype(np.int32))], ["vec_id", "neighbour_id", "distance", "rank"])

    return run


def neighbours(embeddings: DataFrame, k: int = K, every: int = 1, recall: float = RECALL, leaf: int | None = None) -> DataFrame:
    """(vec_id, neighbour_id, distance, rank): k neighbours of every vector whose vec_id ``every`` divides."""
    spark = ship(embeddings.sparkSession)
    vectors, width = _vectors(embeddings)
    if not width:
        return spark.createDataFrame([], SCHEMA)
    vectors = written(vectors, "vectors")
    least = blobs.partitions(vectors)
    tree = build(vectors, width, leaf)
    visits, _ = calibrate(vectors, tree, width, k, recall)
    n = max(least, int(tree.count.sum()) * width * 4 // BUCKET)
    shared, layout = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(Layout(tree, n))
    asking = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    sent = vectors.mapInArrow(_members(shared, layout), _SENT).unionByName(asking.mapInArrow(_queries(shared, layout, visits, k), _SENT)).repartitionById(n, F.col("bucket"))
    answers = sent.mapInArrow(_answer(least, width, k), "bucket int, queries binary, ids binary, squares binary").repartitionById(least, F.col("bucket"))
    return answers.mapInArrow(_top(k), SCHEMA)
