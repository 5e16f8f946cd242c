"""Operator 12: exact top-k by inner product, by best-first search of M-trees.

Components become the integers floor(1024 x). An inner product is no metric, so a tree of vectors of
at most norm M gives each one more coordinate, sqrt(M^2 - |x|^2): all then have norm M, and of a query
scaled to norm M, without that coordinate, the nearest have the greatest inner products. In this
metric the tree is built: pages of at most PAGE entries; an entry of an inner page has a routing
vector, a covering radius, and its distance to the page's own routing vector; an entry of a leaf has
the latter alone. A search pops the page of the least lower bound, as long as that bound allows a
score of the k-th best found. Of a popped page's entries those are left out, without a distance
computed, whose stored distance to the page's routing vector and the query's to it already tell, by
the triangle inequality, that they are too far; the rest are computed. Bounds are floating, widened by
SLACK, and pages that might tie are visited; scores are exact integers.

Trees are built of CHUNK_BYTES of vectors at most where the rows are read, and written as a table of
the shared folder, so that a lost executor reads them again. Every tree meets every block of BLOCK
queries: a task gets a tree once, then the blocks one after the other, and gives k rows of a query at
most.
A search starts from the k-th best score in a sample of at most SAMPLE vectors, the first by a hash of
vec_id, so that trees prune before they have found anything; the sample decides no result. Work is
queries times trees at least; vectors spread evenly in many dimensions, where no bound tells them
apart, are all computed, which is rows^2 / 100.

Defined results: vectors that are null, empty or hold null or non-finite components, or have a null
id, take no part; vectors of zeros do, with scores of 0; vectors of other lengths are never compared;
a repeated vec_id is one query, with the smallest of its vectors, and as many candidates as it has
rows; candidates with the query's own id are left out; of equal scores the smaller vec_id comes first;
a score beyond a long is the nearest long; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.ann import eligible, sampled
from quarryline.llm.common import cut, shuffle_width

K, EVERY, SCALE = 10, 100, 1024.0
PAGE, FANOUT, DEEPEST, CHUNK_BYTES, MOST_ROWS, BLOCK, SAMPLE, SEED = 512, 24, 40, 8 << 20, 16_384, 256, 2048, 20_240_607
#: Relative slack of bounds: a distance is the root of a difference, so its error is up to the root of a double's.
SLACK = 1e-6


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, components as doubles."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", e.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x), still as doubles, which hold them exactly (but for those over 1e300)."""
    return np.floor(np.clip(SCALE * vectors, -1e300, 1e300))


def peak(a: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0))


def products(rows: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products, at either end of a long if beyond it; most: the greatest product of components. In doubles where all sums are below 2^53, else in Python's integers."""
    if most * max(len(q), 1) < 2.0**53:
        return (rows @ q).astype(np.int64)
    exact = (sum(int(a) * int(b) for a, b in zip(r, q.tolist(), strict=True)) for r in rows.tolist())
    return np.array([min(max(e, -(1 << 63)), (1 << 63) - 1) for e in exact], np.int64)


class Tree:
    """A paged M-tree over distinct rows of integer vectors.

    Nodes are arrays: `route` the row of the routing vector, `radius`, `up` the distance to the parent's
    routing vector, `first` and `last` the range of child nodes (inner) or of rows (leaf). Children of
    a node and rows of a leaf lie together.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = (vectors**2).sum(1)
        self.high, self.peak = float(norms.max(initial=0)) ** 0.5, peak(vectors)
        self.lift = np.sqrt(np.maximum(self.high**2 - norms, 0))
        self.ids, self.vectors = ids, vectors
        self._points = np.c_[vectors, self.lift]
        self._random = np.random.default_rng(SEED)
        leaf, route, radius, up, first, last, self._order = [], [], [], [], [], [], []

        def add(at: int, rows: np.ndarray, apart: np.ndarray, above: int, depth: int) -> None:
            """Node `at`: its routing row is already set; `apart` are the rows' distances to it."""
            radius[at] = float(apart.max(initial=0))
            up[at] = float(np.linalg.norm(self._points[route[at]] - self._points[above]))
            if len(rows) <= PAGE:
                leaf[at], first[at] = True, len(self._order)
                self._order += [(int(r), float(d)) for r, d in zip(rows, apart, strict=True)]
                last[at] = len(self._order)
                return
            parts = self._split(rows, depth)
            start = len(route)
            for centre, _, _ in parts:
                route.append(centre)
                for column in (leaf, radius, up, first, last):
                    column.append(0)
            first[at], last[at] = start, start + len(parts)
            for i, (_, mine, near) in enumerate(parts):
                add(start + i, mine, near, route[at], depth + 1)

        rows = np.arange(len(ids))
        if len(rows):
            route.append(0)
            for column in (leaf, radius, up, first, last):
                column.append(0)
            add(0, rows, np.linalg.norm(self._points - self._points[0], axis=1), 0, 0)
        order = np.array([r for r, _ in self._order], np.int64)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.ids, self.vectors, self.lift = ids[order], vectors[order], self.lift[order]
        self.away = np.array([d for _, d in self._order])
        self.leaf, self.route = np.array(leaf, bool), place[np.array(route, np.int64)] if route else np.zeros(0, np.int64)
        self.radius, self.up = np.array(radius, float), np.array(up, float)
        self.first, self.last = np.array(first, np.int64), np.array(last, np.int64)
        self.computed = 0
        del self._points, self._order, self._random

    def _split(self, rows: np.ndarray, depth: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(routing row, rows, their distances) of at most FANOUT parts: each row goes to the nearest of randomly chosen routing rows; rows that can't be told apart are cut into even pages."""
        chosen = self._random.choice(rows, min(FANOUT, -(-len(rows) // (PAGE // 2))), replace=False)
        points = self._points[rows]
        square = (points**2).sum(1)[:, None] + (self._points[chosen] ** 2).sum(1) - 2 * points @ self._points[chosen].T
        nearest = square.argmin(1)
        groups = [rows[nearest == i] for i in range(len(chosen))]
        if max(map(len, groups)) == len(rows) or depth > DEEPEST:
            groups = np.array_split(rows, -(-len(rows) // PAGE))
            chosen = [g[0] for g in groups]
        apart = lambda c, g: np.linalg.norm(self._points[g] - self._points[c], axis=1)
        return [(int(c), g, apart(c, g)) for c, g in zip(chosen, groups, strict=True) if len(g)]

    def search(self, query_id: int, q: np.ndarray, k: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows with another id; only such of a score of limit or more need be found."""
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.ids):
            return best_ids, best
        size, high, widest = float((q**2).sum()) ** 0.5, self.high, self.peak * peak(q)
        scale, double = high / size if size else 0.0, 2 * high * high

        def apart(rows: np.ndarray) -> np.ndarray:
            """Distances of rows to the scaled query: both have norm `high`."""
            self.computed += len(rows)
            return np.sqrt(np.maximum(double - 2 * scale * (self.vectors[rows] @ q), 0))

        def reach(score: int | None) -> float:
            """The greatest distance that allows a score, and some more."""
            if score is None or not size or not high or not np.isfinite(double):
                return np.inf
            return max(double - 2 * scale * score + SLACK**2 * double, 0) ** 0.5 + SLACK * (1 + high)

        far = reach(limit)
        at = float(apart(self.route[:1])[0])
        heap = [(at - float(self.radius[0]), 0, at)]
        while heap:
            least, node, at = heapq.heappop(heap)
            if least > far:
                break
            first, last = self.first[node], self.last[node]
            if self.leaf[node]:
                ids, vectors = self.ids[first:last], self.vectors[first:last]
                near = ~(np.abs(self.away[first:last] - at) > far)
                if not near.all():
                    ids, vectors = ids[near], vectors[near]
                self.computed += len(ids)
                scores = products(vectors, q, widest)
                good = ids != query_id
                if limit is not None:
                    good &= scores >= limit
                if good.any():
                    all_ids, every = np.concatenate((best_ids, ids[good])), np.concatenate((best, scores[good]))
                    order = np.lexsort((all_ids, -every))[:k]
                    best_ids, best = all_ids[order], every[order]
                    if len(best) == k and (limit is None or best[-1] > limit):
                        limit = int(best[-1])
                        far = reach(limit)
            else:
                rows = np.arange(first, last)
                rows = rows[~(np.abs(self.up[rows] - at) - self.radius[rows] > far)]
                if len(rows):
                    near = apart(self.route[rows])
                    for r, d, b in zip(rows.tolist(), near.tolist(), (near - self.radius[rows]).tolist(), strict=True):
                        if not b > far:
                            heapq.heappush(heap, (b, r, d))
        return best_ids, best

    NUMBERS = (("ids", np.int64), ("vectors", np.float64), ("lift", np.float64), ("away", np.float64), ("leaf", np.bool_), ("route", np.int64), ("radius", np.float64), ("up", np.float64), ("first", np.int64), ("last", np.int64))

    def packed(self) -> dict[str, bytes]:
        return {name: np.ascontiguousarray(getattr(self, name)).tobytes() for name, _ in self.NUMBERS}

    @classmethod
    def unpacked(cls, dim: int, high: float, fields: dict[str, bytes]) -> Tree:
        tree = cls.__new__(cls)
        for name, kind in cls.NUMBERS:
            setattr(tree, name, np.frombuffer(fields[name], kind))
        tree.vectors, tree.high, tree.computed = tree.vectors.reshape(-1, dim), high, 0
        tree.peak = peak(tree.vectors)
        return tree


def columns_of(b: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The batch's (ids, vectors) by dimension."""
    ids, column = b["vec_id"].to_numpy(zero_copy_only=False).astype(np.int64), b["embedding"]
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    return {int(d): (ids[lengths == d], flat[starts[lengths == d][:, None] + np.arange(d)]) for d in np.unique(lengths)}


def _gather(batches: Iterator[pa.RecordBatch], most):
    """(dim, ids, whole vectors) of at most most(dim) rows, of one dimension each, of a task's rows."""
    kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def take(dim: int, all_of: bool):
        ids, vectors = (np.concatenate(c) for c in zip(*kept.pop(dim), strict=True))
        size = most(dim)
        whole_of = len(ids) if all_of else len(ids) // size * size
        for i in range(0, whole_of, size):
            yield dim, ids[i : i + size], vectors[i : i + size]
        if whole_of < len(ids):
            kept[dim].append((ids[whole_of:], vectors[whole_of:]))

    for b in batches:
        for dim, (ids, vectors) in columns_of(b).items():
            kept[dim].append((ids, whole(vectors)))
            if sum(len(i) for i, _ in kept[dim]) >= most(dim):
                yield from take(dim, False)
    for dim in list(kept):
        yield from take(dim, True)


def tree_rows(dim: int) -> int:
    """How many vectors a tree holds: CHUNK_BYTES of them, MOST_ROWS at most."""
    return max(1, min(MOST_ROWS, CHUNK_BYTES // (8 * dim)))


_TREE = "dim int, n int, high double, " + ", ".join(f"{name} binary" for name, _ in Tree.NUMBERS)
_TREE_ARROW = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("high", pa.float64()), *((name, pa.binary()) for name, _ in Tree.NUMBERS)])


def _builder(k: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, vectors in _gather(batches, tree_rows):
            keep = eligible(ids, vectors, k)
            tree = Tree(ids[keep], vectors[keep])
            yield pa.RecordBatch.from_pylist([{"dim": dim, "n": len(keep), "high": tree.high} | tree.packed()], schema=_TREE_ARROW)

    return build


def _blocker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, ids, vectors in _gather(batches, lambda dim: BLOCK):
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())})


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("computed", pa.int64())])


def _searcher(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Of a tree's rows: the tree first (kind 0), then blocks of queries (kind 1)."""

    def limits(dim: int, ids: np.ndarray, queries: np.ndarray) -> list[int | None]:
        known, vectors = sample.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
        most = peak(vectors)
        out: list[int | None] = []
        for q, v in zip(ids.tolist(), queries, strict=True):
            scores = products(vectors[known != q], v, most * peak(v))
            out.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, at = [], None
        for b in batches:
            for i in range(b.num_rows):
                dim, group = b["dim"][i].as_py(), b["g"][i].as_py()
                if group != at:
                    trees, at = [], group
                if b["kind"][i].as_py() == 0:
                    fields = {name: b[name][i].as_py() for name, _ in Tree.NUMBERS}
                    trees.append((dim, Tree.unpacked(dim, b["high"][i].as_py(), fields)))
                    continue
                mine = [tree for d, tree in trees if d == dim]
                if not mine:
                    continue
                ids, queries = np.frombuffer(b["ids"][i].as_py(), np.int64), np.frombuffer(b["vectors"][i].as_py()).reshape(-1, dim)
                rows = []
                for q, v, limit in zip(ids.tolist(), queries, limits(dim, ids, queries), strict=True):
                    for tree in mine:
                        before = tree.computed
                        found, scores = tree.search(q, v, k, limit)
                        rows += [(q, v_id, s, tree.computed - before if j == 0 else 0) for j, (v_id, s) in enumerate(zip(found.tolist(), scores.tolist(), strict=True))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return run


def build(rows: DataFrame, k: int = K) -> DataFrame:
    """The index of valid rows: a table of numbered trees in the shared folder."""
    made = rows.mapInArrow(_builder(k), _TREE)
    return cut(made.withColumn("tree", F.monotonically_increasing_id()), "mtree")


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, vec_id, score, computed) of the k best of each query in each tree, of valid rows and queries with an id each; computed sums up to the distances and products computed."""
    by: dict[int, list] = defaultdict(list)
    for r in sampled(rows, SAMPLE).collect():
        by[len(r["embedding"])].append((r["vec_id"], r["embedding"]))
    sample = {dim: (np.array([i for i, _ in v], np.int64), whole(np.array([e for _, e in v], float))) for dim, v in by.items()}
    trees, width = build(rows, k), shuffle_width(rows.sparkSession)
    groups = max(1, trees.count())
    blocks = queries.repartition(max(1, width // 8), "vec_id").mapInArrow(_blocker, "dim int, ids binary, vectors binary")
    names = [name for name, _ in Tree.NUMBERS if name not in ("ids", "vectors")]
    # As many groups as trees: a task holds a group's trees, one or a few, and meets the blocks after them, one at a time.
    dealt = trees.select(F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "dim", "high", "ids", "vectors", *names)
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "dim", F.lit(None).cast("double").alias("high"), "ids", "vectors", *[F.lit(None).cast("binary").alias(name) for name in names])
    met = dealt.unionByName(asked).repartition(width, "g").sortWithinPartitions("g", "kind")
    return met.mapInArrow(_searcher(sample, k), "query_id long, vec_id long, score long, computed long")


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k best of rows for each of queries, both (vec_id, embedding); queries of one id count once, with the smallest vector."""
    asked = valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = nearest(valid(rows), asked, k).withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(rows: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The stated queries: rows whose vec_id is divisible by `every`, against all rows."""
    return search(rows, rows.filter(F.col("vec_id") % every == 0), k)
