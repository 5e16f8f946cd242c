"""Extension: a graph of tagged nodes, by weighted tag overlap, and its ranking.

Nodes are (node, tags). Two nodes are near if the weights of their common tags are at least a share of
the weights of all their tags; rare tags weigh more. Nodes are dealt to blocks by a hash, every two
blocks meet in a task that sums their common weights through the tags they share, and only pairs that are
near enough, or the nearest of each node, leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.sources.rounds import Rounds

THETA, TOP, DAMPING, TOLERANCE, ROUNDS = 0.4, 5, 0.85, 1e-10, 200
_LEAST = 1e-9
#: The most nodes of a block on average; its tags that are summed by a product of matrices: so many at most, and of so great a share of the nodes; rows at once.
BLOCK, OFTEN, SHARE, STRIP = 8192, 512, 0.06, 64


def tag_weights(nodes: DataFrame) -> DataFrame:
    """(tag, f, w): f of n nodes have the tag, and w is ln(1 + n / f)."""
    one = nodes.select("node", F.explode("tags").alias("tag")).distinct()
    return _weighed(one, nodes.select("node").distinct())


def _weighed(one: DataFrame, names: DataFrame) -> DataFrame:
    n = names.agg(F.count("*").alias("n"))  # one row
    return one.groupBy("tag").agg(F.count("*").alias("f")).join(F.broadcast(n)).select("tag", "f", F.log1p(F.col("n") / F.col("f")).alias("w"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (block, node, total, tags), sorted by block and node, as one row for each block: its nodes, their totals, its tags with weights, and each tag's nodes by place."""
    at, kept = None, []

    def block() -> pa.RecordBatch:
        t = pa.Table.from_batches(kept).combine_chunks()
        tags = t["tags"].combine_chunks()
        ids, w = (tags.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        place = np.repeat(np.arange(len(tags), dtype=np.int32), np.diff(tags.offsets.to_numpy()))
        order = np.argsort(ids, kind="stable")
        ids, w, place = ids[order], w[order], place[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        raw = {"ids": ids[first], "w": w[first], "starts": np.r_[first, len(ids)].astype(np.int64), "places": place, "totals": t["total"].to_numpy()}
        nodes = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t["node"].combine_chunks())
        return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "nodes": nodes} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in raw.items()})

    for b in batches:
        blocks = b["block"].to_numpy()
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else []
        for lo, hi in zip(edges, edges[1:]):
            if kept and blocks[lo] != at:
                yield block()
                kept = []
            at = int(blocks[lo])
            kept.append(b.slice(lo, hi - lo))
    if kept:
        yield block()


class _Block:
    def __init__(self, row: dict, side: str):
        get = lambda name, kind: np.frombuffer(row[f"{name}_{side}"], kind)
        self.ids, self.w, self.starts, self.places, self.totals = get("ids", np.int64), get("w", np.float64), get("starts", np.int64), get("places", np.int32).astype(np.intp), get("totals", np.float64)

    def by_node(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some of the block's tags (a mask), the places of each node's, node by node, and where each node's begin."""
        tag = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        here = some[tag]
        tag, places = tag[here], self.places[here]
        return tag[np.argsort(places, kind="stable")], np.r_[0, np.cumsum(np.bincount(places, minlength=len(self.totals)))]

    def table(self, tags: np.ndarray) -> np.ndarray:
        """One row for each of the tags (by place), one column for each node: 1.0 where the node has the tag."""
        out = np.zeros((len(tags), len(self.totals)))
        for row, t in zip(out, tags.tolist()):
            row[self.places[self.starts[t] : self.starts[t + 1]]] = 1.0
        return out


def _likeness(x: _Block, y: _Block) -> Iterator[tuple[int, np.ndarray]]:
    """The weighted Jaccard of x's nodes with y's, some rows of it at once: the place of the first, and the rows.

    Tags that many nodes have are summed by a product of matrices, the others through their nodes.
    """
    ids, mine, there = np.intersect1d(x.ids, y.ids, assume_unique=True, return_indices=True)
    at = np.zeros(len(x.ids), np.intp)
    at[mine] = there
    share = np.diff(x.starts)[mine] * np.diff(y.starts)[there] / max(len(x.totals) * len(y.totals), 1)
    often = np.argsort(-share, kind="stable")[:OFTEN]
    often = often[share[often] >= SHARE**2]
    left, right = (x.table(mine[often]) * x.w[mine[often], None]).T, y.table(there[often])
    rare = np.zeros(len(x.ids), bool)
    rare[mine] = True
    rare[mine[often]] = False
    tags, begins = x.by_node(rare)
    first, sizes = y.starts[at], np.diff(y.starts)[at] if len(y.ids) else at
    for lo in range(0, len(x.totals), STRIP):
        hi = min(lo + STRIP, len(x.totals))
        common = left[lo:hi] @ right
        for i in range(lo, hi):
            t = tags[begins[i] : begins[i + 1]]
            if len(t):
                n = sizes[t]
                ends = np.cumsum(n)
                met = y.places[np.arange(ends[-1]) + np.repeat(first[t] - (ends - n), n)]
                common[i - lo] += np.bincount(met, np.repeat(x.w[t], n), len(y.totals))
        rest = x.totals[lo:hi, None] + y.totals
        rest -= common
        common /= rest
        yield lo, common


def _floor(theta: float) -> float:
    return max(theta - _LEAST, 1e-300)  # nodes without a common tag are near at no theta


def _nearest(weights: np.ndarray, theta: float, k: int) -> np.ndarray:
    """Places that can be among the k best by weights rounded to nine digits, of equal ones the first: of any one weight no more than k."""
    near = np.flatnonzero(weights >= _floor(theta))
    if len(near) <= k:
        return near
    near = near[weights[near] >= np.partition(weights[near], len(near) - k)[len(near) - k] - 2e-9]
    near = near[np.lexsort((near, -weights[near]))]
    w, at = weights[near], np.arange(len(near))
    return near[at - np.maximum.accumulate(np.where(np.r_[True, w[1:] != w[:-1]], at, 0)) < k]


class _Columns:
    """Of rows that come in turn, what can be among the k best of each column, as _nearest() has it."""

    def __init__(self, n: int, theta: float, k: int):
        self.k, self.least = k, np.full(n, _floor(theta))
        self.i, self.j, self.w = np.zeros(0, np.intp), np.zeros(0, np.intp), np.zeros(0)

    def add(self, lo: int, rows: np.ndarray) -> None:
        if not len(self.w) and len(rows) > self.k:
            np.maximum(self.least, np.partition(rows, len(rows) - self.k, axis=0)[len(rows) - self.k] - 2e-9, out=self.least)
        at = np.flatnonzero(rows >= self.least)
        if not len(at):
            return
        i, j = np.divmod(at, rows.shape[1])
        i, j, w = np.r_[self.i, i + lo], np.r_[self.j, j], np.r_[self.w, rows.ravel()[at]]
        order = np.lexsort((i, -w, j))
        i, j, w, n = i[order], j[order], w[order], np.arange(len(order))
        begins = np.r_[True, j[1:] != j[:-1]]
        nth = n - np.maximum.accumulate(np.where(begins, n, 0))
        last = nth == self.k - 1
        self.least[j[last]] = np.maximum(self.least[j[last]], w[last] - 2e-9)
        equal = n - np.maximum.accumulate(np.where(begins | np.r_[True, w[1:] != w[:-1]], n, 0))
        keep = (w >= self.least[j]) & (equal < self.k)
        self.i, self.j, self.w = i[keep], j[keep], w[keep]


def _classes(sets: DataFrame, k: int) -> DataFrame:
    """sets as classes of equal tags: (node, members, total, tags), node the first of the members, which are the k + 1 first of the class.

    Those are each other's nearest and the k nearest of all others of the class, so no other node of it can
    be near mutually, and none comes before them for a node of another class.
    """
    same = Window.partitionBy(F.xxhash64("tags"), "total", "tags")
    first = sets.withColumn("nth", F.row_number().over(same.orderBy("node"))).filter(F.col("nth") <= k + 1)
    return first.withColumn("members", F.sort_array(F.collect_list("node").over(same))).filter("nth = 1").drop("nth")


def _met(nodes: DataFrame, theta: float, k: int | None) -> DataFrame:
    """(x, y, weight) of the nodes whose weighted Jaccard is theta or more: each pair once, or, with k, what can be among the k nearest of each x and mutual (see _classes()), and perhaps more of equal weight to nine digits."""
    spark = nodes.sparkSession
    nodes = Rounds(spark, "concept-nodes").put(nodes.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags")))
    one = nodes.select("node", F.explode("tags").alias("tag"))
    # Numbers stand for tags; a tag of one node alone counts in its total only.
    numbered = Rounds(spark, "concept-tags").put(_weighed(one, nodes).withColumn("id", F.monotonically_increasing_id()))
    one = one.filter(F.col("node").isNotNull()).join(numbered, "tag")
    alone, shared = F.when(F.col("f") == 1, F.col("w")), F.when(F.col("f") > 1, F.struct("id", "w"))
    sets = one.groupBy("node").agg(F.sort_array(F.collect_list(shared)).alias("tags"), F.coalesce(F.sum(alone), F.lit(0.0)).alias("alone"))
    # In the order of the tags, so that equal sets have equal totals.
    sets = sets.select("node", "tags", F.aggregate("tags", F.col("alone"), lambda sum, t: sum + t["w"]).alias("total"))
    sets = Rounds(spark, "concept-sets").put(sets if k is None else _classes(sets, k))
    kind, width = sets.schema["node"].dataType.simpleString(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(math.ceil(sets.count() / BLOCK), math.ceil((6 * width) ** 0.5))
    dealt = sets.select(F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias("block"), "node", "total", "tags").repartition(n, "block").sortWithinPartitions("block", "node")
    packed = Rounds(spark, "concept-blocks").put(dealt.mapInArrow(_packed, f"block int, nodes array<{kind}>, ids binary, w binary, starts binary, places binary, totals binary"))
    side = lambda s: packed.select(*[F.col(c).alias(f"{c}_{s}") for c in packed.columns])
    # Every two blocks, and each with itself: (low, high) by number, in more tasks than Spark makes by their bytes.
    tasks = min(n * (n + 1), 4096)
    low = side("x").withColumn("high", F.explode(F.sequence(F.col("block_x"), F.lit(n - 1)))).repartition(tasks, "block_x", "high")
    high = side("y").withColumn("low", F.explode(F.sequence(F.lit(0), F.col("block_y")))).repartition(tasks, "low", "block_y")
    pairs = low.hint("merge").join(high, (F.col("block_x") == F.col("low")) & (F.col("high") == F.col("block_y")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                names = {s: b[f"nodes_{s}"][r].values for s in "xy"}
                raw = {c: b[c][r].as_py() for c in b.schema.names if not c.startswith("nodes")}
                x, y, same = _Block(raw, "x"), _Block(raw, "y"), raw["block_x"] == raw["block_y"]
                back = None if k is None or same else _Columns(len(y.totals), theta, k)
                i, j, w, rows = [], [], [], 0

                def out(i, j, w, p="x", q="y"):
                    return pa.RecordBatch.from_arrays([names[p].take(pa.array(i)), names[q].take(pa.array(j)), pa.array(w)], ["x", "y", "weight"])

                for lo, strip in _likeness(x, y):
                    for at, weights in enumerate(strip, lo):
                        if same:
                            weights[: at + 1 if k is None else 0] = -1.0
                            weights[at] = -1.0
                        near = np.flatnonzero(weights >= _floor(theta)) if k is None else _nearest(weights, theta, k)
                        if len(near):
                            i.append(np.full(len(near), at)), j.append(near), w.append(weights[near])
                            rows += len(near)
                        if rows > 100_000:
                            yield out(*map(np.concatenate, (i, j, w)))
                            i, j, w, rows = [], [], [], 0
                    if back:
                        back.add(lo, strip)
                if rows:
                    yield out(*map(np.concatenate, (i, j, w)))
                if back and len(back.w):
                    yield out(back.j, back.i, back.w, "y", "x")

    met = pairs.mapInArrow(meet, f"x {kind}, y {kind}, weight double")
    if k is None:
        return met
    # The k nearest classes have the k nearest nodes of other classes.
    nearest = met.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy(F.round("weight", 9).desc(), "y"))).filter(F.col("nth") <= k).select("x", "y", "weight")
    members = lambda s: sets.select(F.col("node").alias(s), F.col("members").alias(f"members_{s}"))
    among = nearest.join(members("x"), "x").join(members("y"), "y").select("members_x", "members_y", "weight")
    if 1.0 >= _floor(theta):
        among = among.unionByName(sets.filter(F.size("members") > 1).select(F.col("members").alias("members_x"), F.col("members").alias("members_y"), F.lit(1.0).alias("weight")))
    return among.select(F.explode("members_x").alias("x"), "members_y", "weight").select("x", F.explode("members_y").alias("y"), "weight").filter("x <> y")


def near_pairs(nodes: DataFrame, theta: float = THETA) -> DataFrame:
    """(a, b, weight) of the pairs a < b whose weighted Jaccard is theta or more.

    A node's tags count once; nodes without tags are near none; of repeated nodes all tags count.
    """
    return _met(nodes, theta, None).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")


def mutual_pairs(nodes: DataFrame, theta: float = THETA, k: int = TOP) -> DataFrame:
    """mutual() of near_pairs(), with weights rounded to nine digits, without making all pairs: (a, b, weight)."""
    return _mutual(_met(nodes, theta, k).withColumn("weight", F.round("weight", 9)), k)


def mutual(pairs: DataFrame, k: int = TOP) -> DataFrame:
    """The pairs (a, b, weight) in which each is among the other's k nearest, of equal ones those of smaller name."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))
    return _mutual(both, k)


def _mutual(both: DataFrame, k: int) -> DataFrame:
    """mutual() of pairs given both ways (x, y, weight)."""
    nearest = both.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy(F.col("weight").desc(), "y"))).filter(F.col("nth") <= k)
    ends = nearest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")
    return ends.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("weight").alias("weight")).filter("n = 2").select("a", "b", "weight")


def pagerank(nodes: DataFrame, pairs: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """(node, rank) of the weighted graph of pairs (a, b, weight), taken both ways; ranks add up to 1.

    A node without pairs spreads its rank over all nodes evenly, so what each gets by that is known
    beforehand. The others' ranks are iterated until a step would move them by less than tolerance in all,
    each round written. As the graph has both ways of a pair, its eigenvalues are real, and Chebyshev's
    acceleration holds: a round leaves 0.56 of the error where a plain step leaves 0.85. Pairs of a
    node with itself, or of unknown nodes, don't count.
    """
    spark = nodes.sparkSession
    names = Rounds(spark, "rank-nodes").put(nodes.select("node").distinct())
    known = pairs.filter("a <> b").join(names.withColumnRenamed("node", "a"), "a", "left_semi").join(names.withColumnRenamed("node", "b"), "b", "left_semi")
    known = Rounds(spark, "rank-pairs").put(known.select("a", "b", "weight"))
    ways = known.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionByName(known.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))
    out = Rounds(spark, "rank-out").put(ways.groupBy("x").agg(F.sum("weight").alias("all")))
    links = Rounds(spark, "rank-links").put(ways.join(out, "x").select("x", "y", (F.col("weight") / F.col("all")).alias("share")))
    n, linked = names.count(), out.count()
    even = 1.0 / max(n, 1) if not linked else (1 - damping) / (n - damping * (n - linked))
    ranks = Rounds(spark, "rank")
    start = F.lit((1 - even * (n - linked)) / max(linked, 1))
    now = ranks.put(out.select(F.col("x").alias("node"), start.alias("rank"), start.alias("past"), F.lit(1.0).alias("moved")))
    pace = 1.0
    for i in range(rounds if linked else 0):
        come = links.join(now.select(F.col("node").alias("x"), "rank"), "x").groupBy(F.col("y").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("come"))
        step = even + damping * F.col("come")
        new = F.col("past") + pace * (step - F.col("past"))
        now = ranks.put(now.join(come, "node").select("node", new.alias("rank"), F.col("rank").alias("past"), F.abs(step - F.col("rank")).alias("moved")))
        if now.agg(F.sum("moved")).first()[0] < tolerance:
            break
        pace = 1 / (1 - damping**2 * pace / (4 if i else 2))
    alone = names.join(out.select(F.col("x").alias("node")), "node", "left_anti")
    return now.select("node", "rank").unionByName(alone.select("node", F.lit(even).alias("rank")))
