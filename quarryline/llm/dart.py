"""Operator 7: near-duplicate documents by DartMinHash and banded joining.

A text is the multiset of its shingles, runs of five words (all words, if there are fewer), case
kept; similarity is weighted Jaccard, the sum of smaller counts over the sum of larger ones, and
0.8 or more is near. Each unit of an element's weight is a region in which darts lie at hashed
places: their ranks are the arrivals of a Poisson process, and each belongs to a hashed coordinate.
A text throws the darts of its regions up to a rank that leaves about log(COORDINATES) + SPARE darts
for each coordinate, and keeps the earliest of each coordinate; if one got none, the rank is doubled.
Two texts keep the same dart in a coordinate with probability equal to their similarity.

Signatures are cut into BANDS bands of ROWS; texts with an equal band are candidates (a pair at 0.8
is missed with a probability of 5e-5). In each band's group all texts
are first compared with one of them, the centre, by the exact similarity of whole texts; that joins
most of a large group without pairs among its members. Then what is outside a group's largest
component meets a text drawn from it, another in each band. Last, texts of different components that
share a band are compared, except with those of the group's largest component among one another, and
unless their parity sketches show that they differ too much. So every candidate pair is compared,
already in one class, or shown to be too far apart.

Defined results: equal texts are one node whatever their number, and always in one class; null text
is the empty text; texts without words are near equal ones only; class_id is the class's smallest
doc_id (null doc_ids only where all are null); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quarryline.llm.common import bare, clean_text, cut, slices, with_numbers

WORDS, NEAR = 5, 0.8
BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
SPARE = 4
#: Darts that a text throws on average, whatever its length.
DARTS = int(COORDINATES * (np.log(COORDINATES) + SPARE))
#: Words that a worker remembers the hashes of; regions and darts handled at once.
REMEMBER, AT_ONCE = 100_000, 200_000
TURNS, HOT_SHARE = 1, 1e-3
#: Longs of a sketch: texts of some hundred words are told apart well, longer ones are compared.
SKETCH = 12

_U = np.uint64
_GOLD, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> _U(11)).astype(np.float64) + 1) * 2.0**-53


class Shingles:
    """Hashes of a text's shingles, with their counts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, text: str) -> np.ndarray:
        words, known = text.split(), self.known
        if len(known) > REMEMBER:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode())
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h)
        if not n:
            return h
        with np.errstate(over="ignore"):
            span = min(n, WORDS)
            got = np.zeros(n - span + 1, np.uint64)
            for i in range(span):
                got = mix(got * _GOLD + h[i : n - span + 1 + i])
        return got

    def weights(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.hashes(text), return_counts=True)


def throw(regions: np.ndarray, part: np.ndarray, owner: np.ndarray, limit: np.ndarray, coordinates: int) -> tuple[np.ndarray, ...]:
    """The darts of regions up to the limit of their owner: owner, coordinate, rank, identity.

    part: the share of the region that the weight covers; darts have a place in it, and those beyond miss.
    """
    found = []
    rank, live, j = np.zeros(len(regions)), np.arange(len(regions)), 1
    with np.errstate(over="ignore"):
        while len(live):
            h = mix(regions[live] + _U(j) * _GOLD)
            rank = rank - np.log(uniform(h))
            near = rank <= limit[owner[live]]
            rank, live, h = rank[near], live[near], h[near]
            hit = slice(None) if (part == 1).all() else uniform(mix(h ^ _B)) <= part[live]
            ident = mix(h + _A)
            found.append((owner[live][hit], (ident % _U(coordinates)).astype(np.int64)[hit], rank[hit], ident[hit]))
            j += 1
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, np.uint64))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of dart identities for each weighted set (element hashes, weights); sets without weight get zeros."""
    out = np.zeros((len(sets), coordinates), np.uint64)
    total = np.array([w.sum() for _, w in sets], float)
    todo = np.flatnonzero(total > 0)
    aim = coordinates * (np.log(coordinates) + SPARE)
    while len(todo):
        whole = [np.ceil(sets[i][1]).astype(np.int64) for i in todo]
        owner = np.repeat(np.arange(len(todo)), [w.sum() for w in whole])
        element = np.concatenate([np.repeat(sets[i][0], w) for i, w in zip(todo, whole, strict=True)])
        weight = np.concatenate([np.repeat(np.asarray(sets[i][1], float), w) for i, w in zip(todo, whole, strict=True)])
        counts = np.concatenate(whole)
        unit = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            regions = mix(element + unit.astype(np.uint64) * _B)
        d, c, rank, ident = throw(regions, np.minimum(1.0, weight - unit), owner, aim / total[todo], coordinates)
        last = np.argsort(-rank, kind="stable")  # the smallest rank is written last
        got, filled = np.zeros((len(todo), coordinates), np.uint64), np.zeros((len(todo), coordinates), bool)
        got[d[last], c[last]] = ident[last]
        filled[d, c] = True
        whole_rows = filled.all(1)
        out[todo[whole_rows]] = got[whole_rows]
        todo, aim = todo[~whole_rows], aim * 2
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash of each band."""
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _B, (len(signature), BANDS)).copy()
        for r in range(ROWS):
            h = mix(h * _GOLD + signature[:, r::ROWS])
    return h.view(np.int64)


def _banded():
    shingles = Shingles()

    def function(texts: list[str]) -> list[pa.Array]:
        out: list[np.ndarray | None] = []
        sets, size = [], 0

        def flush():
            nonlocal sets, size
            if sets:
                out.extend(b if w.sum() else None for b, (_, w) in zip(bands(signatures(sets)), sets, strict=True))
            sets, size = [], 0

        for t in texts:
            sets.append(shingles.weights(t))
            size += int(sets[-1][1].sum()) + DARTS
            if size > AT_ONCE:
                flush()
        flush()
        return [pa.array([[] if b is None else b for b in out], pa.list_(pa.int64()))]

    return function


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sets with sorted elements."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = np.minimum(a[1][at][same], b[1][same]).sum() if len(a[0]) else 0
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either else 1.0


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles, recent = Shingles(), {}

    def weights(text: str):
        if text not in recent:
            if len(recent) >= 64:
                recent.pop(next(iter(recent)))
            recent[text] = shingles.weights(text)
        return recent[text]

    for b in slices(batches):
        got = [similarity(weights(x), weights(y)) >= NEAR for x, y in zip(b["text_b"].to_pylist(), b["text_a"].to_pylist(), strict=True)]
        keep = pa.array(got, pa.bool_())
        yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], ["a", "b"])


def near_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are near by their whole texts."""
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_near, "a long, b long")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for b in slices(batches):
        weight, bits = [], []
        for text in b["text"].to_pylist():
            h, n = shingles.weights(text)
            unit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            with np.errstate(over="ignore"):
                at = mix(np.repeat(h, n) + unit.astype(np.uint64) * _B) % _U(64 * SKETCH)
            weight.append(int(n.sum()))
            bits.append(np.packbits(np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1).view(np.int64))
        yield pa.RecordBatch.from_arrays([b["node"], pa.array(weight, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], ["node", "weight", "sketch"])


def sketches(texts: DataFrame) -> DataFrame:
    """(node, weight, sketch): bits that are the parity of the units of weight that hash to them; two texts differ in at least as many units as bits."""
    return texts.select("node", "text").mapInArrow(_sketch, "node long, weight long, sketch array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes with an edge (a, b): the smallest node reachable, by neighbours' smallest labels and label jumps."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("theirs")), "b").groupBy("a").agg(F.min("theirs").alias("least"))
        lower = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "least").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("component").alias("further"))
        new = cut(lower.join(jump, "least").select("node", F.least("least", "further").alias("component"), (F.least("least", "further") < F.col("component")).alias("moved")), "labels")
        moved = new.filter("moved").limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, same) and nodes (node, same, n, first_id, hashes of bands): a node for each distinct text."""
    text = clean_text()
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"))
    rows = cut(with_numbers(keyed, ["doc_id", "same"], [("bands", ArrayType(LongType()))], _banded), "dart-rows")
    # A node's number is fixed once it is written; ids are only unique, not in any order.
    grouped = rows.groupBy("same").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    return rows.select("doc_id", "same"), cut(grouped.withColumn("node", F.monotonically_increasing_id()), "dart-nodes")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Near pairs (a, b) of nodes, enough to connect every two that a chain of near candidates connects."""
    banded = cut(nodes.select("node", F.explode("bands").alias("band")), "dart-bands")
    groups = cut(banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("size")).filter("size > 1"), "dart-groups")
    shared = cut(banded.join(groups, "band").select("band", "node", "centre"), "dart-shared")
    tried = cut(shared.filter("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "dart-tried")
    wanted = shared.select("node").distinct().join(nodes.select("node", "same"), "node")
    text = clean_text()
    found = docs.select(text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same")).join(wanted, "same")
    texts = cut(found.groupBy("node").agg(F.first("text").alias("text")), "dart-texts")
    first = cut(near_pairs(tried, texts), "dart-links")

    found = first
    for turn in range(TURNS):
        opened = _open(shared, found)
        hubs = opened.filter("component = largest").groupBy("band").agg(F.min_by("node", F.xxhash64("node", "band", F.lit(turn))).alias("hub"))
        met = opened.filter("component != largest").join(hubs, "band").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
        new = cut(met.join(tried, ["a", "b"], "left_anti"), "dart-tried")
        tried, found = tried.unionByName(new), found.unionByName(cut(near_pairs(new, texts), "dart-links"))

    opened = _open(shared, found)
    open_ = opened.join(cut(sketches(texts.join(opened.select("node").distinct(), "node", "left_semi")), "dart-sketches"), "node")
    few = open_.filter("component != largest").select(F.col("band").alias("at"), F.col("node").alias("x"), F.col("component").alias("of_x"), F.col("weight").alias("weight_x"), F.col("sketch").alias("sketch_x"))
    rest = open_.select("band", F.col("node").alias("y"), F.col("component").alias("of_y"), (F.col("component") == F.col("largest")).alias("main"), "weight", "sketch")
    differ = F.aggregate(F.zip_with("sketch", "sketch_x", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, bits: n + bits)
    # Texts that are near differ in this share of both weights at most.
    enough = differ <= (F.col("weight") + F.col("weight_x")) * ((1 - NEAR) / (1 + NEAR)) + 1e-6
    across = few.join(rest, (F.col("at") == F.col("band")) & (F.col("of_x") != F.col("of_y")) & (F.col("main") | (F.col("x") > F.col("y"))) & enough)
    left = across.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return found.unionByName(cut(near_pairs(left, texts), "dart-links"))


def _open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(band, node, component, largest) of the bands' groups that hold more than one component yet."""
    part = components(links).withColumnRenamed("component", "known")
    placed = shared.join(part, "node", "left").select("band", "node", F.coalesce("known", "node").alias("component"))
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("band").agg(F.max_by("component", F.struct("size", "component")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    return cut(placed.join(largest.select("band", "largest"), "band"), "dart-open")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, same) for every document, and the class's representative flag `kept`."""
    rows, nodes = _nodes(docs)
    part = components(links(docs, nodes))
    named = nodes.join(part, "node", "left").select("same", "first_id", "n", F.coalesce("component", "node").alias("component"))
    whole = named.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = cut(named.join(whole, "component").select("same", "first_id", "n", "class_id", "class_size", "component"), "dart-named")
    total = rows.count()
    hot = named.filter(F.col("n") > max(1, total * HOT_SHARE)).drop("first_id", "n")  # at most 1 / HOT_SHARE texts
    flagged = rows.join(F.broadcast(hot), "same", "left")
    cold = flagged.filter(F.col("component").isNull()).select("doc_id", "same").join(named.drop("first_id", "n"), "same")
    return flagged.filter(F.col("component").isNotNull()).unionByName(cold)


def near_classes(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns: the one with the smallest doc_id, then the smallest text; of rows equal in both, one."""
    inner, restored = bare(docs, "doc_id", "text")
    rows, nodes = _nodes(inner)
    part = components(links(inner, nodes))
    named = nodes.join(part, "node", "left").select("same", "first_id", F.coalesce("component", "node").alias("component"))
    first = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("same").alias("s"))
    chosen = cut(named.groupBy("component").agg(F.min(first).alias("f")).select(F.col("f.id").alias("__id"), F.col("f.s").alias("__same")), "dart-kept")
    text = clean_text()
    keyed = inner.withColumn("__same", F.unhex(F.sha2(text.cast("binary"), 256)))
    held = keyed.join(chosen, (keyed["__same"] == chosen["__same"]) & keyed["doc_id"].eqNullSafe(chosen["__id"]), "left_semi")
    # Rows with the same doc_id and text (a repeated row) count as one.
    return restored(held.dropDuplicates(["doc_id", "__same"]))
