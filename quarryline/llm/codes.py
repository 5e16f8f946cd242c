"""Operator 13: vectors as one byte for each of four parts, by codebooks that are searched as ball trees.

Components become the integers floor(1024 x), and a vector is cut into PARTS equal parts. Each part's
codebook starts as that part of the ENTRIES smallest vec_ids; each of ROUNDS rounds gives every part
to its nearest entry and moves each entry to the floor of its parts' mean.

The nearest entry is found by metric branch and bound: a part position's entries are a ball tree of
two levels, leaf balls of about LEAF entries around one of them, with radii rounded up to integers. For
a block of parts the distances to the balls' centres are computed and rounded down; each part then
visits its balls by rising lower bound, as long as that bound is not above the best distance found, so
that ties are seen too. Within a ball the squared distances are integers, and of equal ones the entry
of lower index wins.

A round is one pass over the rows: tasks sum the parts of each entry, Spark adds the sums up, and the
driver gets one row for an entry and component, whose number is set by the parameters. The codebooks
go to the tasks with their code. The last pass writes the codes to the shared folder, since the sums
by label need them too; labels are joined by salted keys, for one of them may have a third of all rows.

Defined results: vectors of other lengths have codebooks of their own, from the smallest vec_ids of
that length; a length that four doesn't divide is filled with zeros; empty vectors have the code of
entry 0 and no error; a row without vec_id is coded, and comes last where entries are chosen; of rows
with one vec_id the smaller vectors come first; components beyond 2^90 count as that; an error
beyond a long is the greatest long; an empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import cut

SCALE, PARTS, ENTRIES, ROUNDS, LEAF, BLOCK, SALTS = 1024.0, 4, 256, 4, 32, 4096, 32
#: The greatest component that is told from greater ones, so that sums fit a decimal.
LARGEST = 2.0**90
_LONG = (1 << 63) - 1

#: Of each part position, the entries' integer components.
Books = list[np.ndarray]


def fitted(whole: np.ndarray) -> np.ndarray:
    """Integers as int64 where all squared distances of such rows are below 2^53, else as Python's."""
    most = max((abs(int(x)) for x in (whole.max(initial=0), whole.min(initial=0))))
    return whole.astype(np.int64) if most**2 * 4 * max(whole.shape[1], 1) < 1 << 53 else np.array([[int(x) for x in r] for r in whole.tolist()], object).reshape(whole.shape)


def split(vectors: np.ndarray) -> list[np.ndarray]:
    """The integer parts of rows of one length."""
    whole = np.floor(np.clip(SCALE * vectors, -LARGEST, LARGEST))
    if whole.shape[1] % PARTS:
        whole = np.pad(whole, ((0, 0), (0, -whole.shape[1] % PARTS)))
    return [fitted(part) for part in np.split(whole, PARTS, axis=1)]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b, exact integers (as doubles, if they are below 2^53)."""
    if object in (a.dtype, b.dtype):
        a, b = a.astype(object), b.astype(object)
    else:
        a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def root_up(square: int) -> int:
    """The least integer whose square is at least `square`."""
    return isqrt(square - 1) + 1 if square > 0 else 0


class BallTree:
    """The entries of one part position, in balls around some of them."""

    def __init__(self, entries: np.ndarray):
        n = len(entries)
        self.entries = entries
        # Farthest-first: each next centre is the entry farthest from those before, the lowest index of equals.
        between, chosen = squares(entries, entries), [0]
        near = between[0].copy()
        while len(chosen) < -(-n // LEAF) and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, between[chosen[-1]])
        owner = between[:, chosen].argmin(1)
        self.members = [np.flatnonzero(owner == i) for i in range(len(chosen))]
        self.centres = entries[chosen]
        self.radius = np.array([root_up(int(between[m, c].max())) for m, c in zip(self.members, chosen, strict=True)], between.dtype)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each part's nearest entry, the lower index of equals."""
        n, exact = len(parts), object in (parts.dtype, self.entries.dtype)
        best = np.full(n, -1, object) if exact else np.full(n, np.inf)
        index = np.full(n, len(self.entries), np.int64)
        if exact:
            best[:] = 1 << 5000
        to = squares(parts, self.centres)
        # Distances rounded down less radii rounded up: below every distance to an entry of the ball.
        root = np.vectorize(lambda s: root_up(int(s) + 1) - 1, otypes=[object])(to) if exact else np.floor(np.sqrt(to))
        below = np.maximum(root - self.radius, 0)
        order = np.argsort(below, axis=1, kind="stable")
        for turn in range(len(self.members)):
            ball = order[:, turn]
            bound = below[np.arange(n), ball]
            visit = np.flatnonzero(bound * bound <= best)
            if not len(visit):
                break
            for b in np.unique(ball[visit]):
                rows = visit[ball[visit] == b]
                mine = self.members[b]
                found = squares(parts[rows], self.entries[mine])
                at = found.argmin(1)  # members rise, so the first of equals has the lowest index
                distance, entry = found[np.arange(len(rows)), at], mine[at]
                better = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
                best[rows[better]], index[rows[better]] = distance[better], entry[better]
        return index, best


def _vectors(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places, vectors) of a batch, for each length."""
    column = b["embedding"]
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        places = np.flatnonzero(lengths == dim)
        for i in range(0, len(places), BLOCK):
            at = places[i : i + BLOCK]
            yield int(dim), at, flat[starts[at][:, None] + np.arange(dim)]


_SUMS = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.string()), ("n", pa.int64())])


def _summer(books: dict[int, Books]):
    """A task's sums of each entry's parts, one row for each component; as text, for integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {dim: [BallTree(e) for e in book] for dim, book in books.items()}
        sums: dict[tuple[int, int, int], list] = {}
        for b in batches:
            for dim, _, vectors in _vectors(b):
                for p, (parts, tree) in enumerate(zip(split(vectors), trees[dim], strict=True)):
                    index, _ = tree.nearest(parts)
                    order = np.argsort(index, kind="stable")
                    entries, firsts, counts = np.unique(index[order], return_index=True, return_counts=True)
                    totals = np.add.reduceat(parts[order], firsts, axis=0) if parts.shape[1] else np.zeros((len(entries), 0), np.int64)
                    for e, t, n in zip(entries.tolist(), totals.astype(object), counts.tolist(), strict=True):
                        old, m = sums.get((dim, p, e), (0, 0))
                        sums[dim, p, e] = [t + old, m + n]
        for (dim, p, e), (total, n) in sums.items():
            rows = [(dim, p, e, i, str(x), n) for i, x in enumerate(total)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMS, strict=True)], schema=_SUMS)

    return run


def moved(books: dict[int, Books], rows: DataFrame) -> dict[int, Books]:
    """The codebooks after a round over rows (embedding)."""
    sums = rows.select("embedding").mapInArrow(_summer(books), "dim int, part int, entry int, place int, total string, n long")
    got = sums.groupBy("dim", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"))
    new = {dim: [e.astype(object) for e in book] for dim, book in books.items()}
    for r in got.collect():
        new[r["dim"]][r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return {dim: [fitted(e) for e in book] for dim, book in new.items()}


def digest(book: Books) -> str:
    return hashlib.sha256(",".join(str(int(x)) for entries in book for entry in entries for x in entry).encode()).hexdigest()


def kept(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that are coded, components as doubles."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "label", e.cast("array<double>").alias("embedding")).filter(e.isNotNull() & finite)


def first_books(rows: DataFrame, entries: int = ENTRIES) -> dict[int, Books]:
    """The codebooks to start with, by length: of the smallest vec_ids."""
    books = {}
    for dim in sorted(r[0] for r in rows.select(F.size("embedding").alias("d")).distinct().collect()):
        own = rows.filter(F.size("embedding") == dim).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).filter(F.size("embedding") >= 0)  # a step after the limit: else the driver gets as many rows of every task
        found = [r["embedding"] for r in own.select("embedding").collect()]
        books[dim] = split(np.array(found, float).reshape(len(found), dim))
    return books


_CODED = pa.schema([("code", pa.string()), ("error", pa.int64()), ("dim", pa.int32())])


def _coder(books: dict[int, Books], kind: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {dim: [BallTree(e) for e in book] for dim, book in books.items()}
        for b in batches:
            codes, errors, dims = [""] * b.num_rows, [0] * b.num_rows, np.zeros(b.num_rows, np.int32)
            for dim, at, vectors in _vectors(b):
                found = [tree.nearest(parts) for parts, tree in zip(split(vectors), trees[dim], strict=True)]
                for i, row in enumerate(at.tolist()):
                    codes[row] = "".join(f"{int(index[i]):02x}" for index, _ in found)
                    errors[row] = min(sum(int(square[i]) for _, square in found), _LONG)
                dims[at] = dim
            new = [pa.array(c, f.type) for c, f in zip((codes, errors, dims), _CODED, strict=True)]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], *new], ["vec_id", "label", "code", "error", "dim"])

    return run


def compress(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the rows that are kept."""
    coming = kept(rows)
    books = first_books(coming, entries)
    for _ in range(rounds):
        books = moved(books, coming)
    kinds = {n: coming.schema[n].dataType.simpleString() for n in ("vec_id", "label")}
    coded = cut(coming.mapInArrow(_coder(books, _CODED), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, dim int"), "codes")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "of")
    own = coded.withColumn("at", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    met = own.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("at") == F.col("salt")))
    names = {dim: digest(book) for dim, book in books.items()}
    sha = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("dim")) if names else F.lit(None).cast("string")
    return met.select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))
