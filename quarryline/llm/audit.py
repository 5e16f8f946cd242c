"""Operator 11: how filters interact, over every order of applying them.

Each document gets a mask of the filters that it fails. Masks are counted in cells, at most 2^n for
a part of the table, and nothing else of the documents is needed. All n! orders are then visited by a
walk in which neighbours differ by one swap of adjacent filters (plain changes). A swap leaves every
other step as it was, so only the two swapped steps are summed anew, from the mask cells. The Shapley
sum of a filter adds up, along the walk, what it removes at whatever step it stands.

Which row of equal texts is the first is decided by counting, not by a join of documents with their
copies: rows are counted by text and part, beside the counts of the smallest doc_id among them, so a
text that a third of all documents share is a few rows before it is shuffled.

Defined results: null texts are empty, a null part is ''; an empty text has no words, so it fails A
only of A to D, and E where a smaller doc_id's text is empty too; rows of one doc_id aren't copies of
each other; a row without doc_id fails E never, is no text's first, and has no labels; a document is
good or toxic if any label row of its doc_id says so; an empty table gives no rows; extra columns are
ignored, whatever their names. Texts are equal if their SHA-256 is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import clean_text

FILTERS = "ABCDE"
#: Thresholds of the contract: least words, least percentage of distinct words, most percentage of capitals, the characters that no clean text holds.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"


def plain_changes(n: int) -> Iterator[int]:
    """The places i of n! - 1 swaps (i, i + 1) that lead through all orders of n things: the last thing sweeps through each order of the others."""
    if n < 2:
        return
    inner, down = plain_changes(n - 1), True
    while True:
        yield from reversed(range(n - 1)) if down else range(n - 1)
        if (step := next(inner, None)) is None:
            return
        yield step + down  # the sweeping thing stands first after a sweep down
        down = not down


def walk(cells: np.ndarray, names: str) -> Iterator[tuple[str, np.ndarray]]:
    """Each order with its steps' numbers (step, (kept, removed, redundant, good lost, toxic lost)), of cells (2^n, (documents, good, toxic)) by mask."""
    n, masks = len(names), np.arange(1 << len(names))
    fails = [int(cells[(masks >> f & 1) == 1, 0].sum()) for f in range(n)]

    def step(f: int, before: int) -> np.ndarray:
        """What filter f removes after the filters of the mask `before`, from the cells that it fails and they don't."""
        return cells[((masks >> f & 1) == 1) & (masks & before == 0)].sum(0)

    order, now = list(range(n)), np.zeros((n, 5), np.int64)

    def put(i: int, before: int) -> None:
        removed, good, toxic = step(order[i], before)
        left = now[i - 1, 0] if i else cells[:, 0].sum()
        now[i] = left - removed, removed, fails[order[i]] - removed, good, toxic

    for i in range(n):
        put(i, sum(1 << f for f in order[:i]))
    yield names, now
    for i in plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << f for f in order[:i])
        put(i, before)
        put(i + 1, before | 1 << order[i])
        yield "".join(names[f] for f in order), now


_ROWS = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _walker(names: str):
    n = len(names)

    def of(part: str, found: list[dict]) -> pa.RecordBatch:
        cells = np.zeros((1 << n, 3), np.int64)
        for c in found:
            cells[c["mask"]] = c["n"], c["good"], c["toxic"]
        orders, numbers, shapley = [], [], dict.fromkeys(names, 0)
        for order, now in walk(cells, names):
            for f, removed in zip(order, now[:, 1], strict=True):
                shapley[f] += int(removed)
            orders += [order] * n
            numbers.append(now.copy())
        kept, removed, redundant, good, toxic = np.concatenate(numbers).T
        at = [order[i % n] for i, order in enumerate(orders)]
        alone = [int(cells[1 << names.index(f), 0]) for f in at]
        columns = [[part] * len(at), orders, [i % n + 1 for i in range(len(at))], kept, removed, redundant, alone, good, toxic, [shapley[f] for f in at]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield of(r["part"], r["cells"])

    return run


def failures(text: Column) -> Column:
    """The bits of the filters that look at one text: A and B by its words, C by its capitals, D by its marks."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    tests = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(MARKS))
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, mask: Column | None = None) -> DataFrame:
    """(part, mask, n, good, toxic) of the documents by lang and by the filters that they fail; the highest bit is for texts of a smaller doc_id's document. mask: the other filters' bits, of `text`."""
    text = clean_text(F.col("text"))
    bit = 1 << (len(FILTERS) - 1)
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), (failures(text) if mask is None else mask).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0).cast("long"))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    # Rows without an id meet no label, but go where their text's hash sends them, not to one task.
    keyed = rows.withColumns({"key": F.coalesce("doc_id", F.xxhash64("digest")), "known": F.col("doc_id").isNotNull()})
    told = keyed.join(marks.select(F.col("doc_id").alias("key"), F.lit(True).alias("known"), "good", "toxic"), ["key", "known"], "left").na.fill(0, ["good", "toxic"])
    sums = lambda n: (F.col(n), F.col(n) * F.col("good"), F.col(n) * F.col("toxic"))
    all_of = [F.sum(c).alias(k) for c, k in zip(sums("n"), ("n", "good", "toxic"), strict=True)]
    nameless = F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("nameless")
    first = F.min(F.when(F.col("known"), F.struct("doc_id", *[c.alias(k) for c, k in zip(sums("n"), ("n", "good", "toxic"), strict=True)]))).alias("first")
    texts = told.groupBy("digest", "part", "mask").agg(*all_of, nameless, first)
    # A text's rows are one for each part by now.
    texts = texts.withColumn("is_first", F.coalesce(F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest")), F.lit(False)))
    own = {k: F.when(F.col("is_first"), F.col(f"first.{k}")).otherwise(0) for k in ("n", "good", "toxic")}
    own["n"] = own["n"] + F.col("nameless")
    two = F.array(F.struct(F.col("mask"), *[c.alias(k) for k, c in own.items()]), F.struct((F.col("mask") + bit).alias("mask"), *[(F.col(k) - c).alias(k) for k, c in own.items()]))
    return texts.select("part", F.explode(two).alias("c")).groupBy("part", "c.mask").agg(*[F.sum(f"c.{k}").alias(k) for k in ("n", "good", "toxic")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_walker(FILTERS), _SCHEMA)
