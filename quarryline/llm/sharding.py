"""Operator 3: minimax contiguous partition of documents into shards of near equal bytes.

Atomic groups are the documents of equal text, ordered by their smallest doc_id (groups that share
it, which takes repeated doc_ids, are one atom). The capacity is found by binary search with a
greedy check, over a summary of the atoms: ordered buckets with their sums. The greedy check runs
with bounds, since a cut may fall inside a bucket; only buckets that could still hold a cut are
split further, in one pass for all of them, until the smallest feasible capacity and its cuts are
exact. So the driver holds a bounded number of bucket sums whatever the input's size. An atom larger
than the mean of what remains takes a shard of its own, and the rest is divided among the others.

Law: `bytes`. Defined results: null text has size 8 and CRC 0; an empty table gives no rows; with
fewer atoms than shards some shards stay empty; null doc_ids order before all others; repeated rows
are rows each; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import clean_text, cut, range_bucket

SHARDS = 24
#: Buckets of the first summary, parts that a bucket is split into, salts of a shard's slots.
BUCKETS, PARTS, SALTS = 1024, 64, 64
#: A group with more than this share of the rows is hot; there are at most as many as its inverse.
HOT_SHARE = 1e-3
NULL_ID = -(2**63)


@dataclass(frozen=True)
class Bucket:
    """Atoms with keys from `low` to `high`, both of which occur."""

    root: int
    low: int
    high: int
    size: int
    atoms: int


def _floor(sums: list[int], value: int) -> int:
    """The largest of the prefix sums that is at most value."""
    return sums[bisect_right(sums, value) - 1]


def bounds(buckets: list[Bucket], sums: list[int], capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """After each shard, bounds on how many bytes the greedy check has placed: cutting only between buckets, and cutting anywhere but in an atom."""
    low, high, lows, highs = 0, 0, [], []
    for _ in range(shards):
        low = _floor(sums, low + capacity)
        high = min(high + capacity, sums[-1])
        i = bisect_right(sums, high) - 1
        if i < len(buckets) and buckets[i].atoms == 1:
            high = sums[i]
        lows.append(low)
        highs.append(high)
    return lows, highs


def _first(least: int, most: int, holds) -> int:
    while least < most:
        middle = (least + most) // 2
        least, most = (least, middle) if holds(middle) else (middle + 1, most)
    return least


def even(sums: list[int], capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Cuts of no more than capacity, each as near to an equal share of the rest as that allows, and the buckets that hold the equal shares."""
    total, need = sums[-1], [0] * shards
    at = total
    for j in range(shards - 1, 0, -1):  # what the shards before the j-th must place at least
        at = need[j] = sums[bisect_left(sums, max(at - capacity, 0))]
    cuts, near, at = [], set(), 0
    for j in range(1, shards):
        ideal = at + (total - at) / (shards - j + 1)
        i = bisect_right(sums, ideal) - 1
        near.add(i)
        best = min(sums[i : i + 2], key=lambda s: abs(s - ideal))
        at = max(need[j], min(best, _floor(sums, at + capacity)))
        cuts.append(at)
    return cuts, near


def minimax(buckets: list[Bucket], shards: int, split) -> tuple[int, list[int]]:
    """The smallest capacity, and the last key of each shard but the last. split(buckets): their parts."""
    while True:
        sums = [0]
        for b in buckets:
            sums.append(sums[-1] + b.size)
        total = sums[-1]
        least = max(-(-total // shards), max((b.size for b in buckets if b.atoms == 1), default=0))
        sure = _first(least, max(total, least), lambda c: bounds(buckets, sums, c, shards)[0][-1] >= total)
        maybe = _first(least, sure, lambda c: bounds(buckets, sums, c, shards)[1][-1] >= total)
        lows, highs = bounds(buckets, sums, maybe, shards)[0], bounds(buckets, sums, sure, shards)[1]
        wanted = {i for low, high in zip(lows, highs, strict=True) if low < high for i in range(bisect_right(sums, low) - 1, min(bisect_left(sums, high) + 1, len(buckets)))}
        if not (wanted := {i for i in wanted if buckets[i].atoms > 1}):
            ends, near = even(sums, sure, shards)
            if not (wanted := {i for i in near if i < len(buckets) and buckets[i].atoms > 1}):
                return sure, [buckets[i - 1].high if (i := bisect_left(sums, e)) else NULL_ID - 1 for e in ends]
        parts = split([buckets[i] for i in sorted(wanted)])
        buckets = sorted([b for i, b in enumerate(buckets) if i not in wanted] + parts, key=lambda b: b.low)


def _split(atoms: DataFrame):
    """A function that splits buckets: each key range into PARTS equal ones, in one pass."""
    spark = atoms.sparkSession

    def split(wanted: list[Bucket]) -> list[Bucket]:
        rows = F.broadcast(spark.createDataFrame([(n, b.root, b.low, b.high) for n, b in enumerate(wanted)], "n int, root long, low long, high long"))
        wide = lambda a, b: F.col(a).cast("decimal(20,0)") - F.col(b).cast("decimal(20,0)")
        part = F.floor(wide("key", "low") * PARTS / (wide("high", "low") + 1))
        got = (
            atoms.join(rows, "root").filter(F.col("key").between(F.col("low"), F.col("high")))
            .groupBy("n", "root", part.alias("part")).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("bytes").alias("s"), F.count("*").alias("c"))
        )
        return [Bucket(r.root, r.a, r.b, r.s, r.c) for r in got.collect()]

    return split


def _shard_of(key: Column, own: dict[int, int], ends: list[int]) -> Column:
    shard = F.lit(0)
    for end in ends:
        shard = shard + (key > F.lit(end)).cast("int") if end >= NULL_ID else shard + 1
    for k, s in own.items():
        shard = F.when(key == F.lit(k), F.lit(s)).otherwise(shard)
    return shard


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every document with its size, CRC, shard and slot."""
    spark = docs.sparkSession
    text = clean_text()
    rows = cut(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same")),
        "shard-rows",
    )
    groups = cut(rows.groupBy("same").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("key"), F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    root = range_bucket(groups, "key", BUCKETS)
    atoms = cut(groups.groupBy("key").agg(F.sum("bytes").alias("bytes")).withColumn("root", root), "shard-atoms")

    own: dict[int, int] = {}
    top = [(r["key"], r["bytes"]) for r in atoms.orderBy(F.desc("bytes"), "key").limit(shards).collect()]
    rest = atoms.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    for key, size in top:
        if len(own) < shards - 1 and size * (shards - len(own)) > rest:
            own[key] = shards - 1 - len(own)
            rest -= size
    light = atoms.filter(~F.col("key").isin(list(own))) if own else atoms
    first = [Bucket(r["root"], r["a"], r["b"], r["s"], r["c"]) for r in light.groupBy("root").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("bytes").alias("s"), F.count("*").alias("c")).collect()]
    _, ends = minimax(sorted(first, key=lambda b: b.low), shards - len(own), _split(light))

    total = rows.count()
    hot = groups.filter(F.col("n") > max(1, total * HOT_SHARE)).select("same", F.col("key").alias("hot_key"))  # at most 1 / HOT_SHARE rows
    flagged = rows.join(F.broadcast(hot), "same", "left")
    cold = flagged.filter(F.col("hot_key").isNull()).join(groups.select("same", "key"), "same")
    keyed = flagged.filter(F.col("hot_key").isNotNull()).withColumn("key", F.col("hot_key")).unionByName(cold, allowMissingColumns=True)
    placed = cut(
        keyed.select("doc_id", "size", "text_crc32", _shard_of(F.col("key"), own, ends).alias("shard"), F.pmod(F.xxhash64("doc_id", "same"), F.lit(SALTS)).cast("int").alias("salt")),
        "shard-placed",
    )
    base, seen = [], {}
    for r in sorted(placed.groupBy("shard", "salt").count().collect()):  # at most shards * SALTS rows
        base.append((r["shard"], r["salt"], seen.get(r["shard"], 0)))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["count"]
    bases = F.broadcast(spark.createDataFrame(base, "shard int, salt int, base long"))
    order = Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32")
    return placed.withColumn("n", F.row_number().over(order)).join(bases, ["shard", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
