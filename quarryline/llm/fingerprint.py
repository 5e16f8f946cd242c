"""Operator 1: document fingerprints by one-permutation MinHash, with DataFrame functions alone.

A text's shingles are runs of five words (all words, if there are fewer; none without words), split
at white space, case kept. Each shingle is hashed once to 64 bits; the top bits name its bin, and a
bin keeps its smallest hash. An empty bin is filled by optimal densification: it copies the first
bin with a hash in a random order of all bins that is its own, so texts agree on it as often as on
any bin. Of each bin the low-order BITS bits are stored; likeness corrects the share of equal bins
for chance agreement of the bits.

Defined results: null text is the empty text; a text without words has the empty fingerprint, whose
likeness is 1 to itself and 0 to any other; equal texts have equal fingerprints, repeated rows one
each; rows of equal doc_id follow one another by text; null doc_ids come last; the only document is
its own next one; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import clean_text, range_bucket, shuffle_width

WORDS, BINS, BITS = 5, 256, 8
#: Bins tried one by one for an empty bin, before the rest are ranked at once.
PROBES = 16
#: Ranges of doc_id in which the next document is found; the driver holds a bound for each.
MOST_RANGES = 16_384
_SHIFT = 64 - (BINS - 1).bit_length()
_LOW = (1 << _SHIFT) - 1


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


#: The greatest hash of each bin: put in beside the text's own, so that every bin has a hash; where it is the smallest, the bin is empty.
_EMPTY = [((i - BINS // 2 + 1) << _SHIFT) - 1 for i in range(BINS)]
_ORDER = [random.Random(i).sample(range(BINS), PROBES) for i in range(BINS)]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def word_hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, n: int = WORDS) -> Column:
    """Hashes of the runs of n words, from the words' hashes."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))
    return F.when(F.size(hashes) >= n, runs).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<long>"))


def _smallest(ordered: Column) -> Column:
    """The first of each bin, from sorted hashes that hold the greatest of every bin."""
    return F.filter(ordered, lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get(ordered, i - 1), _SHIFT)))


def _filled(bins: Column) -> Column:
    full = lambda h: h.bitwiseAND(F.lit(_LOW)) != _LOW
    tables = [_longs(row[t] for row in _ORDER) for t in range(PROBES)]

    def fill(h: Column, i: Column) -> Column:
        tried = [F.get(bins, F.get(t, i).cast("int")) for t in tables]
        ranked = F.array_min(F.transform(bins, lambda x, j: F.when(full(x), F.struct(F.xxhash64(i, j).alias("r"), x.alias("x")))))["x"]
        return F.when(full(h), h).otherwise(F.coalesce(*[F.when(full(x), x) for x in tried], ranked)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("short")

    return F.transform(bins, fill)


def signatures(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with, for each text column in names, its bins' low-order bits; null without words. The text columns go."""
    stage = df.withColumns({out: word_hashes(words(F.col(text))) for text, out in names.items()}).drop(*names)
    outs = list(names.values())
    stage = stage.withColumns({o: F.when(F.size(o) > 0, F.sort_array(F.concat(shingle_hashes(F.col(o)), _longs(_EMPTY)))) for o in outs})
    stage = stage.withColumns({o: _smallest(F.col(o)) for o in outs})
    return stage.withColumns({o: _filled(F.col(o)) for o in outs})


def packed(signature: Column) -> Column:
    digits = F.array(*[F.lit(f"{i:02x}") for i in range(1 << BITS)])
    return F.coalesce(F.array_join(F.transform(signature, lambda v: F.get(digits, v.cast("int"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity that two signatures estimate, with chance agreement taken off."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / BINS
    chance = 2.0**-BITS
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint and that of its edited text, with their likeness and that to the next document, by descending doc_id.

    The table is dealt into ordered ranges of doc_id. Each range also gets the head of the next one,
    so the next document is always the next row of the same range.
    """
    spark = docs.sparkSession
    ranges = max(64, min(8 * shuffle_width(spark), MOST_RANGES))
    rows = docs.select("doc_id", clean_text().alias("text"))
    rows = rows.withColumn("range", range_bucket(rows, "doc_id", ranges)).withColumn("ghost", F.lit(False))
    heads = sorted(tuple(r) for r in rows.groupBy("range").agg(F.max("doc_id")).collect())  # a row for each range
    after = [(*heads[n - 1], b) for n, (b, _) in enumerate(heads)]
    ghosts = rows.join(F.broadcast(spark.createDataFrame(after, "of long, head long, `to` long")), (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")))
    ghosts = ghosts.select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("ghost"))
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce(F.lead("text").over(order), F.lit("")), F.lit(1), half))
    pairs = rows.unionByName(ghosts).withColumn("edited", edited).withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)})
    signed = signatures(pairs.withColumn("order_text", F.col("text")), {"text": "own", "edited": "other"})
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("order_text").desc())
    return signed.withColumn("next", F.lead("own").over(order)).filter(~F.col("ghost")).select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
