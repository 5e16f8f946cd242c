"""Joins of texts with a table of literal patterns, of any number.

A pattern is met through its rarest key alone: of the words of a word pattern, of the three-letter
runs of a substring pattern, the one that the fewest texts hold. Texts give their distinct keys, so
that only texts with a pattern's rarest key are candidates. Only keys travel in the join; a text is
moved once, and all its candidates are verified on the whole of it in one Arrow row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarryline.functions.text import _W, blank

GRAM = 3
#: The most keys and characters of a pattern table that is sent to all tasks.
MOST_ROWS, MOST_CHARS = 200_000, 8_000_000
#: Found patterns that leave a worker at once.
FOUND_ROWS = 10_000


def keys_of(text: Column, words: bool, lengths: tuple[int, ...] = (GRAM,)) -> Column:
    """The distinct keys of a lower-case text: its words, or its runs of the lengths given."""
    if words:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{_W}+"), 0))

    def runs(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs, lengths)))


def _starts(text: str | None, patterns: list[str], words: bool) -> list[dict]:
    """The patterns that a text holds in any case, with their first places (from 1). As a word, nothing of a word may touch one."""
    text = text or ""
    low, out = text.lower(), []
    same = len(low) == len(text)  # else places would move
    letter = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
    for p in patterns:
        if same:
            q = p.lower()
            at = low.find(q)
            while words and at >= 0 and (letter(at - 1) or letter(at + len(q))):
                at = low.find(q, at + 1)
        else:
            m = re.search(rf"(?<!\w){re.escape(p)}(?!\w)" if words else re.escape(p), text, re.IGNORECASE)
            at = m.start() if m else -1
        if at >= 0:
            out.append({"pattern": p, "start": at + 1})
    return out


def _found(batches: Iterator[pa.RecordBatch], words: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each pattern that a text holds. Texts are taken from a batch one by one, and what is found leaves in small batches, so a worker holds few objects however many patterns texts hold."""
    for b in batches:
        of, found, starts = [], [], []
        for i in range(b.num_rows):
            for f in _starts(b.column(1)[i].as_py(), b.column(2)[i].as_py(), words):
                of.append(i)
                found.append(f["pattern"])
                starts.append(f["start"])
            if len(of) >= FOUND_ROWS or (of and i == b.num_rows - 1):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(found, pa.string()), pa.array(starts, pa.int64())], names)
                of, found, starts = [], [], []


def dictionary_join(texts: DataFrame, patterns: DataFrame, key: str, text: str = "text", words: bool = True) -> DataFrame:
    """(key, pattern, start) of the patterns that texts hold, each at its first place. texts: (key, text, ..), key telling rows apart; patterns: (pattern).

    Case doesn't count. Null and empty patterns are none, repeated ones count once, null texts hold
    none; a word pattern without any letter or digit has no key among words and is none.
    """
    wanted = patterns.filter(blank(F.col("pattern")) != "").select("pattern").distinct()
    low = F.lower(blank(F.col(text)))
    if words:
        lengths = (GRAM,)
        owned = wanted.withColumn("__k", F.explode(keys_of(F.lower("pattern"), True)))
    else:
        size = F.least(F.length("pattern"), F.lit(GRAM))
        lengths = tuple(sorted(r[0] for r in wanted.select(size).distinct().collect())) or (GRAM,)  # three numbers at most
        of = [F.when(size == n, keys_of(F.lower("pattern"), False, (n,))) for n in lengths]
        owned = wanted.withColumn("__k", F.explode(F.coalesce(*of)))
    held = texts.select(key, F.explode(keys_of(low, words, lengths)).alias("__k"))
    # Texts' keys are far more than patterns' keys: a pattern table of checked size goes to them, a larger one meets them in a shuffle.
    size = owned.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("pattern") + F.length("__k")), F.lit(0)).alias("chars")).first()
    near = F.broadcast if size["n"] <= MOST_ROWS and size["chars"] <= MOST_CHARS else lambda df: df
    # How many texts hold each key that some pattern has.
    count = held.join(near(owned.select("__k").distinct()), "__k", "left_semi").groupBy("__k").agg(F.count("*").alias("__n"))
    # A pattern with a key that no text holds is found nowhere.
    rarest = owned.join(count, "__k", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("__n"), "__k")).alias("r")).filter("r.__n > 0").select("pattern", F.col("r.__k").alias("__k"))
    candidates = held.join(near(rarest), "__k").groupBy(key).agg(F.collect_set("pattern").alias("__patterns"))
    # All candidates of a text are looked for at once, beside it; they are no more than what its own keys call for.
    met = texts.select(key, F.col(text).alias("__text")).join(candidates, key).select(key, "__text", "__patterns")
    kind = StructType([met.schema[key], StructField("pattern", StringType()), StructField("start", LongType())])
    return met.mapInArrow(lambda batches: _found(batches, words, kind.names), kind)


def first_scaffold(urls: DataFrame, scaffolds: DataFrame, key: str, netloc: str = "netloc") -> DataFrame:
    """(key, scaffold): of the scaffolds (pattern, priority) whose domain an address's host holds, the first by priority, then by name; null without one."""
    met = dictionary_join(urls, scaffolds, key, netloc, words=False).join(scaffolds.groupBy("pattern").agg(F.min("priority").alias("priority")), "pattern")
    best = met.groupBy(key).agg(F.min(F.struct("priority", "pattern"))["pattern"].alias("scaffold"))
    return urls.select(key).join(best, key, "left")
