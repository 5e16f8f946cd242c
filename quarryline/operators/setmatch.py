"""Set containment joins: which stored tag sets lie within a query's, and which contain it.

Stored sets are (node_id, tags), queries (doc_id, tags). A stored set within a query shares its
rarest tag with it, so the join is on that one tag; a stored set that contains a query holds the
query's rarest tag. Candidates are verified by array_except.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.sources.rounds import Rounds


def canonical(tags: str | Column = "tags") -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(F.col(tags) if isinstance(tags, str) else tags, F.array().cast("array<string>"))))


def rarity_rank(stored: DataFrame, first: list[str] | None = None) -> DataFrame:
    """(tag, freq, rank): tags named first in their order, the rest by frequency and name."""
    order = {t: i for i, t in reversed(list(enumerate(first or [])))}
    given = F.coalesce(*[F.when(F.col("tag") == t, F.lit(i)) for t, i in order.items()], F.lit(len(order))) if order else F.lit(0)
    freq = stored.select(F.explode(canonical()).alias("tag")).groupBy("tag").agg(F.count("*").alias("freq"))
    # The vocabulary of tags is ranked as a whole: it is a dictionary, not the data.
    return freq.withColumn("rank", F.row_number().over(Window.orderBy(given, F.when(given < len(order), 0).otherwise(F.col("freq")), "tag")).cast("long"))


def _counts(stored: DataFrame) -> DataFrame:
    """(tag, n): how many stored sets have each tag; their order is that of rarity_rank, and no tag needs its place among all."""
    return stored.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def _rarest(sets: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Each set's rarest tag, of equally rare ones the first by name; unknown tags are the rarest."""
    one = sets.select(key, F.explode("tags").alias("tag")).join(counts, "tag", "left")
    return one.groupBy(key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tag"))["tag"].alias("tag"))


def subsets(stored: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, node_id) where the stored set lies within the query's; an empty stored set lies within all."""
    s, q = stored.select("node_id", canonical().alias("tags")), queries.select("doc_id", canonical().alias("tags"))
    key = _rarest(s, "node_id", _counts(s))
    met = q.select("doc_id", F.col("tags").alias("have"), F.explode("tags").alias("tag")).join(s.join(key, "node_id"), "tag")
    got = met.filter(F.size(F.array_except("tags", "have")) == 0).select("doc_id", "node_id")
    empty = s.filter(F.size("tags") == 0).select("node_id").withColumn("k", F.lit(1))
    return got.unionByName(q.select("doc_id").withColumn("k", F.lit(1)).join(empty, "k").select("doc_id", "node_id"))


def supersets(stored: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, node_id) where the stored set contains the query's; an empty query lies within all."""
    s, q = stored.select("node_id", canonical().alias("tags")), queries.select("doc_id", canonical().alias("tags"))
    key = _rarest(q, "doc_id", _counts(s))
    met = s.select("node_id", F.col("tags").alias("have"), F.explode("tags").alias("tag")).join(q.join(key, "doc_id"), "tag")
    got = met.filter(F.size(F.array_except("tags", "have")) == 0).select("doc_id", "node_id")
    empty = q.filter(F.size("tags") == 0).select("doc_id").withColumn("k", F.lit(1))
    return got.unionByName(empty.join(s.select("node_id").withColumn("k", F.lit(1)), "k").select("doc_id", "node_id"))


def match_all(stored: DataFrame, queries: DataFrame, predicate: str = "subset") -> DataFrame:
    """(doc_id, nodes sorted) for each query; of queries with one doc_id the last by pos counts."""
    if predicate not in ("subset", "superset"):
        raise ValueError(f"unknown predicate: {predicate}")
    last = queries.groupBy("doc_id").agg(F.max_by("tags", "pos").alias("tags"))
    got = (subsets if predicate == "subset" else supersets)(stored, last)
    return last.select("doc_id").join(got.groupBy("doc_id").agg(F.array_sort(F.collect_list("node_id")).alias("nodes")), "doc_id", "left").select("doc_id", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))


def prefix_count(stored: DataFrame) -> DataFrame:
    """The nodes of a prefix tree of the sets by rarity: distinct ranked prefixes and the root."""
    ranks = rarity_rank(stored)
    one = stored.select("node_id", F.explode(canonical()).alias("tag")).join(ranks, "tag")
    paths = one.groupBy("node_id").agg(F.array_sort(F.collect_list("rank")).alias("path"))
    cut = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("prefix"))
    return cut.agg((F.count_distinct("prefix") + 1).cast("long").alias("n_nodes"))


def _paths(stored: DataFrame, ranks: DataFrame) -> DataFrame:
    """(path) of the distinct stored sets: their tags' ranks, rising."""
    one = stored.select("node_id", F.explode(canonical()).alias("tag")).join(ranks, "tag")
    return one.groupBy("node_id").agg(F.array_sort(F.collect_list("rank")).alias("path")).select("path").distinct()


def trie(stored: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, parent, rank) of the prefix tree of the sets by rarity, without its root, which is ''. A node is named by its path."""
    name = lambda n: F.array_join(F.transform(F.slice("path", 1, n), lambda r: r.cast("string")), ".")
    steps = _paths(stored, ranks).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(name(n).alias("node"), name(n - 1).alias("parent"), F.get("path", n - 1).alias("rank")))).alias("s"))
    return steps.select("s.*").distinct()


def visits(stored: DataFrame, queries: DataFrame, predicate: str = "subset", first: list[str] | None = None) -> DataFrame:
    """(doc_id, visited): how many nodes of the prefix tree a search for each query looks at, the root included.

    A search goes down level by level, all queries at once. For subsets it follows children whose tag
    the query has. For supersets it follows a child that is the next tag that the query needs, or of
    lower rank, never one beyond it, and ends where nothing is needed any more. A tag that no stored
    set has comes after all others. Each level is written; there are as many as tags in a set.
    """
    if predicate not in ("subset", "superset"):
        raise ValueError(f"unknown predicate: {predicate}")
    spark = stored.sparkSession
    ranks = Rounds(spark, "trie-ranks").put(rarity_rank(stored, first).select("tag", "rank"))
    nodes = Rounds(spark, "trie-nodes").put(trie(stored, ranks))
    asked = queries.select("doc_id", canonical().alias("tags")).groupBy("doc_id").agg(F.max("tags").alias("tags"))
    one = asked.select("doc_id", F.explode("tags").alias("tag")).join(ranks, "tag", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.coalesce("rank", F.lit((1 << 62) - 1)))).alias("needed"))
    asked = Rounds(spark, "trie-asked").put(asked.select("doc_id").join(one, "doc_id", "left").select("doc_id", F.coalesce("needed", F.array().cast("array<bigint>")).alias("needed")))
    levels = Rounds(spark, "trie-level")
    level = levels.put(asked.select("doc_id", F.lit("").alias("at"), F.lit(0).alias("met")))
    while not level.isEmpty():
        here = level.join(asked, "doc_id")
        if predicate == "subset":
            step = here.select("doc_id", "at", F.explode("needed").alias("rank")).join(nodes.withColumnRenamed("parent", "at"), ["at", "rank"]).select("doc_id", F.col("node").alias("at"), F.lit(0).alias("met"))
        else:
            next_rank = F.get("needed", F.col("met"))
            open_ = here.filter(F.col("met") < F.size("needed")).select("doc_id", "at", "met", next_rank.alias("next"))
            step = open_.join(nodes.withColumnRenamed("parent", "at"), "at").filter(F.col("rank") <= F.col("next")).select("doc_id", F.col("node").alias("at"), F.when(F.col("rank") == F.col("next"), F.col("met") + 1).otherwise(F.col("met")).alias("met"))
        level = levels.put(step)
    return levels.all().groupBy("doc_id").agg(F.count("*").alias("visited"))
