"""Operator 4: line dedup by an exact set-similarity join, with DataFrame functions alone.

A line's tokens are its distinct words (split at spaces, tabs and returns; case kept). Lines with a
Jaccard similarity of 0.8 or more match; a line that matches an earlier one, by doc_id and place in
the text, is removed, whether or not the earlier one is removed itself. Lines without words stay.

Lines that equal an earlier one are removed first, by a pre-aggregated count of their hashes, and
take no further part. A token's code is its rarity (the logarithm of the count of its hash bucket
over all texts; the driver holds these 2 ** BUCKETS_BITS counts and nothing else) above its hash;
a line's tokens are ordered by it, rarest first. Two matching lines share a token among the first
n - ceil(0.8 n) + 1 of each, and the shared one that comes first is among the first ninth of the
smaller. These prefix tokens are joined by token and size class (a set also asks in the next class
if sets that large may match), filtered by size, by place of the shared token and by parity
sketches, which bound how many tokens differ; what passes is verified on the whole sets.

A group of many similar lines would make pairs by the square of its size. So in a first round each
line meets only the earliest of its key; tokens frequent by their count are salted there. Lines that
match it are gone. Then lines that are left meet one another, in one self-join on one shuffle, and
last they meet lines that are gone, of the keys that both have. Two lines that are gone never meet.

Defined results: null text is the empty text, one line without words; repeated rows are ordered
among one another in an arbitrary but fixed way, so the lines of all but one go; null doc_ids come
last; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import bare, clean_text, cut, drop, range_bucket, shuffle_width

NEAR_TENTHS = 8
BUCKETS_BITS = 16
#: Tokens from which a set has a second sketch.
WIDE = 64
#: Rows that are sent to all executors at most, of a long or a short list of places each.
BROADCAST_ROWS = 1_000_000
#: A key of the first round is dealt into parts of about 2 ** PART_BITS of its token's count; copies of a line are counted in COPY_SALTS parts.
PART_BITS, COPY_SALTS = 15, 8
_LOW = 55  # bits of a token's code below its rarity, which is twice the logarithm of a count
_BLANK = " \t\r\f"


def _least(n: Column) -> Column:
    """ceil(0.8 n)"""
    return F.floor((n * NEAR_TENTHS + 9) / 10).cast("int")


def _class(n: Column) -> Column:
    """A size class spans a ratio of 2, so sets that match are in the same class or neighbours."""
    return F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")


def _n_lines(text: str) -> Column:
    return F.size(F.split(text, "\n"))


def _blank(line: str) -> Column:
    """Whether a line has no words; only its first other character is looked for."""
    return F.ltrim(line, F.lit(_BLANK)) == ""


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs, null texts empty, with a unique number __n that follows doc_id, and the bits that a line's place needs.

    Unique doc_ids of a range that leaves room are numbers themselves; else rows are ranked, dealt
    into ordered ranges, and the texts joined to their ranks.
    """
    rows = docs.withColumns({"__null": F.col("text").isNull(), "text": clean_text()})
    s = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.max(_n_lines("text")).alias("lines")).first()
    bits = int(s["lines"] or 1).bit_length()
    unique = s["n"] == s["ids"] and not rows.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if unique and (not s["n"] or s["b"] - s["a"] < 1 << (62 - bits)):
        return rows.withColumn("__n", F.col("doc_id") - (s["a"] or 0)), bits
    kept = cut(rows.withColumn("__row", F.monotonically_increasing_id()), "line-rows")
    ids = kept.select("doc_id", "__row").withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(range_bucket(kept, "doc_id", 8 * shuffle_width(docs.sparkSession))))
    ids = ids.withColumn("range", F.when(F.col("range") < 0, F.lit(1 << 40)).otherwise(F.col("range")))
    base, at = [], 0
    for r in sorted(ids.groupBy("range").count().collect()):  # a row for each range
        base.append((r["range"], at))
        at += r["count"]
    ranked = ids.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("doc_id", "__row"))).join(F.broadcast(docs.sparkSession.createDataFrame(base, "range long, base long")), "range")
    return cut(kept.join(ranked.select("__row", (F.col("base") + F.col("k") - 1).alias("__n")), "__row").drop("__row"), "line-rows"), bits


def line_words(line: Column) -> Column:
    """A line's words, with an empty one wherever two blanks meet."""
    other = line.contains("\t") | line.contains("\r") | line.contains("\f")  # no pattern, as most lines have none
    plain = F.when(other, F.regexp_replace(line, "[\t\r\f]", " ")).otherwise(line)
    return F.split(plain, " ")


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKETS_BITS)


def rarity(rows: DataFrame) -> Column:
    """For each hash bucket twice the logarithm of how many words of all texts fall into it, as one constant array."""
    lines = rows.select(F.explode_outer(F.split("text", "\n")).alias("line"))
    counts = lines.select(F.explode_outer(F.split("line", " ")).alias("w")).groupBy(_bucket(F.xxhash64("w")).alias("b")).count()
    by = {r["b"]: r["r"] for r in counts.select("b", F.floor(F.log2(F.col("count")) * 2).alias("r")).collect()}  # at most 2 ** BUCKETS_BITS rows
    return F.split(F.lit(",".join(str(by.get(b, 0)) for b in range(1 << BUCKETS_BITS))), ",").cast("array<long>")


def _sent(small: DataFrame, rows: int) -> DataFrame:
    """small, sent to all executors if its rows are few enough."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def _places(ords: DataFrame, bits: int) -> DataFrame:
    """(__n, places): a document's places of ords in order; as many as it has lines at most."""
    place = F.col("ord").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    found = ords.groupBy(F.shiftright("ord", bits).alias("__n")).agg(F.sort_array(F.collect_list(place)).alias("places"))
    return _sent(found, ords.count())


def _marked(places: Column) -> Column:
    """A function of a place that says whether it is in places; looking up and building take time in proportion to the text."""
    runs = F.transform(places, lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get(places, i - 1), F.lit(-1)) - 1), F.lit("1")))
    return F.coalesce(F.array_join(runs, ""), F.lit("")).cast("binary")


def _is_marked(marks: Column, i: Column) -> Column:
    return F.substring(marks, i + 1, F.lit(1)) == F.lit(bytearray(b"1"))


def _lines(rows: DataFrame, bits: int, ords: DataFrame | None = None, wanted: bool = True) -> DataFrame:
    """Lines with words as (ord, line), ord the place in the corpus: all, those of ords, or those not of ords."""
    lines = F.split("text", "\n")
    if ords is not None:
        marked = rows.join(_places(ords, bits), "__n", "inner" if wanted else "left").withColumn("marks", _marked(F.col("places")))
        lines, rows = F.transform(lines, lambda x, i: F.when(_is_marked(F.col("marks"), i) == F.lit(wanted), x)), marked
    # The outer form spares a filter that would split the texts once more.
    each = rows.select("__n", F.posexplode_outer(lines).alias("pos", "line"))
    return each.filter(~_blank("line")).select((F.shiftleft(F.col("__n"), bits) + F.col("pos")).alias("ord"), "line")


def _copies(rows: DataFrame, bits: int) -> DataFrame:
    """The lines (ord) that equal an earlier one."""
    hashed = cut(_lines(rows, bits).select("ord", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")), "line-hashes")
    firsts = hashed.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1")
    dealt = firsts.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).alias("salt"))
    found = cut(hashed.withColumn("salt", F.pmod("ord", F.lit(COPY_SALTS)).cast("int")).join(dealt, ["h1", "h2", "salt"]).filter("ord > first").select("ord"), "line-copies")
    drop(hashed)
    return found


def _codes(line: Column, ranks: Column) -> Column:
    """A line's distinct tokens' codes, rarest first."""
    # A function of an array's elements is interpreted, with all that it is applied to. So words are hashed once, and what is not such a function comes last: it is compiled and works on plain numbers.
    hashes = F.transform(line_words(line), lambda w: F.xxhash64(w))
    # Without coalesce the array might hold nulls by its type, and would be sorted as objects.
    rank = lambda h: F.coalesce(F.get(ranks, _bucket(h)), F.lit(0).cast("long"))
    code = lambda h: F.shiftleft(rank(h), _LOW).bitwiseOR(h.bitwiseAND(F.lit((1 << _LOW) - 1)))
    return F.sort_array(F.array_distinct(F.array_remove(F.transform(hashes, code), code(F.xxhash64(F.lit(""))))))


def _token_sets(lines: DataFrame, ranks: Column) -> DataFrame:
    """(ord, n, s, s2, prefix) of lines (ord, line): the number of tokens, sketches and the prefix. s has 64 bits, each the parity of the tokens that hash to it; s2 has those of half of the tokens, and 0 in small sets."""
    n, bit = F.size("codes"), lambda c: F.hash(c)
    parity = lambda of: F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(F.call_function("shiftleft", of(c), bit(c))))
    half = parity(lambda c: c.bitwiseAND(F.lit(1)))
    sketches = parity(lambda c: F.lit(1).cast("long")).alias("s"), F.when(n >= WIDE, half).otherwise(0).alias("s2")
    return lines.select("ord", _codes(F.col("line"), ranks).alias("codes")).select("ord", n.alias("n"), *sketches, F.slice("codes", 1, n - _least(n) + 1).alias("prefix"))


def _n(x: Column) -> Column:
    return F.shiftright(x, 32)


def _i(x: Column) -> Column:
    return F.shiftright(x.bitwiseAND(F.lit((1 << 32) - 1)), 1)


def _asks(x: Column) -> Column:
    """1 for a row that only asks in the next class, 0 for one that is also met."""
    return x.bitwiseAND(F.lit(1))


def _ahead(n: Column, i: Column) -> Column:
    """Of two matching sets the smaller has its first shared token among its first ninth."""
    return i * (10 + NEAR_TENTHS) <= n * (10 - NEAR_TENTHS)


def _tokens(sets: DataFrame) -> DataFrame:
    """A row for each prefix token of each set: (ord, token, n, i, s, s2), i the token's place."""
    return sets.select("ord", "n", "s", "s2", F.posexplode_outer("prefix").alias("i", "token"))


def _x(n: Column, i: Column, asks: Column) -> Column:
    """A set's size, the token's place and whether the row only asks, in one number."""
    return F.shiftleft(n.cast("long"), 32) + i * 2 + asks


def _keyed(sets: DataFrame) -> DataFrame:
    """(key, ord, x, s, s2): each prefix token under its size class, and under the next one if it may be the first shared one with a set of that size."""
    n, i = F.col("n"), F.col("i")
    own, most = _class(n), _class(F.floor((n * 10 - i * (10 + NEAR_TENTHS)) / NEAR_TENTHS))
    key = lambda c: F.xxhash64("token", c)
    keys = F.posexplode_outer(F.when(_ahead(n, i) & (most > own), F.array(key(own), key(own + 1))).otherwise(F.array(key(own))))
    return _tokens(sets).select("ord", "n", "i", "s", "s2", keys.alias("asks", "key")).select("key", "ord", _x(n, i, F.col("asks")).alias("x"), "s", "s2")


def _fits(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether the sets of two rows, of n and m tokens, the first shared ones of which are the i-th and the j-th, may match: by size, by place (nothing before these is shared), and by their sketches, which bound how many tokens differ."""
    n, i, m, j = _n(a("x")), _i(a("x")), _n(b("x")), _i(b("x"))
    size = (n * 10 >= m * NEAR_TENTHS) & (m * 10 >= n * NEAR_TENTHS)
    place = F.least(n - i, m - j) * (10 + NEAR_TENTHS) >= (n + m) * NEAR_TENTHS
    whole, half = a("s").bitwiseXOR(b("s")), a("s2").bitwiseXOR(b("s2"))
    differ = F.when((n >= WIDE) & (m >= WIDE), F.bit_count(whole.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(whole))
    return size & place & (differ * (10 + NEAR_TENTHS) <= (n + m) * (10 - NEAR_TENTHS))


def _side(keyed: DataFrame, name: str) -> DataFrame:
    return keyed.select(*[F.col(c).alias(f"{c}_{name}") for c in ("key", "ord", "x", "s", "s2")])


def _may_match(small: str, large: str) -> Column:
    """Whether a row of the smaller set and one of the larger may show a match. What concerns one side alone is kept in an expression of both, so that it stays in the join and both sides can read one shuffle."""
    a, b = (lambda c: F.col(f"{c}_{small}")), (lambda c: F.col(f"{c}_{large}"))
    n, m = _n(a("x")), _n(b("x"))
    order = (n < m) | ((n == m) & (a("ord") < b("ord")))
    roles = _asks(b("x")) + F.when(_ahead(n, _i(a("x"))), 0).otherwise(1) == 0
    return order & roles & _fits(a, b)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.greatest("ord_a", "ord_b").alias("a"), F.least("ord_a", "ord_b").alias("b")).distinct()


def _verified(pairs: DataFrame, rows: DataFrame, ranks: Column, bits: int) -> DataFrame:
    """The later lines (ord) of pairs (a, b) whose whole token sets match; the sets are made from the texts again."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("ord")).distinct(), "line-wanted")
    lines = _lines(rows, bits, wanted)
    sets = cut(lines.select("ord", _codes(F.col("line"), ranks).alias("codes")), "line-codes")
    both = pairs.join(sets.select(F.col("ord").alias("a"), F.col("codes").alias("x")), "a").join(sets.select(F.col("ord").alias("b"), F.col("codes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    found = cut(both.filter(shared * (10 + NEAR_TENTHS) >= (F.size("x") + F.size("y")) * NEAR_TENTHS).select(F.col("a").alias("ord")).distinct(), "line-gone")
    drop(wanted, sets)
    return found


def _led(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and the earliest of its key: token, size class and, of frequent tokens, part."""
    n, i, token = F.col("n"), F.col("i"), F.col("token")
    parts = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.least(F.lit(20), F.floor(F.shiftright(token, _LOW) / 2).cast("int") - PART_BITS)))
    keyed = _tokens(sets).filter(_ahead(n, i)).select(F.xxhash64("token", _class(n), F.pmod("ord", parts)).alias("key"), "ord", _x(n, i, F.lit(0)).alias("x"), "s", "s2")
    # A window without an order sorts by the key alone, a number, so by radix.
    led = keyed.withColumn("lead", F.min_by(F.struct("ord", "x", "s", "s2"), "ord").over(Window.partitionBy("key"))).filter("lead.ord < ord")
    fits = _fits(F.col, lambda c: F.col(f"lead.{c}"))
    return led.filter(fits).select(F.col("ord").alias("a"), F.col("lead.ord").alias("b")).distinct()


def _without(sets: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets that are not gone, and the table that holds them: sets itself where gone is sent to all executors, else one that is written, and sets is deleted."""
    n = gone.count()
    left = sets.join(_sent(gone, n), "ord", "left_anti")
    if n <= BROADCAST_ROWS:
        return left, sets
    left = cut(left, "line-left")
    drop(sets)
    return left, left


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The numbered documents, the lines (ord) to remove, and the bits of a line's place."""
    numbers, bits = numbered(docs)
    rows = numbers.select("__n", "text")
    ranks = rarity(rows)
    copies = _copies(rows, bits)
    sets = cut(_token_sets(_lines(rows, bits, copies, wanted=False), ranks), "line-sets")

    led = cut(_led(sets), "line-led")
    gone = _verified(led, rows, ranks, bits)
    lost = cut(sets.join(_sent(gone, gone.count()), "ord", "left_semi"), "line-lost")
    left, held = _without(sets, gone)

    keyed = _keyed(left)
    among = cut(_pairs(_side(keyed, "a").join(_side(keyed, "b"), (F.col("key_a") == F.col("key_b")) & _may_match("a", "b"))), "line-among")
    old, keys = _keyed(lost), cut(_keyed(lost).select("key").distinct(), "line-keys")
    new = keyed.join(_sent(keys, keys.count()), "key", "left_semi")
    meets = (F.col("key_a") == F.col("key_b")) & (F.col("ord_a") > F.col("ord_b")) & (_may_match("a", "b") | _may_match("b", "a"))
    after = cut(_pairs(_side(new, "a").join(_side(old, "b"), meets)).join(led, ["a", "b"], "left_anti"), "line-after")
    drop(held, lost, keys, led)
    late = _verified(among.unionByName(after), rows, ranks, bits)
    removed = cut(copies.unionByName(gone).unionByName(late).distinct(), "line-removed")
    drop(copies, gone, late, among, after)
    return numbers, removed, bits


def removed_lines(docs: DataFrame) -> DataFrame:
    """Every document with its number of lines, of removed ones, and their places (from 0)."""
    rows, removed, bits = matches(docs.select("doc_id", "text"))
    got = rows.select("doc_id", "__n", _n_lines("text").cast("long").alias("n_lines")).join(_places(removed, bits), "__n", "left")
    places = F.coalesce("places", F.array().cast("array<int>"))
    return got.select("doc_id", "n_lines", F.size(places).cast("long").alias("n_removed"), places.alias("removed_lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with their own columns, their texts without the removed lines; n_chars, where it is a column, counts anew."""
    inner, restored = bare(docs, "doc_id", "text", "n_chars")
    rows, removed, bits = matches(inner)
    marked = rows.join(_places(removed, bits), "__n", "left").withColumn("marks", _marked(F.col("places")))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~_is_marked(F.col("marks"), i)), "\n")
    out = marked.withColumn("text", F.when(F.col("places").isNull(), F.when(~F.col("__null"), F.col("text"))).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return restored(out)
