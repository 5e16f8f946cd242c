"""Dictionary joins, prefix-tree searches, one-to-one matching and edit distances against brute force."""

import random
import time
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import dictionary, review, scoring, setmatch


def letters(r, n, alphabet="abcé .-_☃"):
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("words", [True, False])
def test_dictionary_equals_a_cross_join(spark, words):
    r = random.Random(7 + words)
    texts = [(i, letters(r, r.randrange(60)).upper() if i % 3 == 0 else letters(r, r.randrange(60))) for i in range(80)] + [(98, None), (99, "")]
    patterns = list({letters(r, r.randrange(1, 5)) for _ in range(120)}) + ["a", "", None, "a.b", r"\Ea", "a"]
    got = {tuple(x) for x in dictionary.dictionary_join(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), "k", words=words).collect()}
    want = set()
    for k, t in texts:
        for p in set(patterns) - {"", None}:
            if words and not re.search(r"[^\W]", p):
                continue  # no word to meet it by
            m = re.search(rf"(?<!\w){re.escape(p)}(?!\w)" if words else re.escape(p), t or "", re.IGNORECASE)
            if m:
                want.add((k, p, m.start() + 1))
    assert got == want and len(got) > 50


def test_many_patterns_take_one_plan(spark):
    patterns = spark.range(10_000).select(F.concat(F.lit("w"), F.col("id")).alias("pattern"))
    texts = spark.range(500).select("id", F.concat_ws(" ", F.lit("so"), F.concat(F.lit("w"), F.col("id") * 37), F.lit("w9x W11.")).alias("text"))
    got = dictionary.dictionary_join(texts, patterns, "id")
    assert "Nested" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 500 + sum(i * 37 < 10_000 and i * 37 != 11 for i in range(500))


def test_first_scaffold(spark):
    urls = spark.createDataFrame([(1, "www.act.gov"), (2, "act.gov.uk"), (3, "x.org"), (4, None)], "k int, netloc string")
    known = spark.createDataFrame([("act.gov", 2), ("gov.uk", 1), ("w", 3)], "pattern string, priority int")
    assert {r.k: r.scaffold for r in dictionary.first_scaffold(urls, known, "k").collect()} == {1: "act.gov", 2: "gov.uk", 3: None, 4: None}


def visited_by_hand(sets, order, query, predicate):
    key = lambda t: (order.get(t, len(order)), t)
    root = {}
    for s in sets:
        node = root
        for t in sorted(s, key=key):
            node = node.setdefault(t, {})

    def subsets(node):
        return 1 + sum(subsets(c) for t, c in node.items() if t in query)

    needed = sorted(query, key=key)

    def supersets(node, i):
        if i == len(needed):
            return 1
        return 1 + sum(supersets(c, i + (t == needed[i])) for t, c in node.items() if key(t) <= key(needed[i]))

    return subsets(root) if predicate == "subset" else supersets(root, 0)


@pytest.mark.parametrize(("seed", "predicate"), [(1, "subset"), (2, "superset")])
def test_visits_equal_a_walk(spark, seed, predicate):
    r = random.Random(seed)
    tags = [f"t{i}" for i in range(12)]
    sets = [r.sample(tags, r.randrange(6)) for _ in range(100)]
    asked = [r.sample([*tags, "unknown", "other"], r.randrange(5)) for _ in range(40)]
    count = {t: sum(t in s for s in sets) for t in tags}
    order = {t: i for i, t in enumerate(sorted((t for t in tags if count[t]), key=lambda t: (count[t], t)))}
    stored = spark.createDataFrame([(str(i), s) for i, s in enumerate(sets)], "node_id string, tags array<string>")
    queries = spark.createDataFrame([(str(i), s) for i, s in enumerate(asked)], "doc_id string, tags array<string>")
    got = {x.doc_id: x.visited for x in setmatch.visits(stored, queries, predicate).collect()}
    assert got == {str(i): visited_by_hand(sets, order, set(q), predicate) for i, q in enumerate(asked)}


def test_visits_of_nothing(spark):
    none = spark.createDataFrame([], "node_id string, tags array<string>")
    asked = spark.createDataFrame([("a", ["x"]), ("b", None)], "doc_id string, tags array<string>")
    assert {r.doc_id: r.visited for r in setmatch.visits(none, asked).collect()} == {"a": 1, "b": 1}


def in_turn(pairs):
    done, gone, out = set(), set(), set()
    for p, g in sorted(set(pairs)):
        if p not in done and g not in gone:
            done.add(p)
            gone.add(g)
            out.add((p, g))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rounds_of_matching_equal_turns(spark, seed):
    """Random pairs, blocks of like golds, and a chain in which each match decides the next."""
    r = random.Random(seed)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(150)] if seed < 2 else [(i, g) for i in range(30) for g in ((i, i + 1) if i % 2 else (i + 1, i))]
    blocks = [(100 + p, 100 + g) for p in range(30) for g in range(20)]
    classes = [(100 + g, 7) for g in range(20)]
    rows = spark.createDataFrame([(p, g, 6 + (p >= 100)) for p, g in [*pairs, *blocks, *pairs[:5]]], "pred long, gold long, pillar_id int")
    of = spark.createDataFrame(classes, "gold long, class long")
    want = in_turn([*pairs, *blocks])
    for small in (0, 10_000):
        assert {(x.pred, x.gold) for x in scoring.greedy(rows, of, small).collect()} == want
    assert scoring.greedy(rows.limit(0)).count() == 0


def test_score_has_no_group_by_pillar(spark):
    """One pillar's items are matched by all tasks: equal to turns, with gold classes from the items."""
    acts = ["data act one", "data act two", "privacy law", ""]
    r = random.Random(5)
    side = lambda at: [(at + i, r.choice(["", "sg", "au"]), 6, "6.1", r.choice(acts), [f"http://x.org/{r.randrange(8)}"]) for i in range(60)]
    kind = "pos long, country string, pillar_id int, indicator_id string, act_name string, urls array<string>"
    p, g = spark.createDataFrame(side(0), kind), spark.createDataFrame(side(0), kind)
    pairs = scoring.candidate_pairs(p, g)
    want = in_turn([(x.pred, x.gold) for x in pairs.collect()])
    assert {(x.pred, x.gold) for x in scoring.greedy(pairs, scoring.gold_classes(g), 0).collect()} == want and len(want) > 20


def _matching_items(spark, seed):
    acts = ["data act one", "data act two", "privacy law", "privacy law two three four", ""]
    r = random.Random(seed)
    side = lambda at: [(at + i, r.choice(["", "sg", "au"]), 6 + i % 2, "6.1", r.choice(acts), [f"http://x.org/{r.randrange(12)}"] * r.randrange(3)) for i in range(50)]
    kind = "pos long, country string, pillar_id int, indicator_id string, act_name string, urls array<string>"
    return spark.createDataFrame(side(0), kind), spark.createDataFrame(side(0), kind)


@pytest.mark.parametrize("turn, window", [(100, 64), (7, 1)])
def test_matching_by_classes_in_short_turns(spark, turn, window):
    """No pair is made for it, and a task's share and its golds of a class are bounded; equal to taking turns."""
    p, g = _matching_items(spark, 9)
    acts = scoring.Acts(p, g)
    want = in_turn([(x.pred, x.gold) for x in acts.pairs().collect()])
    assert {(x.pred, x.gold) for x in scoring.greedy_by_class(acts, turn, window).collect()} == want and len(want) > 20


def test_classes_give_the_pairs_of_brute_force(spark, monkeypatch):
    """Items of one class are met once for all, not each with each, and expanded in small blocks."""
    monkeypatch.setattr(scoring, "MEMBERS", 3)
    p, g = _matching_items(spark, 4)
    toks = lambda x: set(x.act_name.split())
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    rows = [(x, y) for x in p.collect() for y in g.collect()]
    want = sorted((x.pos, y.pos, x.pillar_id) for x, y in rows if x.pillar_id == y.pillar_id and (not x.country or not y.country or x.country == y.country) and (set(x.urls) & set(y.urls) or alike(toks(x), toks(y)) >= 0.6))
    acts = scoring.Acts(p, g)
    assert sorted(map(tuple, acts.pairs().collect())) == want and acts.links.count() < len(want) / 2
    assert {r.pillar_id: (r.n_pairs, r.n_preds) for r in scoring.pair_counts(p, g).collect()} == {k: (sum(w[2] == k for w in want), len({w[0] for w in want if w[2] == k})) for k in (6, 7)}
    words = [x.act_name.split() for x in p.orderBy("pos").collect()]
    df = spark.createDataFrame([(i, "b", w) for i, w in enumerate(words)], "pos int, within string, toks array<string>")
    assert {(x.a, x.b) for x in scoring.similar_pairs(df).collect()} == {(i, j) for j in range(50) for i in range(j) if alike(set(words[i]), set(words[j])) >= 0.6}


def distance_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_bits_equal_the_table_on_random_pairs():
    r = random.Random(3)
    for _ in range(1000):
        a = letters(r, r.randrange(40), "ab☃𝄞")
        b = letters(r, r.randrange(40), "ab☃𝄞") if r.random() < 0.5 else "".join(c for c in a if r.random() < 0.9)
        assert T.edit_distance_bits(a, b) == distance_by_hand(a, b)
    assert T.edit_distance_bits("a" * 70, "b" * 130) == 130 and T.edit_distance_bits("", "") == 0


def test_long_texts_are_compared_whole(spark):
    a = letters(random.Random(4), 30_000, "abcdefgh")
    b = "☃" + a[:10_000] + "☃☃" + a[10_000:]  # as many edits as signs without a partner
    assert T.edit_distance_bits(a, b) == 3
    rows = spark.createDataFrame([(1, a, b), (2, "abc", "axc"), (3, None, ""), (4, "", "x"), (5, "a b", " a\n b ")], "k int, reference string, hypothesis string")
    assert {r.k: r.cer for r in review.error_rates(rows).collect()} == {1: 3 / 30_000, 2: 1 / 3, 3: 0.0, 4: 1.0, 5: 0.0}
    plan = review.cer_report(rows)._jdf.queryExecution().analyzed().toString()
    assert "substring" not in plan


def test_bounds_of_the_edit_distance_hold_and_meet():
    """A text with replaced and doubled signs is settled in linear time, without the whole table."""
    r = random.Random(8)
    for _ in range(300):
        a, b = ("".join(r.choices("abc.☃"[: r.randrange(1, 6)], k=r.randrange(1, 30))) for _ in "ab")
        lower, upper = T.edit_bounds(*(np.array([*map(ord, t)], np.uint32) for t in (a, b)))
        assert lower <= distance_by_hand(a, b) <= upper and T.edit_distance_bits(a, b) == distance_by_hand(a, b)
    a = " ".join("".join(r.choices("abcdefgh", k=r.randrange(1, 9))) + "." * (i % 9 == 0) for i in range(200_000))
    b = a.replace("e", "☃").replace(".", "..")
    began = time.time()
    assert T.edit_distance_bits(a, b) == a.count("e") + a.count(".") and time.time() - began < 15


def test_found_patterns_leave_a_worker_in_small_batches():
    import pyarrow as pa

    many = [f"word{i}" for i in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([" ".join(many)] * 49 + [None]), pa.array([many] * 50)], ["k", "t", "p"])
    got = list(dictionary._found(iter([batch]), True, ["k", "pattern", "start"]))
    assert max(b.num_rows for b in got) < dictionary.FOUND_ROWS + len(many) and sum(b.num_rows for b in got) == 49 * 900
    assert got[0].slice(1, 1).to_pylist() == [{"k": 0, "pattern": "word1", "start": 7}]


def test_pairs_are_passed_on_as_they_are_made(spark):
    """Before, one compiled loop held all pairs of two blocks, and the keys of the items were made for each use of them."""
    kind = "pos long, country string, pillar_id int, indicator_id string, act_name string, urls array<string>"
    side = lambda at: spark.range(at, at + 300).selectExpr("id AS pos", "'' AS country", "6 AS pillar_id", "'6.1' AS indicator_id", "'data act' AS act_name", "array('http://x.org/' || id) AS urls")
    pairs = scoring.candidate_pairs(side(0).to(spark.createDataFrame([], kind).schema), side(1000).to(spark.createDataFrame([], kind).schema))
    assert pairs.count() == pairs.distinct().count() == 300 * 300
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"Generate explode\(b\b.*\n.*Coalesce\b.*\n(?:.*Project.*\n)?.*Generate explode\(a\b", plan) and "data act" not in plan
