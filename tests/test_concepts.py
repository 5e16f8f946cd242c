"""The concept graph against brute force and dense linear algebra."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import concepts


@pytest.mark.parametrize(("seed", "theta"), [(1, 0.3), (2, 0.7)])
def test_pairs_equal_brute_force(spark, seed, theta):
    r = random.Random(seed)
    tags = [f"t{i}" for i in range(15)]
    nodes = {f"n{i:02}": set(r.choices(tags, [1 / (j + 1) for j in range(15)], k=r.randrange(7))) for i in range(60)}
    n, count = len(nodes), {t: sum(t in s for s in nodes.values()) for t in tags}
    w = {t: math.log1p(n / c) for t, c in count.items() if c}
    near = lambda a, b: sum(w[t] for t in a & b) / sum(w[t] for t in a | b) if a | b else 0.0
    want = {(a, b): near(nodes[a], nodes[b]) for a in nodes for b in nodes if a < b and near(nodes[a], nodes[b]) >= theta - 1e-9}
    rows = [(k, [*v, *list(v)[:1]]) for k, v in nodes.items()] + [("none", None)]
    # A node without tags counts among all nodes.
    df = spark.createDataFrame(rows[:-1], "node string, tags array<string>")
    got = {(x.a, x.b): x.weight for x in concepts.near_pairs(df, theta).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got) and len(got) > 5
    top = {a: [b for _, b in sorted((-round(v, 9), b) for b, v in [*((q, v) for (p, q), v in got.items() if p == a), *((p, v) for (p, q), v in got.items() if q == a)])][:2] for a in nodes}
    pairs = spark.createDataFrame([(a, b, round(v, 9)) for (a, b), v in got.items()], "a string, b string, weight double")
    assert {(x.a, x.b) for x in concepts.mutual(pairs, 2).collect()} == {(a, b) for a, b in got if b in top[a] and a in top[b]}


def test_mutual_pairs_equal_all_pairs_with_copies(spark, monkeypatch):
    """The nearest of blocks give the graph of all pairs, and copies are not expanded to find it."""
    r = random.Random(5)
    rows = [(i, r.choices("abcdefghijkl", k=5)) for i in range(80)] + [(i, ["a", "b", "x"]) for i in range(80, 140)]
    df = spark.createDataFrame(rows, "node long, tags array<string>")
    want = {(x.a, x.b) for x in concepts.mutual(concepts.near_pairs(df, 0.2).withColumn("weight", F.round("weight", 9)), 3).collect()}
    assert {(x.a, x.b) for x in concepts.mutual_pairs(df, 0.2, 3).collect()} == want and len(want) > 20
    # Before, every pair that shares a first tag was shuffled, and each of its common tags once more.
    assert concepts._met(df, 0.2, 3).filter("x >= 80 and y >= 80").count() < 60 * 59 / 2
    monkeypatch.setattr(concepts, "BLOCK", 9)
    assert {(x.a, x.b) for x in concepts.mutual_pairs(df, 0.2, 3).collect()} == want


def test_no_tags_no_pairs(spark):
    assert concepts.near_pairs(spark.createDataFrame([("a", None), ("b", [])], "node string, tags array<string>")).count() == 0


def test_rank_equals_linear_algebra(spark):
    r = random.Random(3)
    n = 12
    pairs = [(a, b, r.random()) for a in range(n - 2) for b in range(a + 1, n - 2) if r.random() < 0.3] + [(0, 0, 9.0), (0, 99, 9.0)]
    m = np.zeros((n, n))
    for a, b, v in pairs[:-2]:
        m[a, b] = m[b, a] = v
    m = np.where(m.sum(0) > 0, m / np.where(m.sum(0) > 0, m.sum(0), 1), 1 / n)
    want = np.linalg.solve(np.eye(n) - 0.85 * m, np.full(n, 0.15 / n))
    got = {x.node: x.rank for x in concepts.pagerank(spark.createDataFrame([(i,) for i in range(n)], "node int"), spark.createDataFrame(pairs, "a int, b int, weight double"), tolerance=1e-8, rounds=80).collect()}
    assert max(abs(got[i] - want[i]) for i in range(n)) < 1e-8 and abs(sum(got.values()) - 1) < 1e-9
    assert concepts.pagerank(spark.createDataFrame([], "node int"), spark.createDataFrame([], "a int, b int, weight double")).count() == 0


@pytest.mark.parametrize(("often", "strip"), [(0, 7), (3, 4), (512, 64)])
def test_nearest_of_copies_by_classes(spark, monkeypatch, often, strip):
    """Of equal nodes only those are paired that can be mutual; often and rare tags, and strips, give the graph of all pairs."""
    r = random.Random(9)
    rows = [(i, r.choices("abcdefghijkl", [1 / (j + 1) for j in range(12)], k=4)) for i in range(100)] + [(i, ["x", "b", "a", "b"]) for i in range(100, 160)] + [(160, ["alone"]), (161, [None]), (162, None), (None, ["a"])]
    df = spark.createDataFrame(rows, "node long, tags array<string>")
    want = {(x.a, x.b) for x in concepts.mutual(concepts.near_pairs(df, 0.1).withColumn("weight", F.round("weight", 9)), 3).collect()}
    monkeypatch.setattr(concepts, "OFTEN", often)
    monkeypatch.setattr(concepts, "STRIP", strip)
    assert {(x.a, x.b) for x in concepts.mutual_pairs(df, 0.1, 3).collect()} == want and (100, 101) in want
    # Before, every copy came with its nearest in each block.
    assert concepts._met(df, 0.1, 3).filter("x >= 100 and y >= 100").count() == 4 * 3


def test_rank_takes_few_rounds(spark, monkeypatch):
    """A ring with a tail, whose ranks settle slowly: before, it took more than 100 rounds."""
    n, put, seen = 11, concepts.Rounds.put, []
    monkeypatch.setattr(concepts.Rounds, "put", lambda self, rows: seen.append(self.n) or put(self, rows))
    pairs = [(i, i + 1, 1.0 + i % 3) for i in range(8)] + [(0, 6, 5.0)]
    m = np.full((n, n), 1 / n)
    for i in range(9):
        m[:, i] = 0
    for a, b, v in pairs:
        m[a, b] = m[b, a] = v
    m[:, :9] /= m[:, :9].sum(0)
    want = np.linalg.solve(np.eye(n) - 0.85 * m, np.full(n, 0.15 / n))
    got = {x.node: x.rank for x in concepts.pagerank(spark.createDataFrame([(i,) for i in range(n)], "node int"), spark.createDataFrame(pairs, "a int, b int, weight double")).collect()}
    assert max(abs(got[i] - want[i]) for i in range(n)) < 1e-10 and max(seen) < 60
