"""Near-duplicates and nearest neighbours against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import ann, dart


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(20):
        names = rng.choice(400, 150, replace=False).astype(np.uint64)
        names.sort()
        sets.append((dart.mix(names), rng.integers(1, 5, 150)))
    sets = [(e[np.argsort(e)], w[np.argsort(e)]) for e, w in sets]
    sig = dart.signatures(sets, 512)
    errors = [(sig[i] == sig[j]).mean() - dart.similarity(sets[i], sets[j]) for i in range(20) for j in range(i)]
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.1
    parts = [(sets[0][0], np.full(150, 0.5)), (sets[0][0], np.full(150, 1.0))]
    assert abs((np.equal(*dart.signatures(parts, 512))).mean() - 0.5) < 0.08


def brute_classes(texts):
    def shingles(t):
        w = (t or "").split()
        return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])

    s, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((s[i] & s[j]).values())
            if (texts[i] or "") == (texts[j] or "") or both and both / sum((s[i] | s[j]).values()) >= dart.NEAR:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


@pytest.fixture(scope="module")
def cluster():
    """A large group of near copies with edits of any size, and chains, among unlike texts."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for k in range(120):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    chain = [rng.choice(words) for _ in range(100)]
    for k in range(8):
        texts.append(" ".join(chain))
        chain = chain[5:] + [rng.choice(words) for _ in range(5)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 50]))) for _ in range(40)]
    return texts


def test_classes_by_brute_force(make_docs, cluster):
    got = {r.doc_id: r.class_id for r in dart.near_classes(make_docs(cluster)).collect()}
    assert got == brute_classes(cluster)
    kept = dart.keep_one(make_docs(cluster))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_classes_odd_rows(odd_docs, no_docs, odd_texts):
    rows = dart.near_classes(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 2
    by = {r.doc_id: r.class_id for r in rows}
    assert by[0] == by[1] == 0 and by[5] == by[6] == 5 and by[7] == 5 and by[2] == 2 and by[None] is None
    kept = dart.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in by.values() if c is not None})
    assert dart.near_classes(no_docs).count() == 0 and dart.keep_one(no_docs).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute_nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[ids == ids[q]] = np.inf
    return [(int(ids[i]), d[i]) for i in np.lexsort((ids, d))[:k] if np.isfinite(d[i])]


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 24)).astype(np.float32)
    x[300:700] = x[5]  # one vector holds a third of the rows
    df = spark.createDataFrame([(i, v.tolist(), 0, "s", "r") for i, v in enumerate(x)], VECTORS)
    got = {}
    for r in ann.search_every(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, hit = np.arange(1200), 0
    assert sorted(got) == list(range(0, 1200, 100))
    for q, found in got.items():
        want = brute_nearest(ids, x.astype(float), q)
        assert len(found) == 10 and [s for _, s in found] == sorted(s for _, s in found)
        hit += len({v for v, _ in found} & {v for v, _ in want})
    assert hit >= 0.95 * 120
    assert [v for v, _ in got[300]] == [5, *range(301, 310)]  # ties to the smaller vec_id


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (100, [2.0, 2.0]), (100, [2.0, 2.0]), (None, [1.0, 1.0]), (200, [0.0]), (300, [])]
    df = spark.createDataFrame([(i, v, None, "s", "r") for i, v in rows], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search_every(df).collect())
    assert got == [(0, 1, 1), (0, 2, 100), (0, 3, 100), (100, 1, 1), (100, 2, 0)]
    assert ann.search_every(df.filter(F.lit(False))).count() == 0


def test_codes_choose_few_and_all_nearest(spark):
    """On clustered vectors the codes leave less than a fifth to be reranked; on the table's own the nearest are all found."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 64))
    rows = centres[rng.integers(0, 20, 4000)] + 0.3 * rng.standard_normal((4000, 64))
    near = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    table_ = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for df in (near, table_):
        valid = ann.valid(df)
        asked = valid.filter("vec_id % 100 = 0")
        all_ = {r.vec_id: np.array(r.embedding, float) for r in valid.collect()}
        got = {}
        for r in ann.search_every(df).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        best = {q: set(sorted((i for i in all_ if i != q), key=lambda i: (np.linalg.norm(all_[i] - all_[q]), i))[:10]) for q in got}
        assert sum(len(best[q] & got[q]) for q in got) >= 0.95 * 10 * len(got)
        assert ann.nearest(valid, asked).agg(F.sum("reranked")).first()[0] < 0.2 * len(got) * len(all_)


def test_repeated_ids_ask_with_the_smallest_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [5.0, 0.0])]
    got = ann.search_every(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0), (2, 26**0.5)]


def test_only_the_sample_reaches_the_driver(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7 + 1.0).alias("embedding")).repartition(16)
    want = [r.vec_id for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(50).collect()]
    got = ann.sampled(rows, 50)
    assert [r.vec_id for r in got.collect()] == want
    # A plan that ends in the sorted limit would send the driver 50 rows of each task.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert -1 < plan.find("Filter (size(") < plan.find("TakeOrderedAndProject")
    assert ann.sampled(rows.limit(0), 50).count() == 0


def test_query_blocks_are_not_broadcast(spark):
    rows = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.col("id") * 1.0, F.col("id") % 7 + 1.0).alias("embedding"))
    assert "BroadcastExchange" not in ann.search_every(rows)._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" in ann.search_every(rows)._jdf.queryExecution().executedPlan().toString()


def test_short_texts_throw_their_darts_in_bounded_turns():
    import tracemalloc

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(20)) for _ in range(3000)]
    one = [dart._banded()([t])[0].to_pylist()[0] for t in texts[::500]]
    tracemalloc.start()
    got = dart._banded()(texts)[0].to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[::500] == one and peak < 120e6


def test_workers_get_few_texts_at_once(make_docs):
    from pyspark.sql.types import LongType

    from quarryline.llm.common import AT_ONCE, with_numbers

    worker = lambda: lambda texts: [[len(texts)] * len(texts)]
    got = with_numbers(make_docs(["one"] * 2000).coalesce(1), ["doc_id"], [("together", LongType())], worker)
    assert got.count() == 2000 and got.agg(F.max("together")).first()[0] <= AT_ONCE
