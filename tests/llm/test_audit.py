"""Filter audit, M-tree search and ball-tree codes against SQL and brute force, and their odd inputs."""

from itertools import permutations
from math import factorial

import duckdb
import numpy as np
import pytest

from quarryline.llm import audit, codes, mtree, queries, sql

VECTORS = "vec_id long, embedding array<double>, label int, rank string, score string, code string, at string, tree string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, label, *["x"] * 5) for i, e, label in rows], VECTORS)


def duck(spark, sf, sql, **tables):
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'") if not tables else None
    for name, df in tables.items():
        con.register(name, df)
    return con.execute(sql).df()


def same(got, want):
    got, want = got[sorted(got.columns)], want[sorted(want.columns)]
    assert list(got.columns) == list(want.columns)
    rows = lambda df: sorted(map(tuple, df.astype(object).where(df.notna(), None).itertuples(index=False)), key=str)
    assert rows(got) == rows(want) and len(got)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf).toPandas(), duck(spark, sf, queries.oracle_sql()[name]))


@pytest.mark.parametrize("n", range(1, 7))
def test_plain_changes_visit_every_order_by_single_swaps(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in audit.plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == factorial(n) and set(seen) == set(permutations(range(n)))


def test_walk_equals_each_order_summed_anew():
    cells = np.random.default_rng(1).integers(0, 50, (16, 3))
    for order, now in audit.walk(cells, "abcd"):
        gone = np.zeros(16, bool)
        for name, row in zip(order, now, strict=True):
            fails = (np.arange(16) >> "abcd".index(name) & 1) == 1
            removed = cells[fails & ~gone].sum(0)
            want = [cells[~gone & ~fails, 0].sum(), removed[0], cells[fails & gone, 0].sum(), *removed[1:]]
            assert row.tolist() == want
            gone |= fails


def test_shapley_of_a_part_adds_up(spark, sf):
    got = queries.op11_filter_audit(spark, sf).toPandas()
    for _, part in got.groupby("part"):
        assert len(part) == 600 and part.removed.sum() == part.drop_duplicates(["filter_order", "step"]).removed.sum()
        per_filter = part.assign(f=[o[s - 1] for o, s in zip(part.filter_order, part.step, strict=True)]).groupby("f")
        assert (per_filter.removed.sum() == per_filter.shapley.first()).all()


def test_audit_of_odd_documents(spark, odd_docs, labels, odd_texts):
    """Nulls, empties, ties, repeated rows, a row without id, and labels that repeat."""
    marks = labels([(0, 1, 0, "x"), (0, 0, 1, "x"), (5, 1, None, "x"), (6, None, None, "x"), (None, 1, 1, "x"), (8, 0, 1, "x")])
    got = audit.audit(odd_docs, marks).toPandas()
    want = duck(spark, None, sql.FILTER_AUDIT, documents=odd_docs.toPandas(), labels=marks.toPandas())
    same(got, want)
    first = got[(got.filter_order == "EABCD") & (got.step == 1)].iloc[0]
    assert first.removed == 2  # the second empty text and the second base; a row given twice is no copy of itself
    assert first.kept + first.removed == len(odd_texts) + 2


def test_audit_of_nothing(no_docs, labels):
    assert audit.audit(no_docs, labels([])).count() == 0


def test_a_null_part_and_first_texts_across_parts(spark, labels):
    docs = spark.createDataFrame([(2, "same text", None), (1, "same text", "en"), (3, "same text", "de"), (1, "same text", "de")], "doc_id long, text string, lang string")
    got = audit.cells(docs, labels([])).toPandas()
    assert {(r.part, r.mask & 16): r.n for r in got.itertuples() if r.n} == {("", 16): 1, ("en", 0): 1, ("de", 0): 1, ("de", 16): 1}


def brute(rows, k=10, every=100):
    taking = [(i, [int(np.floor(1024 * x)) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    asked = {}
    for i, e, _ in rows:
        if i is not None and i % every == 0 and e and all(x is not None and np.isfinite(x) for x in e):
            asked[i] = min(asked.get(i, e), e)
    out = []
    for q, e in asked.items():
        v = [int(np.floor(1024 * x)) for x in e]
        near = sorted((-sum(a * b for a, b in zip(v, c, strict=True)), i) for i, c in taking if i != q and len(c) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


ODD = [
    (0, [1.0, 2.0], 1), (0, [0.5, 2.0], 1), (100, [0.0, 0.0], None), (200, None, 2), (300, [1.0, float("nan")], 2), (400, [1.0, None], 2), (500, [float("inf"), 0.0], 2), (600, [1.0, 2.0, 3.0], 3),
    (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [-1.0, 0.25], None), (4, [1e-9, -1e-9], 2), (None, [1.0, 1.0], 1), (5, [0.1, 0.2, 0.3], 3),
]


def test_top_k_of_odd_vectors(spark):
    got = sorted(map(tuple, mtree.search_every(vectors(spark, ODD)).collect()))
    assert got == brute(ODD)


def test_top_k_of_ties_and_copies(spark):
    random = np.random.default_rng(2)
    few = random.normal(size=(6, 8)).tolist()
    rows = [(i, few[i % 6], 0) for i in range(1500)]
    got = sorted(map(tuple, mtree.search_every(vectors(spark, rows)).collect()))
    assert got == brute(rows)


def test_top_k_of_nothing(spark):
    assert mtree.search_every(vectors(spark, [])).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), float(3 * i), -1.0], 0) for i in range(0, 400, 4)]
    got = sorted(map(tuple, mtree.search_every(vectors(spark, rows)).collect()))
    assert got == brute(rows)
    huge = mtree.search_every(vectors(spark, [(0, [1e300], 0), (1, [1e300], 0), (2, [-1e300], 0)])).collect()
    assert [(r.vec_id, r.score) for r in huge] == [(1, 2**63 - 1), (2, -(2**63))]


@pytest.mark.parametrize("kind", ["even", "clusters", "norms"])
def test_a_tree_finds_what_a_scan_finds_and_leaves_out_what_it_may(kind):
    random = np.random.default_rng(3)
    x = random.normal(size=(6000, 16))
    if kind == "clusters":
        x = random.normal(size=(60, 16))[random.integers(0, 60, 6000)] * 5 + 0.05 * x
    if kind == "norms":
        x *= np.exp(2 * random.normal(size=(6000, 1)))
    x, ids = mtree.whole(x), np.arange(6000)
    tree = mtree.Tree(ids, x)
    assert sorted(tree.ids.tolist()) == list(range(6000))
    packed = mtree.Tree.unpacked(16, tree.high, tree.packed())
    for q in range(0, 6000, 300):
        scores = (x @ x[q]).astype(np.int64)
        scores[q] = -(2**62)
        want = np.lexsort((ids, -scores))[:10]
        got, found = packed.search(q, x[q], 10)
        assert got.tolist() == want.tolist() and found.tolist() == scores[want].tolist()
        assert packed.search(q, x[q], 10, int(scores[want[-1]]))[0].tolist() == want.tolist()
    if kind != "even":
        assert packed.computed < 0.5 * 40 * 6000


def test_radii_and_parent_distances_cover():
    x = mtree.whole(np.random.default_rng(4).normal(size=(3000, 4)))
    tree = mtree.Tree(np.arange(3000), x)
    points = np.c_[tree.vectors, tree.lift]

    def rows(node):
        at = range(tree.first[node], tree.last[node])
        return list(at) if tree.leaf[node] else [r for c in at for r in rows(c)]

    for node in range(len(tree.leaf)):
        assert np.linalg.norm(points[rows(node)] - points[tree.route[node]], axis=1).max() <= tree.radius[node] + 1e-6


def brute_codes(rows, entries=256, rounds=4):
    x = np.array([[int(np.floor(1024 * y)) for y in e] for _, e, _ in rows], np.int64)
    parts, ids = np.split(x, 4, axis=1), np.array([i for i, _, _ in rows])
    books, picks = [], None
    for p in parts:
        book = [p[i] for i in np.argsort(ids, kind="stable")[:entries]]
        for turn in range(rounds + 1):
            d = ((p[:, None, :] - np.array(book)[None]) ** 2).sum(2)
            near = d.argmin(1)
            if turn < rounds:
                book = [(p[near == e].sum(0) // (near == e).sum()) if (near == e).any() else book[e] for e in range(len(book))]
        books.append(np.array(book))
        picks = [(near, d.min(1))] if picks is None else [*picks, (near, d.min(1))]
    codes_ = ["".join(f"{n[i]:02x}" for n, _ in picks) for i in range(len(rows))]
    errors = sum(d for _, d in picks)
    return {r[0]: (c, int(e)) for r, c, e in zip(rows, codes_, errors, strict=True)}, codes.digest(books)


def test_codes_equal_brute_force(spark):
    random = np.random.default_rng(5)
    rows = [(int(i), random.normal(size=12).round(2).tolist(), int(i) % 3) for i in random.permutation(700)]
    want, sha = brute_codes(rows)
    got = codes.compress(vectors(spark, rows)).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {sha}


def test_codes_of_odd_vectors(spark):
    got = codes.compress(vectors(spark, [*ODD, (7, [], 1), (8, [1e300, -1e300], 5)])).collect()
    assert len(got) == 13 and all(len(r.code) == 8 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert by[7][0].error == 0 and by[7][0].code == "00000000" and None in by
    # Labels: nulls count together.
    assert by[3][0].label_error == by[100][0].label_error == by[3][0].error + by[100][0].error
    assert len({r.codebooks_sha256 for r in got}) == 3  # lengths 2, 3 and 0


def test_codes_of_nothing(spark):
    assert codes.compress(vectors(spark, [])).count() == 0


def test_ball_tree_ties_go_to_the_lower_index():
    entries = np.array([[0, 0], [2, 0], [0, 0], [0, 2], [2, 2]] * 20, np.int64)
    parts = np.array([[1, 0], [1, 1], [0, 0], [3, 3], [0, 1]], np.int64)
    index, square = codes.BallTree(entries).nearest(parts)
    want = codes.squares(parts, entries)
    assert index.tolist() == want.argmin(1).tolist() and square.tolist() == want.min(1).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_ball_tree_equals_a_scan(seed):
    random = np.random.default_rng(seed)
    entries, parts = random.integers(-5, 6, (200, 3)), random.integers(-6, 7, (3000, 3))
    for scale in (1, 1 << 40):  # the second in Python's integers
        e, p = codes.fitted(entries.astype(object) * scale), codes.fitted(parts[: 3000 if scale == 1 else 200].astype(object) * scale)
        index, square = codes.BallTree(e).nearest(p)
        want = codes.squares(p, e)
        assert index.tolist() == want.argmin(1).tolist() and [int(s) for s in square] == [int(s) for s in want.min(1)]
