"""The pipeline's stages, each on what the one before kept, and the registered queries."""

import corpus_pipeline as cp
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarryline.llm import dart, linededup, quality, toxicity
from quarryline.llm.common import cut, table


def test_stages(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "lines", "near_duplicates", "packing"]
    got = []
    for name, stage in cp.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf), name)
        got.append(docs)
        if name != "packing":
            assert docs.columns == before.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    whole = table(spark, sf, "documents")
    assert ids(got[0]) == {r.doc_id for r in quality.score(whole, labels).collect() if r.predicted}
    assert ids(got[1]) == {r.doc_id for r in toxicity.score(got[0], labels).collect() if not r.predicted}
    removed = {r.doc_id: set(r.removed_lines) for r in linededup.removed_lines(got[1]).collect()}
    before = {r.doc_id: r.text for r in got[1].collect()}
    assert {r.doc_id: r.text for r in got[2].collect()} == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed[d]) for d, t in before.items()}
    assert ids(got[3]) == {r.class_id for r in dart.near_classes(got[2]).collect()}
    assert ids(got[4]) == ids(got[3])


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_names_of_other_columns_never_clash(spark, make_docs, labels):
    """Columns named like the operators' own, or with a dot, come back as they were."""
    names = ["removed", "a.b", "__n", "__same", "text_a", "marks", "places", "__mask", "__score", "line"]
    base = make_docs([f"some words of document number {i} that nobody else has written\nand a line" for i in range(12)])
    docs = base.select("doc_id", "text", "n_chars", *[F.lit(f"v {n}").alias(n) for n in names])
    marks = labels([(i, i % 2, 1 - i % 2, "x") for i in range(12)])
    for out in (linededup.dedup_lines(docs), dart.keep_one(docs), quality.keep_good(docs, marks), toxicity.keep_civil(docs, marks)):
        assert out.columns == docs.columns
        assert all(list(r)[3:] == [f"v {n}" for n in names] for r in out.collect())


@pytest.mark.parametrize("at", [0, 1, 3, 4])
def test_stages_send_workers_few_rows_at_once(spark, sf, at):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    try:
        cp.STAGES[at][1](spark, table(spark, sf, "documents"), sf)
        counted = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        assert max(r.n for r in counted.collect()) <= 1024
    finally:
        spark.conf.set(key, before)


def test_a_kept_text_is_sent_once(make_docs, labels):
    docs, marks = make_docs(["a text", None, "another"]), labels([(i, i % 2, 0, "x") for i in range(3)])
    sent = quality.scored(docs, marks, ["doc_id", "text"])
    plan = sent._jdf.queryExecution().analyzed().toString().splitlines()
    assert plan[1].count(",") == 1, plan
    assert sorted((r.doc_id, r.text) for r in sent.collect()) == [(0, "a text"), (1, None), (2, "another")]
