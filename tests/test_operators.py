"""Golden and brute-force cases of the operators."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quarryline.operators import findings, policy, review, scoring, sections, setmatch
from quarryline.sources import files, workbook

ITEM = "pos int, country string, pillar_id int, indicator_id string, act_name string, urls array<string>"


def items(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ITEM)


@pytest.mark.parametrize("pred, gold, want", [
    (("SG", 6, "6.1", "Privacy Act", []), ("SG", 7, "6.1", "Privacy Act", []), 0),
    (("SG", 6, "6.1", "A", ["http://x.org/a/"]), ("SG", 6, "6.2", "B", ["https://www.x.org/A?q=1"]), 1),
    (("SG", 6, "6.1", "Privacy Act", []), ("AU", 6, "6.1", "Privacy Act", []), 0),
    (("", 6, "6.1", "Privacy Act 1988", []), ("AU", 6, "6.1", "Privacy Act 2024", None), 1),
])
def test_match_rule(spark, pred, gold, want):
    assert scoring.candidate_pairs(items(spark, pred), items(spark, gold)).count() == want


def test_score_and_one_to_one(spark):
    gold = items(spark, ("SG", 6, "6.1", "Privacy Act", []), ("SG", 6, "6.1", "Customs Code", []))
    preds = items(spark, ("SG", 6, "6.1", "Privacy Act 2001", []), ("SG", 6, "6.1", "Invented Statute", []))
    all_ = scoring.score(preds, gold).filter("pillar_id is null").first()
    assert (all_.tp, all_.fp, all_.fn, all_.precision, all_.recall) == (1, 1, 1, 0.5, 0.5)
    twice = scoring.score(items(spark, ("SG", 6, "6.1", "Privacy Act", []), ("SG", 6, "6.1", "Privacy Act", [])), items(spark, ("SG", 6, "6.1", "Privacy Act", []))).filter("pillar_id is null").first()
    assert (twice.tp, twice.fp) == (1, 1)
    self_ = scoring.score(gold, gold).filter("pillar_id is null").first()
    assert self_.f1 == 1.0 and scoring.novel(gold, gold).count() == 0


def test_novel(spark):
    gold, refs = items(spark, ("SG", 6, "6.1", "Privacy Act", [])), spark.createDataFrame([("Customs Code 1999", "http://y.org/c/"), ("2012", "")], "act_name string, url string")
    preds = items(spark, ("SG", 6, "6.1", "Privacy Act", []), ("SG", 6, "6.1", "Brand New Data Bill 2026", []), ("X", 7, "7.1", "Customs Code", []), ("X", 7, "7.1", "Other", ["https://y.org/C"]), ("X", 7, "7.1", "2012", []))
    assert [r.act_name for r in scoring.novel(preds, gold, refs).collect()] == ["Brand New Data Bill 2026"]


@pytest.mark.parametrize("seed", [1, 7, 42])
def test_containment_by_brute_force(spark, seed):
    rng = random.Random(seed)
    tags = [f"t{i:02}" for i in range(12)]
    stored = [(f"n{i}", rng.sample(tags, rng.randint(0, 5))) for i in range(200)]
    asked = [(f"q{i}", rng.sample(tags, rng.randint(0, 12))) for i in range(50)]
    s, q = spark.createDataFrame(stored, "node_id string, tags array<string>"), spark.createDataFrame(asked, "doc_id string, tags array<string>")
    assert {tuple(r) for r in setmatch.subsets(s, q).collect()} == {(d, n) for d, b in asked for n, a in stored if set(a) <= set(b)}
    assert {tuple(r) for r in setmatch.supersets(s, q).collect()} == {(d, n) for d, b in asked for n, a in stored if set(a) >= set(b)}


def test_match_all(spark):
    s = spark.createDataFrame([("a", ["rare", "z"]), ("b", ["common"]), ("e", [])], "node_id string, tags array<string>")
    q = spark.createDataFrame([(0, "d", ["x"]), (1, "d", ["common", "z"]), (2, "x", None)], "pos int, doc_id string, tags array<string>")
    assert {r.doc_id: r.nodes for r in setmatch.match_all(s, q).collect()} == {"d": ["b", "e"], "x": ["e"]}
    with pytest.raises(ValueError):
        setmatch.match_all(s, q, "equal")
    assert [r.tag for r in setmatch.rarity_rank(s, ["z"]).orderBy("rank").collect()] == ["z", "common", "rare"]


SECTION = "doc string, pos int, heading string, level int, text string"


def test_heading_stack(spark):
    rows = [("d", 0, "Title", 1, "a"), ("d", 1, "Part A", 2, " b"), ("d", 2, "Deep", 3, ""), ("d", 3, "Part B", 2, "c"), ("d", 4, "Title", 1, "z"), ("d", 5, "法", 2, None)]
    got = {r.section_id: r for r in sections.structural_nodes(spark.createDataFrame(rows, SECTION)).collect()}
    assert set(got) == {"title", "title/part-a", "title/part-a/deep", "title/part-b", "title/"}
    assert got["title"].text == "a\n\nz" and got["title/part-a/deep"].tags == ["deep", "part-a", "title"] and got["title/part-b"].caption == "Part B"


def test_reconcile(spark):
    s = spark.createDataFrame([("d", i, h, 1, "some text here") for i, h in enumerate("ABCDE")], SECTION)
    ev = lambda t, q: [(t, q)]
    rows = [
        ("d", 0, "a", ["x"], ev("x", " text "), 0.9, ""), ("d", 1, "b", ["bad"], ev("bad", "text"), 0.9, ""), ("d", 2, "c", ["x"], ev("x", "absent"), 0.9, None),
        ("d", 3, "d", ["x"], ev("x", "text"), 0.9, "unsure"), ("d", 4, "e", ["x"], ev("x", "text"), 0.1, ""), ("d", 5, "nope", ["x"], [], 0.9, ""),
    ]
    r = spark.createDataFrame(rows, "doc string, pos int, section_id string, tags array<string>, evidence array<struct<tag:string,quote:string>>, confidence double, abstain_reason string")
    nodes, items_ = sections.reconcile(s, r, ["x", "y"])
    assert [n.section_id for n in nodes.collect()] == ["a"]
    assert {i.section_id: i.reason for i in items_.collect()} == {"b": "unknown-tags", "c": "unsupported-tag", "d": "abstain", "e": "low-confidence", "nope": "unknown-section"}


LAW = "Data Act 2020\nSection 26. Cross-border transfer of data is allowed; consent matters.\nSection 27. étransfer is none."


def test_findings(spark, tmp_path):
    docs = spark.createDataFrame([(0, "http://x.org/l.html", "SG", LAW, False), (1, "", "SG", None, True)], "pos int, url string, economy string, text string, is_pdf boolean")
    f = findings.extract(docs)
    rows = f.orderBy("kw_pos").collect()
    assert [r.indicator for r in rows] == ["P6-I1", "P6-I1", "P7-I1"] and rows[0].article_section == rows[1].article_section == "Section 26"
    assert all(r.verbatim_snippet in LAW and r.title == "Data Act 2020" for r in rows)
    assert findings.csv_rows(f).columns == list(findings.CSV_COLUMNS)
    files.write_csv(f.limit(0), str(tmp_path / "empty"))
    text = next((tmp_path / "empty").glob("*.csv")).read_text()
    assert text.startswith("Economy,Law Name") and text.count("\n") == 1
    files.write_json(f, str(tmp_path / "laws"))
    files.write_json(f.limit(0), str(tmp_path / "none"))
    import json

    laws = json.loads(next((tmp_path / "laws").glob("part-*")).read_text())
    assert len(laws) == 1 and len(laws[0]["provisions"]) == 3 and laws[0]["source_pdf_path"] is None
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text()) == []
    with pytest.raises(ValueError):
        findings.first_rows(f, -1)


def test_retrieval(spark):
    def run(p, outcomes):
        pol = spark.createDataFrame([p], "requested_url string, source_url string, authorized boolean, rate_limit_budget int, max_retries int, approved_fallback_urls array<string>")
        out = spark.createDataFrame([("s", *o) for o in outcomes], "source_url string, url string, nth int, statuses array<string>, has_error boolean, ok boolean")
        last = policy.retrieve(pol, out).orderBy("step").collect()
        assert last[-1].final and not any(r.final for r in last[:-1])
        return last[-1].kind, last[-1].fallback_used, len(last)

    ok, rate = ("s", 1, ["ok"], False, True), ("s", 0, ["rate limited"], False, False)
    assert run(("s", "s", True, 3, 1, []), [ok]) == ("allow", None, 1)
    assert run(("s", "s", False, 3, 1, []), [ok])[0] == "deny"
    assert run(("t", "s", True, 3, 1, []), [ok])[0] == "deny"
    assert run(("s", "s", True, 0, 1, []), [ok])[0] == "retry_later"
    assert run(("s", "s", True, 3, 1, []), [rate, ok]) == ("allow", None, 2)
    assert run(("s", "s", True, 3, 1, []), [("s", 0, ["captcha challenge"], False, False)])[0] == "handoff"
    assert run(("s", "s", True, 3, 1, ["m"]), [("s", 0, ["not_found"], False, False), ("m", 0, ["ok"], False, True)]) == ("allow", "m", 2)


def test_rate_window_is_half_open(spark):
    e = spark.sql("SELECT 1 user_id, timestamp'2024-01-01 00:00:00' ts UNION ALL SELECT 1, timestamp'2024-01-01 00:01:00' UNION ALL SELECT 1, timestamp'2024-01-01 00:01:59'")
    assert [r.used for r in policy.rate_budget(e).orderBy("ts").collect()] == [1, 1, 2]


def test_review(spark):
    f = spark.createDataFrame([("1", "pending"), ("2", "pending")], "id string, review_status string")
    u = spark.createDataFrame([(0, "1", "verified"), (1, "1", "rejected"), (2, "9", "verified")], "pos int, id string, review_status string")
    assert {r.id: r.review_status for r in review.with_review(f, u).collect()} == {"1": "rejected", "2": "pending"}
    empty = review.review_summary(f.limit(0)).first()
    assert (empty.total, empty.progress) == (0, 0)
    r = review.cer_report(spark.createDataFrame([], "reference string, hypothesis string")).first()
    assert (r.mean_cer, r.n, r.passed) == (0.0, 0, True)


def test_workbook(spark, tmp_path):
    head = ["Pillar_ID", "Indicator_ID", "Act", "Coverage", "Impact", "Timeframe", "References"]
    rows = [["title"], head, ["Pillar 6", "", "", "", "", "", ""], ["6", "6.1", "Privacy Act", "all", "some", "2012", "http://x.org; www.y.org\nnone"], ["5", "5.1", "No", "", "", "", ""], ["7", "7.1", "", "", "", "", ""]]
    cells = "".join(f"<row>{''.join(f'<c t="inlineStr" r="{chr(65 + i)}{n + 1}"><is><t>{v}</t></is></c>' for i, v in enumerate(r))}</row>" for n, r in enumerate(rows))
    m, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "g.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{rel}"><sheets><sheet name="Singapore" r:id="r1"/><sheet name="Consolidated" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{m}"><sheetData>{cells}</sheetData></worksheet>')
    spark.dataSource.register(workbook.GoldWorkbook)
    got = spark.read.format("gold_workbook").load(str(tmp_path / "g.xlsx")).collect()
    assert [(r.country, r.pillar_id, r.act_name, r.raw_score, r.urls) for r in got] == [("Singapore", 6, "Privacy Act", None, ["http://x.org", "www.y.org"])]


def test_reference_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("﻿" + ",".join(files.REFERENCE_COLUMNS) + '\nSG,"Act, the\nfirst",all,2012, http://x.org ,c,,,,\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_references(spark, str(tmp_path / "r.csv")).collect()] == [("SG", "Act, the\nfirst", "all", "2012", "http://x.org", "c")]


def test_stream(spark, tmp_path, sf):
    from quarryline.streaming.budget import windowed_uses

    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = windowed_uses(stream).writeStream.outputMode("complete").format("memory").queryName("uses").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("uses").agg(F.sum("used")).first()[0] == spark.read.parquet(str(tmp_path / "in")).count()
