"""Gold records as findings, guide excerpts, years in acts' names, tables of a crawl."""

import datetime
import json

from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import findings
from quarryline.sources import files


def test_gold_records_are_known_findings(spark):
    kind = "pos int, act_name string, timeframe string, urls array<string>, coverage string, impact string, pillar_id int, indicator_id string, country string"
    rows = [(0, "Data Act", "since 2001, changed 2014", ["http://x.org/a", "http://y.org"], "all", "high", 7, "7.2", "Australia"), (1, "Other", None, [], None, None, 6, "6.1", None)]
    a, b = findings.from_gold(spark.createDataFrame(rows, kind)).orderBy("pos").collect()
    assert (a.title, a.last_update, a.url, a.pillar, a.indicator, a.confidence, a.economy, a.location_ref) == ("Data Act", datetime.date(2014, 1, 1), "http://x.org/a", 7, "P7-I2", 1.0, "Australia", "http://x.org/a")
    assert (b.last_update, b.url, b.location_ref, b.discovery_tag) == (None, "", None, "KNOWN")
    assert findings.csv_rows(findings.from_gold(spark.createDataFrame(rows, kind))).columns == list(findings.CSV_COLUMNS)


def test_excerpts_leave_out_what_is_empty(spark):
    df = spark.createDataFrame([("Sum", ["b", "a"], ["w1", "w2"]), ("", [], []), (None, ["x"], [])], "s string, l array<string>, w array<string>")
    assert [r[0] for r in df.select(T.excerpt(F.col("s"), F.col("l"), F.col("w"))).collect()] == ["Sum\nRelevant labels: a, b\nWarnings: w1; w2", "", "Relevant labels: x"]


def test_only_years_that_stand_alone_are_no_part_of_an_act(spark):
    df = spark.createDataFrame([("Act 2012 (1999)",), ("act_2012",), ("Act2012 20123",), (None,)], "a string")
    assert [r[0] for r in df.select(T.act_tokens(F.col("a"))).collect()] == [["act"], ["act", "2012"], ["act2012", "20123"], []]


def test_nearest_section_by_hand(spark):
    text = "Section 1 here. See Art. 22a and s. 7, then article 9 hit and\nSECTION\t5."
    df = spark.createDataFrame([(text, text.index("9 hit") + 1), (text, 1), (text, len(text)), ("none", 1), ("", 1), (None, 1), ("Section5x Sections 4", 3)], "t string, s int")
    got = [r[0] for r in df.select(findings.nearest_section(T.blank(F.col("t")), F.col("s"))).collect()]
    assert got == ["article 9", "Section 1", "SECTION 5", "", "", "", "Section5x"]


def test_tables_are_written_as_lines(spark, tmp_path):
    files.write_tables({"visited": spark.createDataFrame([("http://a.org/é",)], "url string"), "failed": spark.createDataFrame([], "url string, reason string")}, str(tmp_path))
    lines = [json.loads(x) for f in (tmp_path / "visited").glob("part-*") for x in f.read_text(encoding="utf-8").splitlines()]
    assert lines == [{"url": "http://a.org/é"}] and (tmp_path / "failed").is_dir()
