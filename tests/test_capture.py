"""Captured bodies, injected readers and models."""

from pyspark.sql import functions as F

from quarryline.operators import capture


def test_documents(spark):
    rows = [
        (0, "http://x.org/a.pdf", "SG", None, None, bytearray(b"one|two")), (1, "http://x.org/b", "SG", "application/pdf", None, bytearray(b"bad")),
        (2, "http://x.org/c", "AU", "text/html; charset=utf-8", None, bytearray("<main><p>é</p></main>".encode())), (3, "http://x.org/d", "AU", None, None, None),
    ]
    df = spark.createDataFrame(rows, "pos int, url string, economy string, content_type string, encoding string, body binary")

    def reader(raw):
        if raw == b"bad":
            raise ValueError("no pages")
        return [*raw.decode().split("|"), " "]

    got = {r.pos: (r.text, r.is_pdf, r.error) for r in capture.documents(df, reader).collect()}
    assert got == {0: ("one\ntwo", True, None), 1: ("", True, "ValueError: no pages"), 2: ("é", False, None), 3: ("", False, None)}


def test_models(spark):
    prompt = capture.build_prompt("Pick links.", {"b": 1, "a": ["é"]})
    assert prompt == capture.build_prompt("Pick links.", {"a": ["é"], "b": 1}) and "é" in prompt
    r = capture.complete(spark.createDataFrame([(prompt,), (None,)], "prompt string")).collect()
    assert r[0].error is None and '"selected_urls": []' in r[0].reply and r[1].reply is None
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "string"}}}}
    texts = ['{"n": 1}', 'say {"n": 2, "l": ["x"]} end', '{"n": true}', '{"l": [1]}', "none"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(capture.checked_json(F.col("t"), schema)).collect()]
    assert [g.error is None for g in got] == [True, True, False, False, False]
    assert [g.error for g in got[2:]] == ["$.n: not integer", "$.n: missing; $.l[0]: not string", "no JSON"] and got[1].value == '{"n": 2, "l": ["x"]}'
    assert capture.upper_types({"type": "object", "properties": {"type": {"type": "string"}}}) == {"type": "OBJECT", "properties": {"type": {"type": "STRING"}}}


def test_choices(spark):
    df = spark.createDataFrame([("<p>enough</p>" * 50, "r", "", "SG"), ("<script>x</script>", "r", "AU", "SG"), (None, "r", None, None), ("Please enable JavaScript", None, "", "")], "s string, r string, e string, c string")
    got = [tuple(x) for x in df.select(capture.best_html(F.col("s"), F.col("r")), capture.economy_of(F.col("e"), F.col("c"))).collect()]
    assert [g[1] for g in got] == ["SG", "AU", "", ""] and got[1][0] == got[2][0] == "r" and got[3][0].startswith("Please")


def test_schemas_are_expressions(spark):
    """Nested objects and arrays, odd keys, nulls, numbers of each kind; no Python in the plan."""
    schema = {"type": "object", "required": ["a'b", "n"], "properties": {"a'b": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number"}}}}, "n": {"type": "null"}, "u": {"type": "other"}, "t": {"type": "boolean"}}}
    texts = ["""{"a'b": [{"x": 1}, {"x": 1.5}, {"x": 1e300}], "n": null, "u": 1, "t": true}""", """{"a'b": [{"x": "1"}, {}, 3], "n": 0, "t": 1}""", "[]", "null", "", None, """{"a'b": {}, "n": null}"""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(capture.checked_json(F.col("t"), schema).alias("c"))
    assert [r.c.error for r in df.collect()] == [None, "$.a'b[0].x: not number; $.a'b[1].x: missing; $.a'b[2]: not object; $.n: not null; $.t: not boolean", "$: not object", "$: not object", "no JSON", "no JSON", "$.a'b: not array"]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
