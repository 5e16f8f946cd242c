"""Getting text out of captured bodies, and calls to injected models: plug-in points of the engine.

What a plug-in does (a PDF reader, a model) is a Python callable; it runs in Arrow batches on the
executors. A failing row never fails the job: it carries its error instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import html as H
from quarryline.functions import urls as U
from quarryline.functions.text import blank, salvage_json
from quarryline.operators.layout import headless_required


class PdfReader(Protocol):
    """The texts of a PDF's pages."""

    def __call__(self, raw: bytes) -> list[str]: ...


class Model(Protocol):
    """A prompt's completion, as JSON text."""

    def __call__(self, prompt: str) -> str: ...


_VALUE = "value string, error string"


def guarded(function: Callable[[Any], str | None], column: Column) -> Column:
    """struct<value, error> of a callable on each value: a failure is the error's text, beside a null value."""

    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for v in values:
            try:
                out.append((None if v is None else function(v), None))
            except Exception as e:  # noqa: BLE001 - a plug-in may fail in any way; the row says how
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["value", "error"])

    return F.pandas_udf(run, _VALUE)(column)


def pdf_text(body: Column, reader: PdfReader) -> Column:
    """struct<value, error>: the pages' texts, a line end between, blank pages left out."""
    return guarded(lambda raw: "\n".join(t for t in map(str.strip, reader(bytes(raw))) if t), body)


def best_html(static: Column, rendered: Column) -> Column:
    """The static page unless it needs a browser and a rendered one is there."""
    return F.when(headless_required(static), F.coalesce(rendered, static)).otherwise(F.coalesce(static, rendered))


def economy_of(economy: Column, country: Column) -> Column:
    return F.coalesce(F.nullif(blank(economy), F.lit("")), blank(country))


def documents(captures: DataFrame, reader: PdfReader) -> DataFrame:
    """Crawled documents (pos, url, economy, text, is_pdf, error) from captures (pos, url, economy, content_type, encoding, body).

    PDF bodies go to the reader, others are decoded and cleaned; each kind is a plan of its own, so
    neither waits in the other's batches.
    """
    known = captures.withColumn("is_pdf", U.is_pdf(F.col("url"), F.col("content_type")))
    pdf = known.filter("is_pdf").withColumn("r", pdf_text(F.col("body"), reader))
    web = known.filter("not is_pdf").withColumn("html", H.decode_body(F.col("body"), F.col("content_type"), F.col("encoding")))
    keep = ["pos", "url", "economy"]
    return pdf.select(*keep, blank(F.col("r.value")).alias("text"), "is_pdf", F.col("r.error").alias("error")).unionByName(
        web.select(*keep, H.clean_html_col(F.col("html")).alias("text"), "is_pdf", F.lit(None).cast("string").alias("error"))
    )


def stub_model(prompt: str) -> str:
    """The default model: it selects nothing, always alike."""
    return json.dumps({"prompt_chars": len(prompt), "selected_urls": []})


def build_prompt(task: str, payload: dict) -> str:
    """A deterministic prompt: what to do, then the data as JSON."""
    return f"{task.strip()}\nReply with one JSON object.\nData:\n{json.dumps(payload, ensure_ascii=False, sort_keys=True)}"


def complete(prompts: DataFrame, model: Model = stub_model, column: str = "prompt") -> DataFrame:
    """prompts with reply (JSON text) and error."""
    r = prompts.withColumn("__r", guarded(model, F.col(column)))
    return r.select(*prompts.columns, F.col("__r.value").alias("reply"), F.col("__r.error").alias("error"))


#: What variants call the types of schemas.
_VARIANT_TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN$", "null": "^VOID$"}


def variant_errors(value: Column, schema: dict, at: Column | str = "$") -> Column:
    """array<string>: where a variant departs from a schema's types, required keys and items, each with its place, in the order of the schema; unknown types pass. The schema becomes an expression; nothing leaves the JVM."""
    at = F.lit(at) if isinstance(at, str) else at
    none = F.array().cast("array<string>")
    known = F.schema_of_variant(value)
    one = lambda name: F.try_variant_get(value, f'$["{name}"]' if "'" in name else f"$['{name}']", "variant")
    kind = schema.get("type")
    fits = known.rlike(_VARIANT_TYPES[kind]) if kind in _VARIANT_TYPES else F.lit(True)
    inner = []
    for k in schema.get("required", ()):
        inner.append(F.when(known.startswith("OBJECT") & one(k).isNull(), F.array(F.concat(at, F.lit(f".{k}: missing")))).otherwise(none))
    for k, sub in schema.get("properties", {}).items():
        inner.append(F.when(known.startswith("OBJECT") & one(k).isNotNull(), variant_errors(one(k), sub, F.concat(at, F.lit(f".{k}")))).otherwise(none))
    if isinstance(schema.get("items"), dict):
        items = F.when(known.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        found = F.flatten(F.transform(items, lambda v, i: variant_errors(v, schema["items"], F.concat(at, F.lit("["), i.cast("string"), F.lit("]")))))
        inner.append(F.coalesce(found, none))
    deeper = F.concat(*inner) if inner else none
    return F.when(fits, deeper).otherwise(F.array(F.concat(at, F.lit(f": not {kind}")))) if kind in _VARIANT_TYPES else deeper


def checked_json(text: Column, schema: dict) -> Column:
    """struct<value,error>: JSON text (or what stands from its first to its last brace) that fits the schema, else what is wrong with it; an error of its own if there is no JSON."""
    found = salvage_json(text)
    wrong = variant_errors(F.try_parse_json(found), schema)
    error = F.when(found.isNull(), "no JSON").when(F.size(wrong) > 0, F.array_join(wrong, "; "))
    return F.struct(F.when(error.isNull(), found).alias("value"), error.alias("error"))


def upper_types(schema: Any) -> Any:
    """A schema with type names in upper case, as some model services want them."""
    if isinstance(schema, dict):
        return {k: v.upper() if k == "type" and isinstance(v, str) else upper_types(v) for k, v in schema.items()}
    return [upper_types(v) for v in schema] if isinstance(schema, list) else schema
