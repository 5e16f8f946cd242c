"""Keyword findings, their output rows and the law-by-law nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as T

#: Keywords by pillar, in scan order, and the indicator of each.
KEYWORDS = (
    (6, "cross-border", "6.1"), (6, "transfer", "6.1"), (6, "overseas", "6.1"), (6, "localisation", "6.2"), (6, "localization", "6.2"), (6, "data residency", "6.2"), (6, "adequacy", "6.3"),
    (7, "consent", "7.1"), (7, "breach", "7.2"), (7, "data subject", "7.3"), (7, "personal data", "7.4"), (7, "processing", "7.5"),
)
CONFIDENCE = 0.5
#: The columns of the submission, in order.
CSV_COLUMNS = ("Economy", "Law Name", "Law Number/Ref", "Last Amended", "Indicator ID", "Article / Section", "Discovery Tag", "Location Ref.", "Verbatim Snippet", "Mapping Rationale", "Source URL", "Confidence", "Notes")
#: How a section of a law is referred to.
_SECTION = rf"(?iU)(?<!{T._W})(?:Section|Article|Art\.?|s\.)\s*\d+[A-Za-z]?(?!{T._W})"


def nearest_section(text: Column, start: Column) -> Column:
    """The section reference nearest to a place (from 1) in the whole text, the first of equally near ones; '' without any.

    The references and what lies between them are walked together once, with a running place, so that
    the whole stays inside the JVM.
    """
    refs, between = F.regexp_extract_all(text, F.lit(_SECTION), 0), F.split(text, _SECTION, -1)
    steps = F.zip_with(refs, F.slice(between, F.lit(1), F.size(refs)), lambda r, b: F.struct(r.alias("ref"), F.length(b).alias("gap")))
    begin = F.struct(F.lit(1).alias("at"), F.lit(None).cast("int").alias("far"), F.lit("").alias("best"))

    def step(s: Column, x: Column) -> Column:
        here = s["at"] + x["gap"]
        far = F.abs(here - start)
        nearer = s["far"].isNull() | (far < s["far"])
        return F.struct((here + F.length(x["ref"])).alias("at"), F.when(nearer, far).otherwise(s["far"]).alias("far"), F.when(nearer, x["ref"]).otherwise(s["best"]).alias("best"))

    return F.aggregate(steps, begin, step, lambda s: T.collapse(s["best"]))


def keyword_hits(docs: DataFrame, keywords: tuple = KEYWORDS, pillar: int | None = None) -> DataFrame:
    """Each document's first hit of each keyword: (.., kw_pos, pillar, keyword, indicator, start).

    The keyword table is a parameter of a few rows; its patterns are unrolled as literals, so each is
    compiled once and the text is read once.
    """
    table = [(n, p, k, i) for n, (p, k, i) in enumerate(keywords) if pillar in (None, p)]
    text = T.blank(F.col("text"))
    hits = [
        F.struct(F.lit(n).alias("kw_pos"), F.lit(p).alias("pillar"), F.lit(k).alias("keyword"), F.lit(i).alias("code"), F.regexp_instr(text, F.lit(rf"(?iu)(?<!{T._W})\Q{k}\E(?!{T._W})")).alias("start"))
        for n, p, k, i in table
    ]
    found = docs.withColumn("hit", F.explode(F.filter(F.array(*hits), lambda h: h["start"] > 0)))
    return found.select("*", "hit.kw_pos", "hit.pillar", "hit.keyword", T.indicator(F.col("hit.code")).alias("indicator"), F.col("hit.start").cast("int").alias("start")).drop("hit")


def extract(docs: DataFrame, keywords: tuple = KEYWORDS, pillar: int | None = None, sections: bool = True) -> DataFrame:
    """Findings of documents (pos, url, economy, text, is_pdf), in keyword order for each. A document's title is made once, whatever it holds."""
    h = keyword_hits(docs.withColumn("__title", T.derive_title(F.col("text"), F.col("url"))), keywords, pillar)
    # A window's clause is cut once, though it is given twice.
    h = h.withColumn("__clause", T.verbatim_clause(T.blank(F.col("text")), F.col("start"), F.col("keyword")))
    section = nearest_section(T.blank(F.col("text")), F.col("start")) if sections else F.lit("")
    return h.select(
        "pos", "kw_pos", F.col("__title").alias("title"), F.lit(None).cast("date").alias("last_update"), "url", F.lit("").alias("scope"), F.col("__clause").alias("provisions"), F.lit("").alias("impact"),
        "pillar", "indicator", F.lit(CONFIDENCE).alias("confidence"), "economy", F.lit(None).cast("string").alias("law_number"), section.alias("article_section"),
        F.lit("KNOWN").alias("discovery_tag"), F.col("__clause").alias("verbatim_snippet"), T.rationale(F.col("keyword"), F.col("indicator")).alias("mapping_rationale"),
        F.nullif(F.col("url"), F.lit("")).alias("location_ref"), F.when(F.col("is_pdf"), "Extracted from PDF text.").otherwise("").alias("notes"),
    )


def from_gold(gold: DataFrame) -> DataFrame:
    """Gold records as known findings."""
    first = F.get("urls", 0)
    return gold.select(
        "pos", F.lit(0).alias("kw_pos"), F.col("act_name").alias("title"), T.last_amended(F.col("timeframe")).alias("last_update"), F.coalesce(first, F.lit("")).alias("url"), F.col("coverage").alias("scope"), F.lit("").alias("provisions"), "impact",
        F.col("pillar_id").alias("pillar"), T.indicator(F.col("indicator_id")).alias("indicator"), F.lit(1.0).alias("confidence"), F.col("country").alias("economy"), F.lit(None).cast("string").alias("law_number"), F.lit("").alias("article_section"),
        F.lit("KNOWN").alias("discovery_tag"), F.lit("").alias("verbatim_snippet"), F.lit("").alias("mapping_rationale"), first.alias("location_ref"), F.lit("").alias("notes"),
    )


def first_rows(findings: DataFrame, n: int) -> DataFrame:
    """The first n by document and keyword."""
    if n < 0:
        raise ValueError("a limit can't be negative")
    return findings.orderBy("pos", "kw_pos").limit(n)


def csv_rows(findings: DataFrame) -> DataFrame:
    c = T.blank
    values = (
        c(F.col("economy")), F.col("title"), c(F.col("law_number")), F.coalesce(F.year("last_update").cast("string"), F.lit("")), F.col("indicator"), c(F.col("article_section")), F.col("discovery_tag"),
        c(F.col("location_ref")), c(F.col("verbatim_snippet")), c(F.col("mapping_rationale")), c(F.col("url")), T.money2(F.col("confidence")), c(F.col("notes")),
    )
    return findings.select(*[v.alias(n) for v, n in zip(values, CSV_COLUMNS, strict=True)])


def law_objects(findings: DataFrame, pdf_paths: DataFrame | None = None, model_version: str = "") -> DataFrame:
    """(law_pos, law): a JSON object for each economy and title, in order of first finding, provisions in order; null keys are kept.

    pdf_paths: (economy, law_name, path); a row without economy serves every one.
    """
    at = F.struct("pos", "kw_pos")
    provision = F.struct(
        F.col("indicator").alias("indicator_id"), F.col("article_section").alias("article"), F.col("verbatim_snippet").alias("verbatim"), "mapping_rationale", "discovery_tag", F.col("url").alias("source_url"),
        F.bround("confidence", 2).alias("confidence"), F.coalesce(F.nullif(F.col("provisions"), F.lit("")), F.nullif(F.col("notes"), F.lit("")), F.lit("")).alias("raw_context"),
    )
    laws = findings.groupBy("economy", F.col("title").alias("law_name")).agg(F.min(at).alias("at"), F.array_sort(F.collect_list(F.struct(at.alias("at"), provision.alias("p")))).alias("ps"))
    if pdf_paths is not None:
        exact = pdf_paths.filter("economy is not null").groupBy("economy", "law_name").agg(F.first("path").alias("path1"))
        loose = pdf_paths.filter("economy is null").groupBy("law_name").agg(F.first("path").alias("path2"))
        laws = laws.join(exact, ["economy", "law_name"], "left").join(loose, "law_name", "left").withColumn("source_pdf_path", F.coalesce("path1", "path2"))
    else:
        laws = laws.withColumn("source_pdf_path", F.lit(None).cast("string"))
    law = F.struct("economy", "law_name", "source_pdf_path", F.lit(None).cast("double").alias("ocr_quality_cer"), F.lit(None).cast("double").alias("processing_time"), F.lit(model_version).alias("model_version"), F.transform("ps", lambda p: p["p"]).alias("provisions"))
    return laws.select(F.col("at.pos").alias("law_pos"), F.to_json(law, {"ignoreNullFields": "false"}).alias("law"))
