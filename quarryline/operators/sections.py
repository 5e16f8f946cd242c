"""Documents as ordered sections: breadcrumbs of headings, concept nodes, guided tagging.

Sections are rows (doc, pos, heading, level, text). A document's sections are one ordered array, so
its heading stack is a fold over that array, without a Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import blank, slug, strip

LEAST_CONFIDENCE = 0.6


def breadcrumbs(sections: DataFrame) -> DataFrame:
    """Each section with its trail: the headings of lower level that are still open, and its own."""
    item = F.struct("pos", F.col("level").cast("int").alias("level"), F.coalesce("heading", F.lit("")).alias("heading"), blank(F.col("text")).alias("text"))
    kind = "array<struct<level:int,heading:string>>"
    whole = sections.groupBy("doc").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(state: Column, s: Column) -> Column:
        stack = F.concat(F.filter(state["stack"], lambda e: e["level"] < s["level"]), F.array(F.struct(s["level"].alias("level"), s["heading"].alias("heading"))))
        row = F.struct(s["pos"].alias("pos"), s["level"].alias("level"), s["heading"].alias("heading"), s["text"].alias("text"), F.transform(stack, lambda e: e["heading"]).alias("trail"))
        return F.struct(stack.cast(kind).alias("stack"), F.concat(state["rows"], F.array(row)).alias("rows"))

    rows = whole.select("doc", "items").schema["items"].dataType.elementType
    pos_kind = rows["pos"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("stack"), F.array().cast(f"array<struct<pos:{pos_kind},level:int,heading:string,text:string,trail:array<string>>>").alias("rows"))
    folded = whole.select("doc", F.explode(F.aggregate("items", start, step, lambda s: s["rows"])).alias("r"))
    return folded.select("doc", "r.*").withColumn("section_id", F.array_join(F.transform("trail", lambda h: slug(h)), "/"))


def _joined(texts: Column) -> Column:
    return strip(F.array_join(F.filter(texts, lambda t: t != ""), "\n\n"))


def structural_nodes(sections: DataFrame) -> DataFrame:
    """A node for each scope of a document: its sections' texts, tags from its trail, the first heading as caption."""
    r = breadcrumbs(sections)
    got = r.groupBy("doc", "section_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"), F.min_by("trail", "pos").alias("trail"))
    return got.select("doc", "section_id", _joined(F.transform("parts", lambda p: p["text"])).alias("text"), F.element_at("trail", -1).alias("caption"), F.array_sort(F.array_distinct(F.transform("trail", lambda h: slug(h)))).alias("tags"))


def is_valid(texts: Column) -> Column:
    """Whether any section has text."""
    return F.exists(texts, lambda t: strip(blank(t)) != "")


def allowed_for(allowed: Column, hinted: Column) -> Column:
    """A section's tags: the allowed ones that its hint names, all allowed ones if it names none of them, else the hint's."""
    narrowed = F.array_intersect(allowed, hinted)
    return F.when(F.size(allowed) == 0, hinted).when(F.size(narrowed) > 0, narrowed).otherwise(allowed)


def tagging_tasks(sections: DataFrame, hints: DataFrame, allowed: list[str]) -> DataFrame:
    """A task for each section, with the tags that it may get. hints: (section_id, relevant_labels), of which the first by pos counts."""
    first = hints.groupBy("section_id").agg(F.min_by("relevant_labels", "pos").alias("hint"))
    none = F.array().cast("array<string>")
    got = breadcrumbs(sections).join(first, "section_id", "left")
    return got.select("doc", "pos", "section_id", "text", F.array_sort(allowed_for(F.array(*map(F.lit, allowed)) if allowed else none, F.coalesce("hint", none))).alias("allowed_tags"))


def reconcile(sections: DataFrame, results: DataFrame, allowed: list[str], least: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Accepted nodes (doc, section_id, text, caption, tags) and review items (doc, section_id, reason, detail).

    results: (doc, pos, section_id, tags, evidence array<struct<tag,quote>>, confidence,
    abstain_reason). A section's results are checked by pos; the first that fails rejects it.
    """
    r = breadcrumbs(sections)
    known = r.groupBy("doc", "section_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"), F.max_by("heading", "pos").alias("caption"))
    known = known.select("doc", "section_id", "caption", _joined(F.transform("parts", lambda p: p["text"])).alias("text"))
    may = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    unknown = F.array_sort(F.array_except("tags", may))
    held = lambda t: F.exists("evidence", lambda e: (e["tag"] == t) & (strip(blank(e["quote"])) != "") & F.contains(F.col("text"), strip(e["quote"])))
    bare = F.get(F.filter(F.array_sort("tags"), lambda t: ~held(t)), 0)
    checks = [
        (blank(F.col("abstain_reason")) != "", "abstain", F.col("abstain_reason")),
        (F.col("confidence") < least, "low-confidence", F.format_string(f"Confidence %.3f is below threshold {least:.3f}.", F.col("confidence"))),
        ((F.size(may) > 0) & (F.size(unknown) > 0), "unknown-tags", F.concat(F.lit("Tags outside the allowed taxonomy: "), F.array_join(unknown, ", "), F.lit("."))),
        (F.size("tags") == 0, "empty-tags", F.lit("Result did not produce any tags.")),
        (bare.isNotNull(), "unsupported-tag", F.concat(F.lit("Tag '"), bare, F.lit("' has no evidence quote present in the source section text."))),
    ]
    reason = detail = F.lit(None).cast("string")
    for test, name, words in reversed(checks):
        reason, detail = F.when(test, name).otherwise(reason), F.when(test, words).otherwise(detail)
    joined = results.select("doc", F.col("pos").alias("at"), "section_id", "tags", "evidence", "confidence", "abstain_reason").join(known, ["doc", "section_id"]).withColumns({"reason": reason, "detail": detail})
    bad = joined.filter(F.col("reason").isNotNull()).groupBy("doc", "section_id").agg(F.min_by(F.struct("reason", "detail"), "at").alias("r")).select("doc", "section_id", "r.reason", "r.detail")
    good = joined.join(bad.select("doc", "section_id"), ["doc", "section_id"], "left_anti")
    nodes = good.groupBy("doc", "section_id").agg(F.first("text").alias("text"), F.first("caption").alias("caption"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    strange = results.join(known.select("doc", "section_id"), ["doc", "section_id"], "left_anti")
    strange = strange.select("doc", "section_id", F.lit("unknown-section").alias("reason"), F.concat(F.lit("Result references '"), "section_id", F.lit("', which does not map to a document section.")).alias("detail"))
    return nodes, bad.unionByName(strange)
