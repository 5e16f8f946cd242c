"""Page layouts: fingerprints that sibling pages share, learnt once for each layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import html as H
from quarryline.functions import urls as U
from quarryline.functions.text import strip

LANDMARKS, HEADINGS = "header|nav|main|article|aside|footer", "h[1-6]"
#: Class tokens that differ between sibling pages: states, positions, hashes, numbers.
VOLATILE = (
    r"(?i)^(?:is-[\w-]*|has-[\w-]*|js-[\w-]*|active|selected|current|open|opened|closed|hidden|show|shown|hide|focus|focused|hover|disabled|loading|expanded|collapsed"
    r"|(?:page|item|p|n|col|row|step|slide|tab)-?\d+|[0-9a-f]{8,}|\d+)$"
)
#: Words of boilerplate, the shortest useful text, the roles of rules.
BOILERPLATE = ("cookie", "all rights reserved", "skip to content", "privacy policy")
LEAST_CHARS = 80
ROLES = ("ignore", "crawl_only", "extract_and_crawl", "extract_only")
#: Signs of a page that needs a browser, and the length below which a script alone is one.
NEEDS_SCRIPT, SHORT_PAGE = ("javascript is required", "enable javascript", "you need to enable javascript"), 500


def stable_classes(html: Column) -> Column:
    return F.filter(H.classes_of(html), lambda c: ~c.rlike(VOLATILE))


def _json_list(a: Column) -> Column:
    """As json.dumps writes a list of ASCII strings; others are escaped by code unit."""

    def escaped(s: Column) -> Column:
        plain = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        units = F.regexp_extract_all(F.hex(F.encode(plain, "UTF-16BE")), F.lit("(.{4})"), 1)
        wide = F.array_join(F.transform(units, lambda u: F.when((u >= "0020") & (u <= "007E"), F.decode(F.unhex(u), "UTF-16BE")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")
        return F.when(plain.rlike(r"^[\x20-\x7e]*$"), plain).otherwise(wide)

    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda s: F.concat(F.lit('"'), escaped(s), F.lit('"'))), ", "), F.lit("]"))


def fingerprint(pages: DataFrame) -> DataFrame:
    """pages with landmarks, heading_levels, stable_classes and layout_id, a digest of the three."""
    parts = pages.withColumns({"landmarks": H.tags_of(F.col("html"), LANDMARKS), "heading_levels": H.tags_of(F.col("html"), HEADINGS), "stable_classes": stable_classes(F.col("html"))})
    text = F.concat(*[x for name in ("heading_levels", "landmarks", "stable_classes") for x in (F.lit(f'{"{" if name == "heading_levels" else ", "}"{name}": '), _json_list(F.col(name)))], F.lit("}"))
    return parts.withColumn("layout_id", F.concat(F.lit("layout-"), F.substring(F.sha2(text, 256), 1, 12)))


def learn_once(pages: DataFrame, pos: str = "page_id") -> DataFrame:
    """Each layout's pages, and the first of them, whose rules the others reuse."""
    return fingerprint(pages).groupBy("layout_id").agg(F.count("*").alias("n_pages"), F.min(pos).alias("first_page"))


def validation_failures(text: Column, least: int = LEAST_CHARS) -> Column:
    """Names of what is wrong with an extracted text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for term in BOILERPLATE:
        found = found | F.contains(low, F.lit(term))
    return F.filter(F.array(F.when(F.length(strip(low)) < least, "content_chars"), F.when(found, "boilerplate")), lambda f: f.isNotNull())


def relevant(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a site's keywords occur anywhere in a text, in any case."""
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(k.lower()))
    return found


def headless_required(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    found = F.lit(False)
    for term in NEEDS_SCRIPT:
        found = found | F.contains(low, F.lit(term))
    return found | ((F.length(F.coalesce(html, F.lit(""))) < SHORT_PAGE) & F.contains(low, F.lit("<script")))


def normalize_rules(rules: Column) -> Column:
    """Rules with a selector and a known role."""
    named = F.transform(rules, lambda r: F.struct(strip(F.coalesce(r["selector"], F.lit(""))).alias("selector"), r["role"].alias("role"), F.coalesce(r["reason"], F.lit("")).alias("reason")))
    return F.filter(named, lambda r: (r["selector"] != "") & r["role"].isin(*ROLES))


def navigation(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, text, pos) of the links of each page's navigation that may be followed, each address once."""
    links = U.followable(H.nav_anchors_col(F.col("html"), F.col("url")), U.host(F.col("url")))
    return pages.select(key, F.posexplode(links).alias("pos", "l")).select(key, "l.url", "l.text", "pos")


def ruled(pages: DataFrame, rules: Column, include: list[str] | Column = (), exclude: list[str] | Column = (), host: Column | None = None) -> DataFrame:
    """pages with by_rules: what rules (array<struct<selector,role>>) take from each: distinct texts, a line each; links that may be followed; the first error of a selector."""
    rows = pages.withColumn("by_rules", H.rule_rows_col(F.col("html"), F.col("url"), rules))
    texts = F.array_distinct(F.filter(F.transform("by_rules", lambda r: r["text"]), lambda x: x != ""))
    links = U.followable(F.flatten(F.transform("by_rules", lambda r: r["links"])), U.host(F.col("url")) if host is None else host, 0, include, exclude)
    error = F.get(F.filter(F.transform("by_rules", lambda r: r["error"]), lambda e: e.isNotNull()), 0)
    return rows.withColumn("by_rules", F.struct(F.array_join(texts, "\n").alias("text"), links.alias("links"), error.alias("error")))


#: What a model replies when it learns or revises a layout.
REPLY = "rules array<struct<selector:string,role:string,reason:string>>, include_url_patterns array<string>, exclude_url_patterns array<string>, confidence double, warnings array<string>"
#: How often a layout's rules are revised, and what is asked of the model.
REVISIONS = 2
LEARN, REVISE = "Infer extraction rules from the page's structure.", "Revise the extraction rules, which failed on this page."


def _compile(patterns: list[str] | None) -> bool:
    import re

    try:
        for p in patterns if patterns is not None else ():
            re.compile(p or "")
    except re.error:
        return False
    return True


def rule_set(reply: Column) -> Column:
    """struct<rules,include,exclude,..> of a model's reply: rules with a selector and a known role; a reply that is no JSON object has none. With a pattern that can't be read no link is followed."""
    import pandas as pd

    got = F.from_json(reply, REPLY)
    none = F.array().cast("array<string>")
    readable = F.pandas_udf(lambda i, e: pd.Series([_compile(a) and _compile(b) for a, b in zip(i, e, strict=True)]), "boolean")
    include, exclude = F.coalesce(got["include_url_patterns"], none), F.coalesce(got["exclude_url_patterns"], none)
    # An include pattern that nothing fits stands for patterns that can't be read.
    fits, never = readable(include, exclude), F.array(F.lit("(?!)"))
    return F.struct(
        normalize_rules(F.coalesce(got["rules"], F.array().cast("array<struct<selector:string,role:string,reason:string>>"))).alias("rules"), F.when(fits, include).otherwise(never).alias("include"), F.when(fits, exclude).otherwise(none).alias("exclude"),
        F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(got["warnings"], none).alias("warnings"),
    )


def _asked(samples: DataFrame, keys: list[str], model, task: str) -> DataFrame:
    """(keys, url, rule_set, error): the model's rules for each layout of samples (keys, url, html, version, and previous rules and failures as JSON)."""
    from quarryline.operators.capture import complete

    words = F.to_json(F.struct("layout_id", "version", "previous_rules", "failures", F.col("url"), H.skeleton_col(F.col("html")).alias("html_excerpt")))
    asked = samples.withColumn("prompt", F.concat(F.lit(f"{task}\nReply with one JSON object.\nData:\n"), words))
    return complete(asked, model).select(*keys, "url", "version", rule_set(F.col("reply")).alias("rule_set"), "error")


def scrape(pages: DataFrame, model, state: DataFrame | None = None, pos: str = "page_id", scope: tuple[str, ...] = (), least: int = LEAST_CHARS, revisions: int = REVISIONS, scaffolds: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Each page's text by its layout's rules, which a model learns once and revises where they fail; and the layouts' rules by version.

    pages: (scope.., pos, url, html), by pos in the order in which they come; a layout is one of its
    scope. model: a callable from prompt to JSON reply. state: what an earlier call gave; its layouts
    go on from there.

    The first page of an unknown layout asks the model for rules. A page whose text is shorter than
    `least` or holds boilerplate asks for new ones, at most `revisions` times a layout, is tried again
    with them, and leaves them to the pages after it. So a layout's pages before the first that fails
    keep version 0, those from it on are tried with version 1, and so on: each version is one pass
    over the pages from its first failing one on, and all layouts are revised at once. A page that
    still fails falls back to its readable part, then to the selectors of its site (scaffolds: (domain,
    content selector, section selector), the first that the address holds), else is an error.

    Gives (scope.., pos, url, layout_id, method, content, links, rule_version, reason), method being
    rules, readability, scaffold or error, and (scope.., layout_id, version, url, rule_set, error), url
    being the page that asked. A model's failure gives no rules, and its error stays in the state. Null
    html is empty; equal pos are told apart by nothing, so pos must be a key of its scope.
    """
    from quarryline.sources.rounds import Rounds

    spark, keys, at = pages.sparkSession, [*scope, "layout_id"], [*scope, pos]
    tried, layouts = Rounds(spark, "scrape-pages"), Rounds(spark, "scrape-layouts")
    # Layouts by page, without the pages.
    of = Rounds(spark, "scrape-layout-of").put(fingerprint(pages).select(*at, "layout_id"))
    first = of.groupBy(*keys).agg(F.min(pos).alias("from"))
    known = None
    if state is not None:
        latest = state.groupBy(*keys).agg(F.max_by(F.struct("version", "url", "rule_set", "error"), "version").alias("s")).select(*keys, "s.*")
        known = latest.join(first.select(*keys), keys, "left_semi")
        first = first.join(known.select(*keys), keys, "left_anti")
    blank = F.lit(None).cast("string")
    samples = lambda which: pages.select(*at, "url", "html").join(which.withColumnRenamed("from", pos), at)
    learnt = _asked(samples(first).withColumns({"version": F.lit(0), "previous_rules": blank, "failures": blank}), keys, model, LEARN)
    learnt = learnt.withColumn("new", F.lit(True))
    current = layouts.put(learnt if known is None else learnt.unionByName(known.select(*keys, "url", "version", "rule_set", "error").withColumn("new", F.lit(False))))
    since, kept = None, []
    for turn in range(revisions + 1):
        todo = pages.join(of if since is None else of.join(since, keys).filter(F.col(pos) >= F.col("from")).drop("from"), at)
        todo = todo.join(current.select(*keys, "version", "rule_set"), keys)
        host = F.col("host") if "host" in pages.columns else None
        got = ruled(todo, F.transform("rule_set.rules", lambda r: F.struct(r["selector"].alias("selector"), r["role"].alias("role"))), F.col("rule_set.include"), F.col("rule_set.exclude"), host)
        failures = validation_failures(F.col("by_rules.text"), least)
        rows = tried.put(got.select(*at, "url", "layout_id", "version", F.col("by_rules.text").alias("text"), F.col("by_rules.links").alias("links"), failures.alias("failures")))
        failing = rows.filter((F.size("failures") > 0) & (F.col("version") < revisions)).groupBy(*keys).agg(F.min(pos).alias("from"), F.min_by("failures", pos).alias("failures"))
        if turn == revisions or failing.isEmpty():
            kept.append(rows)
            break
        since = failing.select(*keys, "from")
        kept.append(rows.join(since, keys, "left").filter(F.col("from").isNull() | (F.col(pos) < F.col("from"))).drop("from"))
        before = current.select(*keys, F.col("version") + 1, F.to_json("rule_set.rules").alias("previous_rules")).toDF(*keys, "version", "previous_rules")
        asks = samples(failing.withColumn("failures", F.to_json("failures")).join(before, keys))
        current = layouts.put(_asked(asks, keys, model, REVISE).withColumn("new", F.lit(True)))
        since = Rounds(spark, "scrape-since").put(since)
    done = kept[0]
    for rows in kept[1:]:
        done = done.unionByName(rows)
    good, bad = done.filter(F.size("failures") == 0), done.filter(F.size("failures") > 0)
    # Only pages that failed are read again.
    again = pages.select(*at, "html").join(bad, at).withColumn("readable", H.clean_html_col(F.col("html")))
    long = lambda c: F.length(strip(F.coalesce(F.col(c), F.lit("")))) >= least
    fits = F.lit(False)
    special = F.lit(None).cast("string")
    for domain, content, parts in reversed(scaffolds):
        here = F.contains(F.col("url"), F.lit(domain))
        fits, special = fits | here, F.when(here, H.clean_html_col(F.when(here & ~long("readable"), F.col("html")), content, parts)).otherwise(special)
    again = again.withColumns({"special": special, "fits": fits})
    method = F.when(long("readable"), "readability").when(F.col("fits") & long("special"), "scaffold").otherwise("error")
    again = again.withColumn("method", method)
    reason = F.when(F.col("method") != "error", "").when(F.col("fits"), "all_extraction_methods_failed").otherwise("no_domain_specific_fallback")
    none = F.array().cast("array<struct<url:string,text:string>>")
    columns = [*at, "url", "layout_id", "method", "content", "links", "rule_version", "reason"]
    content = F.when(F.col("method") == "readability", F.col("readable")).when(F.col("method") == "scaffold", F.col("special")).otherwise("")
    fallen = again.select(*at, "url", "layout_id", "method", content.alias("content"), none.alias("links"), (F.col("version") + 1).alias("rule_version"), reason.alias("reason"))
    fine = good.select(*at, "url", "layout_id", F.lit("rules").alias("method"), F.col("text").alias("content"), "links", (F.col("version") + 1).alias("rule_version"), F.lit("").alias("reason"))
    versions = layouts.all().filter("new").select(*keys, "version", "url", "rule_set", "error")
    return fine.unionByName(fallen).select(*columns), versions if state is None else state.unionByName(versions)


class Scraper:
    """A crawl's scraper: layouts of each site are learnt at one level and reused, or revised, at the next. `pages` and `layouts` hold what it has seen, once the crawl has ended."""

    def __init__(self, model, least: int = LEAST_CHARS, revisions: int = REVISIONS, scaffolds: tuple = ()):
        self._options = {"model": model, "least": least, "revisions": revisions, "scaffolds": scaffolds}
        self._rounds, self.layouts = None, None

    def __call__(self, level: DataFrame) -> DataFrame:
        from quarryline.sources.rounds import Rounds

        spark = level.sparkSession
        rows, versions = scrape(level, state=self.layouts, pos="place", scope=("site",), **self._options)
        self._rounds = self._rounds or Rounds(spark, "scraped")
        done = self._rounds.put(rows)
        self.layouts = Rounds(spark, "scraped-layouts").put(versions)
        return done.select("site", "url", F.transform("links", lambda l: l["url"]).alias("links"), F.col("reason").alias("page_error"))

    @property
    def pages(self) -> DataFrame:
        return self._rounds.all()
