"""Crawls over captured pages, many sites at once: a first-in-first-out queue for each site, taken by levels.

A site's queue is a table of (site, url, depth, place). All addresses of one depth stand before those
of the next, so a level is judged at once: how many pages an address finds visited before it is a
running count over its site's level. A site's queue and budget are bounded, and every window here is
over one site's queue. Each level is written before the next is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import blank
from quarryline.functions.urls import MAX_DEPTH, url_rejection
from quarryline.operators.policy import allowed_by, origin_of, robots_patterns
from quarryline.sources.rounds import Rounds

#: The most pages of a crawl, and how many times as many addresses its queue may take.
MAX_PAGES, QUEUE_FACTOR = 30, 4


def frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(node, depth) of the nodes within max_depth of a seed, by least depth. edges: (src, dst); seeds: (node). A round is one join with the last round's nodes alone."""
    seen = Rounds(edges.sparkSession, "frontier")
    last = seen.put(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        met = last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        last = seen.put(met.join(seen.all().select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
    return seen.all()


def _judged(level: DataFrame, sites: DataFrame, pages: DataFrame, robots: DataFrame | None, max_depth: int, max_pages: int) -> DataFrame:
    """The level with status and reason: what becomes of each address, taken by place while the site has pages left."""
    known = level.join(sites.select("site", "host", "visited"), "site").join(pages.withColumn("__there", F.lit(True)), "url", "left")
    if robots is None:
        known = known.withColumn("__may", F.lit(True))
    else:
        known = known.withColumn("__origin", origin_of(F.col("url"))).join(robots.select(F.col("origin").alias("__origin"), robots_patterns(F.col("rules")).alias("__rules")), "__origin", "left")
        known = known.withColumn("__may", allowed_by(F.col("url"), F.col("__rules"))).drop("__rules", "__origin")
    # Judged once, below the window, and not again wherever a reason asks for it.
    known = known.withColumn("__rejected", url_rejection(F.col("url"), F.col("host"), F.col("depth"), max_depth))
    rejected, taken = F.col("__rejected"), (F.col("__rejected") == "") & F.col("__may")
    before = Window.partitionBy("site").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    had = F.col("visited") + F.coalesce(F.sum(taken.cast("long")).over(before), F.lit(0))
    fault = F.when(F.col("__there").isNull(), "not captured").otherwise(F.nullif(blank(F.col("fetch_error")), F.lit("")))
    seed = F.col("depth") == 0
    reason = (
        F.when(had >= max_pages, "max_pages_reached").when(rejected != "", rejected).when(~F.col("__may"), "robots_disallowed")
        .when(fault.isNotNull(), F.concat(F.when(seed, "fetch_error: ").otherwise("processing_error: "), fault))
        .when(seed & F.coalesce("is_pdf", F.lit(False)), "seed_page_is_pdf").when(blank(F.col("page_error")) != "", F.col("page_error")).otherwise("")
    )
    status = F.when(reason == "", "visited").when(had >= max_pages, "skipped").when(taken, "failed").otherwise("skipped")
    # A page that was fetched counts as visited, whatever became of its text; a seed that wasn't ends its crawl.
    counted = taken & (had < max_pages) & ~(seed & (fault.isNotNull() | F.coalesce("is_pdf", F.lit(False))))
    return known.withColumns({"status": status, "reason": reason, "counted": counted}).drop("__there", "__may", "__rejected", "host", "visited")


def _admitted(links: DataFrame, queued: DataFrame, sites: DataFrame, cap: int) -> DataFrame:
    """(site, url, place) of new addresses, in order of discovery, as long as the site's queue has room. links: (site, url, at), at telling the order."""
    new = links.groupBy("site", "url").agg(F.min("at").alias("at")).join(queued.select("site", "url"), ["site", "url"], "left_anti")
    nth = new.withColumn("nth", F.row_number().over(Window.partitionBy("site").orderBy("at", "url"))).filter(F.col("nth") <= cap)
    return nth.join(sites.select("site", "size"), "site").filter(F.col("size") + F.col("nth") <= cap).select("site", "url", (F.col("size") + F.col("nth") - 1).alias("place"))


def crawl(seeds: DataFrame, pages: DataFrame, robots: DataFrame | None = None, scrape: Callable[[DataFrame], DataFrame] | None = None, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES) -> DataFrame:
    """(site, url, depth, place, status, reason) of every address that a site's queue took, as a queue of its own would have met them.

    seeds: (site, url, host, selected array<string>), a row for each site, selected being the addresses
    of the seed's navigation that are queued before its other links. pages: what fetching an address
    gives: (url, links array<string>, fetch_error, page_error, is_pdf), a row for each; an address
    without a row can't be fetched. robots: (origin, rules), as policy.robots_rules gives; None allows
    all. scrape: called with each level's fetched pages (site, url, place and pages' other columns), to
    give (site, url, links, page_error): a scraper whose rules depend on the pages before.

    status is visited, failed (fetched, or tried, without use) or skipped, by reason. Only visited
    pages are expanded, and not at max_depth; failed ones count towards max_pages but for a seed that
    can't be fetched or is a PDF, which ends its crawl; robots and rejected addresses cost nothing. A
    queue takes QUEUE_FACTOR times max_pages addresses at most. Blank links, and seeds without an
    address, are no addresses; a null selection is none; repeated links count where they come first.
    """
    spark, cap = seeds.sparkSession, QUEUE_FACTOR * max_pages
    queue, ledger = Rounds(spark, "crawl-queue"), Rounds(spark, "crawl-sites")
    for name, kind in (("fetch_error", "string"), ("page_error", "string"), ("is_pdf", "boolean"), ("links", "array<string>")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    fates = pages.select("url", "fetch_error", "page_error", "is_pdf")
    started = seeds.filter(blank(F.col("url")) != "")
    chosen = F.array_distinct(F.filter(F.coalesce("selected", F.array().cast("array<string>")), lambda u: (blank(u) != "") & (u != F.col("url"))))
    sites = ledger.put(started.select("site", "host", chosen.alias("selected"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("visited")))
    level = started.select("site", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"))
    for depth in range(max_depth + 1):
        # Only what judges an address goes through the level's windows; links and texts meet the addresses that are taken, after.
        judged = _judged(level, sites, fates, robots, max_depth, max_pages)
        told = ["site", "url", "depth", "place", "status", "reason", "counted"]
        expanded = (F.col("status") == "visited") & (F.col("depth") < max_depth)
        if scrape is None:
            done = queue.put(judged.select(*told))
            linked = None if depth == max_depth else done.filter(expanded).select("site", "url", "place").join(pages.select("url", "links"), "url")
        else:
            judged = Rounds(spark, "crawl-judged").put(judged.select(*told))
            # Written before it is scraped, for the scraper may read it more than once.
            took = judged.filter("status = 'visited'").select("url", "site", "depth", "place").join(pages.drop("links", "page_error", "fetch_error", "is_pdf"), "url")
            seen = scrape(Rounds(spark, "crawl-fetched").put(took)).select("site", "url", "links", blank(F.col("page_error")).alias("__error"))
            judged = judged.join(seen, ["site", "url"], "left").withColumn("reason", F.when(F.coalesce("__error", F.lit("")) != "", F.col("__error")).otherwise(F.col("reason")))
            judged = judged.withColumn("status", F.when((F.col("status") == "visited") & (F.col("reason") != ""), "failed").otherwise(F.col("status")))
            # Links of pages that are expanded stay with them; other rows keep none.
            done = queue.put(judged.select(*told, F.when(expanded, F.col("links")).alias("links")))
            linked = done.filter("links is not null")
        if depth == max_depth:
            break
        spent = done.groupBy("site").agg(F.sum(F.col("counted").cast("long")).alias("spent"))
        sites = sites.join(spent, "site", "left").withColumn("visited", F.col("visited") + F.coalesce("spent", F.lit(0))).drop("spent")
        links = linked.select("site", "place", F.posexplode("links").alias("nth", "url")).select("site", "url", F.struct("place", "nth").alias("at")).filter(blank(F.col("url")) != "")
        queued = queue.all().select("site", "url")
        if depth == 0:
            # Sites whose seed was fetched go on with what was selected on it.
            on = done.filter("counted").select("site")
            first = sites.join(on, "site", "left_semi").select("site", F.posexplode("selected").alias("nth", "url")).select("site", "url", (F.col("nth") + 1).cast("long").alias("place"))
            queued = queued.unionByName(first.select("site", "url"))
            sites = sites.withColumn("size", F.lit(1) + F.size("selected").cast("long"))
        new = _admitted(links, queued, sites, cap)
        if depth == 0:
            new = first.unionByName(new)
        level = Rounds(spark, "crawl-level").put(new.withColumn("depth", F.lit(depth + 1)).select("site", "url", "depth", "place"))
        grown = level.groupBy("site").agg((F.max("place") + 1).alias("grown"))
        sites = ledger.put(sites.join(grown, "site", "left").withColumn("size", F.coalesce("grown", "size")))
    return queue.all().select("site", "url", "depth", "place", "status", "reason")


def crawl_results(crawled: DataFrame, pages: DataFrame | None = None, layouts: DataFrame | None = None) -> DataFrame:
    """(site, result): a JSON object for each site: visited_urls, skipped_urls, failed_urls with reasons, extracted_pages, learned_layouts, all in order of the queue.

    pages: (site, url, page struct), layouts: (site, layout struct), what a scraper has kept. A site's
    queue is bounded, and so is its object.
    """
    told = lambda status: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("place", "url", "reason")))), lambda r: F.struct(r["url"].alias("url"), r["reason"].alias("reason")))
    # A page without text was visited all the same: its failure has no prefix of fetching.
    was = (F.col("status") == "visited") | ((F.col("status") == "failed") & ~F.col("reason").rlike("^(fetch_error|processing_error): |^seed_page_is_pdf$"))
    visited = F.transform(F.array_sort(F.collect_list(F.when(was, F.struct("place", "url")))), lambda r: r["url"])
    # The seed, which stands at place 0, may be the last visited of an empty crawl; unvisited rest stands last.
    out = crawled.groupBy("site").agg(visited.alias("visited_urls"), told("skipped").alias("skipped_urls"), told("failed").alias("failed_urls"))
    none = F.array().cast("array<string>")
    if pages is not None:
        at = crawled.select("site", "url", "place").join(pages, ["site", "url"]).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page"))), lambda p: p["page"]).alias("extracted_pages"))
        out = out.join(at, "site", "left")
    else:
        out = out.withColumn("extracted_pages", none)
    if layouts is not None:
        out = out.join(layouts.groupBy("site").agg(F.array_sort(F.collect_list("layout")).alias("learned_layouts")), "site", "left")
    else:
        out = out.withColumn("learned_layouts", none)
    names = ("visited_urls", "skipped_urls", "failed_urls", "extracted_pages", "learned_layouts")
    return out.select("site", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("result"))


def choose_links(offered: Column, reply: Column) -> Column:
    """Of offered addresses (an array), in their order, those that a model's reply names (JSON with selected_urls); all of them if the reply is null, no JSON object, or has no such list: a failing model drops no links."""
    picked = F.from_json(reply, "selected_urls array<string>")["selected_urls"]
    committed = F.array_contains(F.json_object_keys(reply), "selected_urls") & picked.isNotNull()
    return F.when(F.coalesce(committed, F.lit(False)), F.array_intersect(offered, picked)).otherwise(F.array_distinct(offered))


def offered_only(selected: DataFrame, offered: DataFrame, committed: bool = True) -> DataFrame:
    """The offered addresses that were selected, none for an empty selection; all offered ones if nobody committed to a selection (no reply, or one without)."""
    return offered.join(selected.select("url").distinct(), "url", "left_semi") if committed else offered


def first_seen(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Each key once, where it came first."""
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(pos).alias(pos))
