"""Queries of crawling, per-layout scraping, choices among resources and concept graphs, with their SQL.

The shops' link graph comes from `lineitem`: a supplier's page links to its parts' pages in order of
sale, a part's page to its suppliers'; each supplier is a site of its own, crawled from its page.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import concepts, crawl, layout, policy
from quarryline.plans.catalogue import _LAYOUT, _PLAIN_SQL
from quarryline.plans.register import query, t
from quarryline.sources.rounds import Rounds
from quarryline.streaming import rotation

#: The shop's robots file, and its rules in SQL for a path `/p/<number>`.
ROBOTS = "User-agent: Other\nDisallow: /\n\nUser-agent: *  # everyone\nAllow: /p/70\nDisallow: /p/7\nDisallow: /p/*5$\n"
_SUPPLIER, _PART = "'http://shop.example/s/' || {}", "CASE WHEN {0} % 17 = 0 THEN 'http://shop.example/action/' || {0} WHEN {0} % 19 = 1 THEN 'http://other.example/p/' || {0} ELSE 'http://shop.example/p/' || {0} END"


def _shop(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(seeds, pages, robots rules)."""
    # A link counts where it comes first, so each is told once; pages are made once, for each level of a crawl reads them.
    first = t(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min(F.expr("l_orderkey * 10 + l_linenumber")).alias("n"))
    li = first.select("n", "l_suppkey", "l_partkey", F.expr(_SUPPLIER.format("l_suppkey")).alias("s"), F.expr(_PART.format("l_partkey")).alias("p"))
    linked = lambda dst: F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(dst).alias("to")))), lambda x: x["to"]).alias("links")
    blank = F.lit(None).cast("string")
    shops = li.groupBy(F.col("s").alias("url"), F.col("l_suppkey").alias("k")).agg(linked("p"))
    goods = li.groupBy(F.col("p").alias("url"), F.col("l_partkey").alias("k")).agg(linked("s"))
    made = shops.select("url", "links", blank.alias("fetch_error"), blank.alias("page_error"), (F.col("k") % 10 == 3).alias("is_pdf"), F.col("k").alias("site")).unionByName(
        goods.select("url", "links", F.when(F.col("k") % 11 == 5, "HTTP 500").alias("fetch_error"), F.when(F.col("k") % 13 == 6, "all_extraction_methods_failed").alias("page_error"), F.lit(False).alias("is_pdf"), F.lit(None).cast("long").alias("site"))
    )
    kept = Rounds(spark, "shop-pages").put(made)
    pages = kept.drop("site")
    selected = [f"http://shop.example/p/{i}" for i in (4, 3)]
    seeds = kept.filter("site is not null").select("site", "url", F.lit("shop.example").alias("host"), F.array(*map(F.lit, selected)).alias("selected"))
    robots = policy.robots_rules(spark.createDataFrame([("http://shop.example", ROBOTS)], "origin string, text string"), "research/1.0")
    return seeds, pages, robots


_CRAWL_SQL = f"""WITH RECURSIVE li AS (SELECT {_SUPPLIER.format("l_suppkey")} AS s, {_PART.format("l_partkey")} AS p, l_suppkey AS sk, l_partkey AS pk, l_orderkey * 10 + l_linenumber AS n FROM lineitem),
  sl AS (SELECT s, sk, p, min(n) AS n FROM li GROUP BY ALL), pl AS (SELECT p, pk, s, min(n) AS n FROM li GROUP BY ALL),
  pages AS (SELECT s AS url, list(p ORDER BY n, p) AS links, NULL::VARCHAR AS fe, NULL::VARCHAR AS pe, sk % 10 = 3 AS pdf FROM sl GROUP BY s, sk
    UNION ALL SELECT p, list(s ORDER BY n, s), CASE WHEN pk % 11 = 5 THEN 'HTTP 500' END, CASE WHEN pk % 13 = 6 THEN 'all_extraction_methods_failed' END, false FROM pl GROUP BY p, pk),
  r AS (SELECT DISTINCT sk AS site, [s] AS urls, [0] AS depths, 0 AS i, 0 AS visited, '' AS status, '' AS reason FROM li
    UNION ALL SELECT site, urls || selected || new, depths || list_transform(selected || new, lambda x: d + 1), i, visited + counted, CASE WHEN reason = '' THEN 'visited' WHEN counted = 1 OR broken THEN 'failed' ELSE 'skipped' END, reason
    FROM (SELECT *, CASE WHEN reason = '' AND d < 2 THEN list_filter(links, lambda x: NOT list_contains(urls || selected, x))[1:greatest(0, 120 - len(urls) - len(selected))] ELSE []::VARCHAR[] END AS new
    FROM (SELECT *, CASE WHEN i = 1 AND counted = 1 THEN ['http://shop.example/p/4', 'http://shop.example/p/3'] ELSE []::VARCHAR[] END AS selected
    FROM (SELECT *, (open AND rejection = '' AND may AND NOT broken)::INT AS counted,
      CASE WHEN NOT open THEN 'max_pages_reached' WHEN rejection <> '' THEN rejection WHEN NOT may THEN 'robots_disallowed' WHEN fault IS NOT NULL THEN (CASE WHEN d = 0 THEN 'fetch_error: ' ELSE 'processing_error: ' END) || fault
      WHEN d = 0 AND pdf THEN 'seed_page_is_pdf' ELSE coalesce(pe, '') END AS reason
    FROM (SELECT *, open AND rejection = '' AND may AND d = 0 AND (fault IS NOT NULL OR coalesce(pdf, false)) AS broken
    FROM (SELECT r.site, r.urls, r.depths, r.i + 1 AS i, r.visited, r.depths[r.i + 1] AS d, r.visited < 30 AS open, pages.links, pages.pe, pages.pdf, CASE WHEN pages.url IS NULL THEN 'not captured' ELSE pages.fe END AS fault,
      CASE WHEN NOT contains(r.urls[r.i + 1], '//shop.example/') THEN 'different_domain' WHEN contains(r.urls[r.i + 1], '/action/') THEN 'unsafe_or_account_url' ELSE '' END AS rejection,
      contains(r.urls[r.i + 1], '/p/70') OR NOT (contains(r.urls[r.i + 1], '/p/7') OR (contains(r.urls[r.i + 1], '/p/') AND ends_with(r.urls[r.i + 1], '5'))) AS may
    FROM r LEFT JOIN pages ON pages.url = r.urls[r.i + 1] WHERE r.i < len(r.urls)))))))
  SELECT site, urls[i] AS url, depths[i] AS depth, i - 1 AS place, status, reason FROM r WHERE i > 0"""


@query(_CRAWL_SQL)
def crawl_queue(spark, sf):
    """Each supplier's site, crawled first in, first out, with robots, failures, budgets and caps."""
    return crawl.crawl(*_shop(spark, sf))


@query(f"""{_CRAWL_SQL[:_CRAWL_SQL.rindex("SELECT site, urls[i]")]}
  SELECT status, reason, count(*) AS n, count(DISTINCT site) AS sites FROM r WHERE i > 0 GROUP BY ALL""")
def crawl_outcomes(spark, sf):
    """How often addresses end in each way."""
    return crawl.crawl(*_shop(spark, sf)).groupBy("status", "reason").agg(F.count("*").alias("n"), F.count_distinct("site").alias("sites"))


#: Selectors that the stand-in for a model gives a layout at each version: ids that end in 0 to 7 start with headings, which are always too short, others with adverts, of which some are.
VERSIONS = (("h1", ".ad", "article"), (".ad", "h1", "article"))


def rules_by_version(prompt: str) -> str:
    """A stand-in for a model that learns and revises rules: what it gives depends on the layout and version alone."""
    data = json.loads(prompt.split("Data:\n", 1)[1])
    selectors = VERSIONS[data["layout_id"][-1] > "7"]
    return json.dumps({"rules": [{"selector": selectors[data["version"]], "role": "extract_only"}], "confidence": 0.9})


_FAILS = "length(trim({0})) < 80 OR regexp_matches(lower({0}), 'cookie|all rights reserved|skip to content|privacy policy')"
_TEXT = "trim(regexp_replace(" + _PLAIN_SQL.format("regexp_replace(regexp_extract(html, '{}(.*?){}', 1, 's'), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
_SCRAPE_SQL = f"""WITH x AS (SELECT page_id, {_LAYOUT} AS layout_id, {_TEXT.format('<h1>', '</h1>')} AS h, {_TEXT.format('<div class="ad">', '</div>')} AS ad, {_TEXT.format('<article>', '</article>')} AS body FROM pages),
  f AS (SELECT *, {_FAILS.format('h')} AS fh, {_FAILS.format('ad')} AS fa, {_FAILS.format('body')} AS fb, layout_id[-1] <= '7' AS heads FROM x),
  v AS (SELECT *, CASE WHEN heads THEN fh ELSE fa END AS f0, CASE WHEN heads THEN fa ELSE fh END AS f1 FROM f),
  a AS (SELECT *, min(page_id) FILTER (f0) OVER (PARTITION BY layout_id) AS p1 FROM v),
  b AS (SELECT *, min(page_id) FILTER (f1 AND page_id >= p1) OVER (PARTITION BY layout_id) AS p2 FROM a),
  c AS (SELECT *, 1 + (page_id >= coalesce(p1, 9e18))::INT + (page_id >= coalesce(p2, 9e18))::INT AS rule_version FROM b),
  d AS (SELECT *, CASE rule_version WHEN 1 THEN f0 WHEN 2 THEN f1 ELSE fb END AS bad FROM c)
  SELECT page_id, layout_id, rule_version, CASE WHEN NOT bad THEN 'rules' WHEN length(body) >= 80 THEN 'readability' ELSE 'error' END AS method FROM d"""


@query(_SCRAPE_SQL)
def scrape_revisions(spark, sf):
    """How each page was read, and with which version of its layout's rules."""
    rows, _ = layout.scrape(t(spark, sf, "pages"), rules_by_version)
    return rows.select("page_id", "layout_id", "rule_version", "method")


@query()
def scrape_pages(spark, sf):
    """What each page gave, by rules that were learnt and revised."""
    rows, _ = layout.scrape(t(spark, sf, "pages"), rules_by_version)
    return rows.select("page_id", "url", "layout_id", "method", "content", F.size("links").alias("n_links"), "rule_version", "reason")


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id % 10 AS key, epoch_us(ts) AS t, CASE WHEN event_id % 5 = 0 THEN event_id % 3 + 1 END AS ban, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i FROM events),
  r AS (SELECT DISTINCT key, 0::BIGINT AS i, NULL::BIGINT AS event_id, [-9e18, -9e18, -9e18]::DOUBLE[] AS last, [0, 0, 0]::BIGINT[] AS rests, []::STRUCT(j INT, t BIGINT)[] AS recent, NULL::INT AS chosen FROM e
    UNION ALL SELECT key, i, event_id, CASE WHEN c IS NULL THEN last ELSE list_transform(last, lambda x, j: CASE WHEN j = c THEN t ELSE x END) END,
      CASE WHEN ban IS NULL THEN rests ELSE list_transform(rests, lambda x, j: CASE WHEN j = ban THEN t + 7200000000 ELSE x END) END,
      CASE WHEN c IS NULL THEN recent ELSE list_append(recent, {'j': c, 't': t}) END, c
    FROM (SELECT *, CASE WHEN ban IS NOT NULL OR len(awake) = 0 THEN NULL WHEN len(free) > 0 THEN list_sort(list_transform(free, lambda j: {'x': last[j], 'j': j}))[1].j
        ELSE list_sort(list_transform(awake, lambda j: {'x': list_min(list_transform(list_filter(recent, lambda u: u.j = j), lambda u: u.t)), 'j': j}))[1].j END::INT AS c
      FROM (SELECT *, list_filter(awake, lambda j: len(list_filter(recent, lambda u: u.j = j)) < 2) AS free
        FROM (SELECT r.key, e.i, e.event_id, r.last, r.rests, e.ban, e.t, list_filter(r.recent, lambda u: u.t > e.t - 28800000000) AS recent, list_filter([1, 2, 3], lambda j: e.t >= r.rests[j]) AS awake FROM r JOIN e ON e.key = r.key AND e.i = r.i + 1))))
  SELECT event_id, ['a', 'b', 'c'][chosen] AS chosen FROM r WHERE i > 0""")
def lru_choice(spark, sf):
    """Which of three resources serves each event, least recently used first, with budgets of two uses in eight hours and rests of two hours after every fifth event's ban."""
    e = t(spark, sf, "events")
    names = ["a", "b", "c"]
    banned = F.when(F.col("event_id") % 5 == 0, F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 3).cast("int")))
    rows = e.select((F.col("user_id") % 10).alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("pos"), banned.alias("resource"))
    return rotation.choose(rows, names, uses=2, seconds=8 * 3600, cooldown=2 * 3600).select(F.col("pos").alias("event_id"), "chosen")


#: The words of a conversation are its tags.
_TAGS_SQL = "tags AS (SELECT DISTINCT conv_id AS node, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tag FROM conversations)"
_NEAR_SQL = f"""{_TAGS_SQL}, n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), w AS (SELECT tag, ln(1 + n / count(*)) AS w FROM tags, n GROUP BY tag, n),
  s AS (SELECT node, sum(w) AS total FROM tags JOIN w USING (tag) GROUP BY 1),
  c AS (SELECT x.node AS a, y.node AS b, sum(w) AS common FROM tags x JOIN tags y ON x.tag = y.tag AND x.node < y.node JOIN w ON w.tag = x.tag GROUP BY ALL),
  e AS (SELECT a, b, common / (p.total + q.total - common) AS weight FROM c JOIN s p ON p.node = a JOIN s q ON q.node = b WHERE common / (p.total + q.total - common) >= 0.05 - 1e-9)"""


def _tagged_conversations(spark, sf) -> DataFrame:
    return t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("node")).agg(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))))).alias("tags"))


@query(f"WITH {_NEAR_SQL} SELECT a, b, round(weight, 6) AS weight FROM e")
def concept_pairs(spark, sf):
    """Extension: conversations by weighted overlap of their words."""
    return concepts.near_pairs(_tagged_conversations(spark, sf), 0.05).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_NEAR_SQL}, d AS (SELECT a AS x, b AS y, weight FROM e UNION ALL SELECT b, a, weight FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(weight, 9) DESC, y) AS nth FROM d)
  SELECT least(x, y) AS a, greatest(x, y) AS b FROM k WHERE nth <= 5 GROUP BY 1, 2 HAVING count(*) = 2""")
def concept_graph(spark, sf):
    """Extension: of those pairs, the mutually nearest."""
    return concepts.mutual_pairs(_tagged_conversations(spark, sf), 0.05).select("a", "b")


@query()
def concept_rank(spark, sf):
    """Extension: conversations by their rank in that graph."""
    nodes = _tagged_conversations(spark, sf)
    return concepts.pagerank(nodes, concepts.mutual_pairs(nodes, 0.05))
