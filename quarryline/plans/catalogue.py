"""Every registered query of the engine's own operators, with its SQL.

The tables stand in for the engine's own: documents for crawled ones, `benchmark` and `part` for
records, `conversations` for sections, `events` for access signals and uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import html as H
from quarryline.functions import text as T
from quarryline.functions import urls as U
from quarryline.operators import capture, crawl, dictionary, findings, layout, policy, review, scoring, sections, setmatch
from quarryline.plans.register import QUERIES, SQL, query, t
from quarryline.sources.rounds import Rounds


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarryline.plans import crawling  # noqa: F401 - registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


#: Keywords that occur in the invented texts.
KEYWORDS = ((6, "license", "6.1"), (6, "rights", "6.2"), (6, "under", "6.3"), (7, "thing", "7.1"), (7, "attion", "7.2"))
_L = r"[^\p{L}\p{N}_]"
_KW_SQL = "(VALUES (0,6,'license','P6-I1'),(1,6,'rights','P6-I2'),(2,6,'under','P6-I3'),(3,7,'thing','P7-I1'),(4,7,'attion','P7-I2')) k(kw_pos,pillar,keyword,indicator)"
_HITS_SQL = f"""hits AS (SELECT d.doc_id, k.kw_pos, k.pillar, k.keyword, k.indicator, d.text, d.source,
  length(regexp_extract(d.text, '(?is)^(.*?(?:^|{_L}))' || k.keyword || '(?:{_L}|$)', 1)) + 1 AS start
  FROM documents d, {_KW_SQL} WHERE regexp_matches(d.text, '(?is)(?:^|{_L})' || k.keyword || '(?:{_L}|$)'))"""
_STRIP_SQL = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CLAUSE_SQL = f"""parts AS (SELECT *, list_extract(regexp_split_to_array(substr(text,1,start-1),'[.;\\n]'),-1) AS l,
  regexp_split_to_array(substr(text,start+length(keyword)),'[.;\\n]')[1] AS r, substr(text,start,length(keyword)) AS m FROM hits),
  clauses AS (SELECT *, {_STRIP_SQL.format("l||m||r")} AS c0 FROM parts),
  clause AS (SELECT *, CASE WHEN length(c0)>300 THEN {_STRIP_SQL.format("substr(c0, greatest(0,length(l)-150)+1, 300)")} ELSE c0 END AS snippet FROM clauses)"""
_URL_KEY_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({})),'^https?://',''),'^www\\.',''),'[?#].*$',''),'/+$','')"
_HOST_SQL = "regexp_replace(regexp_replace(lower(regexp_extract({}, '^[A-Za-z]+://([^/?#]*)', 1)), ':[0-9]*$', ''), '^www\\.', '')"


@query(f"SELECT page_id, {_URL_KEY_SQL.format('url')} AS url_key FROM pages")
def url_normalize_key(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url")).alias("url_key"))


@query("""WITH p AS (SELECT page_id, lower(regexp_extract(url,'^([A-Za-z]+)://',1)) s, lower(regexp_extract(url,'^[A-Za-z]+://([^/?#]*)',1)) h,
  regexp_replace(regexp_replace(regexp_extract(url,'^[A-Za-z]+://[^/?#]*([^?#]*)',1),'/{2,}','/','g'),'/+$','') path, regexp_extract(url,'\\?([^#]*)',1) q FROM pages),
  l AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(q,'&'), lambda x: x<>''), lambda x: {'k': split_part(x,'=',1), 'v': CASE WHEN contains(x,'=') THEN substr(x, strpos(x,'=')+1) ELSE '' END}), lambda x: NOT starts_with(lower(x.k),'utm_'))) a FROM p)
  SELECT page_id, s || '://' || regexp_replace(h, ':(80|443)$', '') || CASE WHEN path='' THEN '/' ELSE path END || CASE WHEN len(a)=0 THEN '' ELSE '?' || array_to_string(list_transform(a, lambda x: x.k || '=' || x.v),'&') END AS canonical FROM l""")
def url_canonicalize(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {_HOST_SQL.format('url')} AS host FROM pages")
def url_host(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"))


@query(f"""WITH s AS (SELECT min({_HOST_SQL.format('url')}) seed FROM pages)
  SELECT page_id, CASE WHEN {_HOST_SQL.format('url')} <> seed THEN 'different_domain' WHEN page_id % 4 > 2 THEN 'max_depth_exceeded'
  WHEN regexp_matches(url, '(?i)(?:^|[/_.?=&-])(login|logout|signin|signout|delete|remove|action|account|register|captcha)(?:$|[/_.?=&-])') THEN 'unsafe_or_account_url' ELSE '' END AS reason FROM pages, s""")
def url_rejection(spark, sf):
    p = t(spark, sf, "pages")
    seed = p.agg(F.min(U.host(F.col("url"))).alias("seed"))  # one row
    return p.join(F.broadcast(seed)).select("page_id", U.url_rejection(F.col("url"), F.col("seed"), F.col("page_id") % 4).alias("reason"))


@query("""WITH w AS (SELECT page_id, string_split(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url,'[?#].*$',''),'/+$',''),'([^/]*)$',1),'(?i)\\.(pdf|html?|aspx)$',''),'[-_]+',' ','g')),' ') a FROM pages)
  SELECT page_id, array_to_string(list_transform(a, lambda x: array_to_string(list_transform(regexp_extract_all(x,'[A-Za-z]+|[^A-Za-z]+'), lambda y: upper(y[1]) || lower(y[2:])),'')),' ') AS title FROM w""")
def slug_title_from_url(spark, sf):
    return t(spark, sf, "pages").select("page_id", T.title_from_url(F.col("url")).alias("title"))


#: Scaffold domains, first match by priority.
SCAFFOLDS = (("cheap-pills", 0), ("example.org", 1), ("blog.", 2), ("example.net", 3))


@query("""SELECT page_id, (SELECT arg_min(d, prio) FROM (VALUES ('cheap-pills',0),('example.org',1),('blog.',2),('example.net',3)) s(d,prio) WHERE contains(regexp_extract(url,'^[A-Za-z]+://([^/?#]*)',1), d)) AS scaffold FROM pages""")
def scaffold_lookup(spark, sf):
    pages = t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1).alias("netloc"))
    return dictionary.first_scaffold(pages, spark.createDataFrame(SCAFFOLDS, "pattern string, priority int"), "page_id")


@query("""WITH p AS (SELECT DISTINCT lower(regexp_extract(text,'[A-Za-z]{6,}')) AS pattern FROM documents), q AS (SELECT * FROM p WHERE pattern <> ''),
  d AS MATERIALIZED (SELECT doc_id, ' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]', ' ', 'g') || ' ' AS words FROM documents)
  SELECT doc_id, pattern, strpos(words, ' ' || pattern || ' ') AS start FROM d, q WHERE contains(words, ' ' || pattern || ' ')""")
def dictionary_findings(spark, sf):
    """Where documents hold any of a table of words: the first long one of each of them."""
    d = t(spark, sf, "documents").select("doc_id", "text")
    return dictionary.dictionary_join(d, d.select(F.lower(F.regexp_extract("text", "[A-Za-z]{6,}", 0)).alias("pattern")), "doc_id")


_BARE = "regexp_replace(regexp_replace(lower(html), '<!--.*?-->', '', 'gs'), '<(?:script|style)[^>]*>.*?</(?:script|style)\\s*>', '', 'gs')"
_TAGS = "list_sort(list_distinct(regexp_extract_all({}, '<({})[\\s/>]', 1)))"
_LAND, _HEAD = _TAGS.format(_BARE, "header|nav|main|article|aside|footer"), _TAGS.format(_BARE, "h[1-6]")
_CLASSES = f"list_sort(list_distinct(list_filter(flatten(list_transform(regexp_extract_all({_BARE}, '<[a-z][^>]*?\\sclass=[\"'']([^\"'']*)[\"'']', 1), lambda x: string_split(x,' '))), lambda x: x <> '')))"
_FP = f"'{{\"heading_levels\": [' || array_to_string(list_transform({_HEAD}, lambda x: '\"'||x||'\"'),', ') || '], \"landmarks\": [' || array_to_string(list_transform({_LAND}, lambda x: '\"'||x||'\"'),', ') || '], \"stable_classes\": [' || array_to_string(list_transform({_CLASSES}, lambda x: '\"'||x||'\"'),', ') || ']}}'"
_LAYOUT = f"'layout-' || substr(sha256({_FP}),1,12)"


@query(f"SELECT page_id, array_to_string({_LAND},'|') AS landmarks FROM pages")
def html_landmarks(spark, sf):
    return t(spark, sf, "pages").select("page_id", joined(H.tags_of(F.col("html"), layout.LANDMARKS)).alias("landmarks"))


@query(f"SELECT page_id, array_to_string({_HEAD},'|') AS headings FROM pages")
def html_heading_levels(spark, sf):
    return t(spark, sf, "pages").select("page_id", joined(H.tags_of(F.col("html"), layout.HEADINGS)).alias("headings"))


@query(f"SELECT page_id, array_to_string({_CLASSES},'|') AS classes FROM pages")
def stable_classes(spark, sf):
    return t(spark, sf, "pages").select("page_id", joined(layout.stable_classes(F.col("html"))).alias("classes"))


@query(f"SELECT page_id, {_LAYOUT} AS layout_id FROM pages")
def layout_fingerprint(spark, sf):
    return layout.fingerprint(t(spark, sf, "pages")).select("page_id", "layout_id")


@query(f"SELECT {_LAYOUT} AS layout_id, count(*) AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1")
def layout_learn_once(spark, sf):
    return layout.learn_once(t(spark, sf, "pages"))


@query("SELECT page_id, (contains(lower(html),'javascript is required') OR contains(lower(html),'enable javascript') OR (length(html)<500 AND contains(lower(html),'<script'))) AS headless FROM pages")
def headless_required(spark, sf):
    return t(spark, sf, "pages").select("page_id", layout.headless_required(F.col("html")).alias("headless"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html,'<nav>(.*?)</nav>',1,'s'),'href="([^"]*)"',1) a FROM pages),
  e AS (SELECT page_id, unnest(a) href, generate_subscripts(a,1) i FROM l) SELECT page_id, href, min(i) AS pos FROM e GROUP BY ALL""")
def nav_hrefs(spark, sf):
    found = F.regexp_extract_all(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1), F.lit('href="([^"]*)"'), 1)
    rows = t(spark, sf, "pages").select("page_id", F.posexplode(found).alias("i", "href"))
    return rows.groupBy("page_id", "href").agg((F.min("i") + 1).cast("long").alias("pos"))


#: An account page's address, and the text of markup.
_BLOCKED_SQL = "regexp_matches({}, '(?i)(?:^|[/_.?=&-])(login|logout|signin|signout|delete|remove|action|account|register|captcha)(?:$|[/_.?=&-])')"
_PLAIN_SQL = "replace(replace(replace(replace(replace({},'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#x27;',''''),'&amp;','&')"


@query(f"""WITH n AS (SELECT page_id, regexp_extract(url,'^[A-Za-z]+://[^/?#]*') origin, regexp_extract_all(regexp_extract(html,'<nav>(.*?)</nav>',1,'s'),'<a href="[^"]*">[^<]*</a>') a FROM pages),
  e AS (SELECT page_id, origin, unnest(a) l, generate_subscripts(a,1) i FROM n),
  u AS (SELECT page_id, i, lower(origin) || {_PLAIN_SQL.format("""regexp_extract(l,'href="([^"]*)"',1)""")} AS url, {_PLAIN_SQL.format("regexp_extract(l,'>([^<]*)</a>',1)")} AS text FROM e)
  SELECT page_id, url, arg_min(text, i) AS text FROM u WHERE NOT {_BLOCKED_SQL.format("url")} GROUP BY ALL""")
def nav_links(spark, sf):
    """Navigation links by the DOM: resolved, canonical, distinct, and such as may be followed."""
    return layout.navigation(t(spark, sf, "pages")).drop("pos")


@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html,'<h1>(.*?)</h1>',1,'s'),'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#x27;',''''),'&amp;','&'),'\\s+',' ','g')) AS h1 FROM pages")
def page_title_h1(spark, sf):
    h = F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        h = F.replace(h, F.lit(a), F.lit(b))
    return t(spark, sf, "pages").select("page_id", T.collapse(h).alias("h1"))


@query()
def clean_page_text(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.clean_html_col(F.col("html")).alias("text"))


@query()
def page_skeleton(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.skeleton_col(F.col("html")).alias("skeleton"))


@query()
def page_strip(spark, sf):
    return t(spark, sf, "pages").select("page_id", H.strip_html_col(F.col("html")).alias("markup"))


#: Rules that a model would have learnt for the pages' layout.
RULES = [{"selector": "nav, footer, .ad", "role": "ignore"}, {"selector": "article h1, article p", "role": "extract_only"}, {"selector": "article", "role": "crawl_only"}]


def _rules(rows=tuple(RULES)) -> Column:
    return F.array(*[F.struct(F.lit(r["selector"]).alias("selector"), F.lit(r["role"]).alias("role")) for r in rows])


@query()
def apply_layout_rules(spark, sf):
    got = layout.ruled(t(spark, sf, "pages"), _rules())
    return got.select("page_id", "by_rules.text", F.size("by_rules.links").alias("n_links"))


@query("""SELECT doc_id, CASE WHEN length(regexp_replace(text,'^\\s+|\\s+$','','g'))<80 THEN 'content_chars|' ELSE '' END || CASE WHEN contains(lower(text),'cookie') OR contains(lower(text),'all rights reserved') OR contains(lower(text),'skip to content') OR contains(lower(text),'privacy policy') THEN 'boilerplate' ELSE '' END AS failures FROM documents""")
def boilerplate_check(spark, sf):
    f = layout.validation_failures(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.concat(F.when(F.array_contains(f, "content_chars"), "content_chars|").otherwise(""), F.when(F.array_contains(f, "boilerplate"), "boilerplate").otherwise("")).alias("failures"))


@query("SELECT doc_id, CASE WHEN contains(lower(text),'license') OR contains(lower(text),'rights') THEN 'legal-priority' ELSE '' END AS tag FROM documents")
def keyword_relevance(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.when(layout.relevant(F.col("text"), ("License", "rights")), "legal-priority").otherwise("").alias("tag"))


@query("""SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split(text,chr(10)), lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')), lambda x: length(x)>=3)[1],1,300), 'Untitled Document') AS title FROM documents""")
def doc_title(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.derive_title(F.col("text"), F.lit("")).alias("title"))


def _docs(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.lit("").alias("url"), F.col("source").alias("economy"), "text", F.lit(False).alias("is_pdf"))


@query(f"WITH {_HITS_SQL} SELECT doc_id, kw_pos, pillar, keyword, indicator, start FROM hits")
def keyword_findings(spark, sf):
    return findings.keyword_hits(_docs(spark, sf), KEYWORDS).select(F.col("pos").alias("doc_id"), "kw_pos", "pillar", "keyword", "indicator", F.col("start").cast("long").alias("start"))


@query(f"WITH {_HITS_SQL}, {_CLAUSE_SQL} SELECT doc_id, kw_pos, snippet FROM clause")
def verbatim_clause(spark, sf):
    return findings.extract(_docs(spark, sf), KEYWORDS, sections=False).select(F.col("pos").alias("doc_id"), "kw_pos", F.col("verbatim_snippet").alias("snippet"))


#: Documents in which each number of up to four digits is the number of a section.
_NUMBERED_SQL = "documents AS (SELECT * REPLACE (regexp_replace(text, '([0-9]{1,4})', ' Section \\1 ', 'g') AS text) FROM documents)"
_REF = "'(?i)\\b(?:Section|Article|Art\\.?|s\\.)\\s*\\d+[A-Za-z]?\\b'"
_SECTION_SQL = f"""refs AS (SELECT doc_id, unnest(regexp_extract_all(text, {_REF})) AS ref, unnest(regexp_split_to_array(text, {_REF})[1:len(regexp_extract_all(text, {_REF}))]) AS gap, generate_subscripts(regexp_extract_all(text, {_REF}), 1) AS i FROM documents),
  places AS (SELECT doc_id, i, regexp_replace(ref, '\\s+', ' ', 'g') AS ref, 1 + sum(length(gap)) OVER w + coalesce(sum(length(ref)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM refs WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  near AS (SELECT h.doc_id, h.kw_pos, arg_min(ref, {{'far': abs(place - start), 'i': i}}) AS section FROM hits h JOIN places USING (doc_id) GROUP BY ALL)"""


def _numbered(spark, sf) -> DataFrame:
    return _docs(spark, sf).withColumn("text", F.regexp_replace("text", "([0-9]{1,4})", " Section $1 "))


@query(f"WITH {_NUMBERED_SQL}, {_HITS_SQL}, {_SECTION_SQL} SELECT h.doc_id, h.kw_pos, coalesce(section, '') AS section FROM hits h LEFT JOIN near n ON n.doc_id = h.doc_id AND n.kw_pos = h.kw_pos")
def nearest_sections(spark, sf):
    h = findings.keyword_hits(_numbered(spark, sf), KEYWORDS)
    return h.select(F.col("pos").alias("doc_id"), "kw_pos", findings.nearest_section(F.col("text"), F.col("start")).alias("section"))


def _golds(spark, sf) -> DataFrame:
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("pos"), F.lit("").alias("country"), F.lit(6).alias("pillar_id"), F.lit("6.1").alias("indicator_id"), F.substring_index("text", "\n", 1).alias("act_name"), F.array().cast("array<string>").alias("urls"))


def _tagged(spark, sf) -> DataFrame:
    """Findings with NEW or KNOWN against the benchmark's first lines as known acts. Texts are read once: findings are written, and each act is compared once."""
    f = Rounds(spark, "findings").put(findings.extract(_numbered(spark, sf), KEYWORDS))
    acts = f.select(F.col("title").alias("act_name"), F.col("pillar").alias("pillar_id"), F.col("indicator").alias("indicator_id")).distinct()
    items = acts.select(F.xxhash64("act_name", "pillar_id", "indicator_id").alias("pos"), F.lit("").alias("country"), "pillar_id", "indicator_id", "act_name", F.array().cast("array<string>").alias("urls"))
    new = scoring.novel(items, _golds(spark, sf)).select(F.col("act_name").alias("title"), F.col("indicator_id").alias("indicator")).distinct().withColumn("new", F.lit(True))
    return f.join(new, ["title", "indicator"], "left").withColumn("discovery_tag", F.when(F.col("new"), "NEW").otherwise("KNOWN")).drop("new")


_TOK = "list_filter(list_distinct(regexp_extract_all(lower({}),'[a-z0-9]+')), lambda x: NOT regexp_matches(x,'^(19|20)[0-9]{{2}}$'))"
_TITLE_SQL = "coalesce(substr(list_filter(list_transform(string_split(text,chr(10)), lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')), lambda x: length(x)>=3)[1],1,300), 'Untitled Document')"
_NEW_SQL = f"""titled AS (SELECT *, {_TITLE_SQL} AS title FROM clause), toks AS (SELECT DISTINCT title, pillar, {_TOK.format('title')} AS a FROM titled),
  gold AS (SELECT DISTINCT {_TOK.format("split_part(text,chr(10),1)")} AS b FROM benchmark),
  known AS (SELECT DISTINCT title, pillar FROM toks, gold WHERE pillar=6 AND len(a)>0 AND len(b)>0 AND len(list_intersect(a,b))/len(list_distinct(list_concat(a,b))) >= 0.6)"""


@query(f"""WITH {_NUMBERED_SQL}, {_HITS_SQL}, {_SECTION_SQL}, {_CLAUSE_SQL}, {_NEW_SQL} SELECT source AS "Economy", t.title AS "Law Name", '' AS "Law Number/Ref", '' AS "Last Amended", indicator AS "Indicator ID", coalesce(n.section, '') AS "Article / Section",
  CASE WHEN k.title IS NULL THEN 'NEW' ELSE 'KNOWN' END AS "Discovery Tag", '' AS "Location Ref.", snippet AS "Verbatim Snippet",
  'Matched keyword ''' || keyword || ''' in document text; mapped to indicator ' || indicator || ' by the deterministic mock keyword table.' AS "Mapping Rationale", '' AS "Source URL", '0.50' AS "Confidence", '' AS "Notes"
  FROM titled t LEFT JOIN known k ON k.title=t.title AND k.pillar=t.pillar LEFT JOIN near n ON n.doc_id=t.doc_id AND n.kw_pos=t.kw_pos""")
def emit_csv_rows(spark, sf):
    return findings.csv_rows(_tagged(spark, sf))


@query(f"""WITH {_NUMBERED_SQL}, {_HITS_SQL}, {_SECTION_SQL}, {_CLAUSE_SQL}, {_NEW_SQL} SELECT min(t.doc_id) AS law_pos, to_json({{'economy': source, 'law_name': t.title, 'source_pdf_path': NULL, 'ocr_quality_cer': NULL, 'processing_time': NULL, 'model_version': '',
  'provisions': list({{'indicator_id': indicator, 'article': coalesce(n.section, ''), 'verbatim': snippet, 'mapping_rationale': 'Matched keyword ''' || keyword || ''' in document text; mapped to indicator ' || indicator || ' by the deterministic mock keyword table.',
    'discovery_tag': CASE WHEN k.title IS NULL THEN 'NEW' ELSE 'KNOWN' END, 'source_url': '', 'confidence': 0.5::DOUBLE, 'raw_context': snippet}} ORDER BY t.doc_id, t.kw_pos)}})::VARCHAR AS law
  FROM titled t LEFT JOIN known k ON k.title=t.title AND k.pillar=t.pillar LEFT JOIN near n ON n.doc_id=t.doc_id AND n.kw_pos=t.kw_pos GROUP BY source, t.title""")
def emit_law_json(spark, sf):
    return findings.law_objects(_tagged(spark, sf))


@query(f"WITH {_HITS_SQL} SELECT doc_id, kw_pos, indicator FROM hits ORDER BY doc_id, kw_pos LIMIT 20")
def first_findings(spark, sf):
    return findings.first_rows(findings.keyword_hits(_docs(spark, sf), KEYWORDS), 20).select(F.col("pos").alias("doc_id"), "kw_pos", "indicator")


def _sections(spark, sf) -> DataFrame:
    heading = F.concat(F.col("role"), F.lit(" "), F.col("turn").cast("string"))
    return t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc"), F.col("turn").alias("pos")).agg(F.max(F.struct("role", "text")).alias("m")).select("doc", "pos", F.concat(F.col("m.role"), F.lit(" "), F.col("pos").cast("string")).alias("heading"), F.when(F.col("m.role") == "user", 1).otherwise(2).alias("level"), F.col("m.text").alias("text"))


_SECT_SQL = """sect AS (SELECT conv_id doc, turn pos, max({'r': role, 't': text}) m FROM conversations GROUP BY 1,2),
  s0 AS (SELECT doc, pos, m.r || ' ' || pos AS heading, CASE WHEN m.r='user' THEN 1 ELSE 2 END AS level, m.t AS text FROM sect),
  s1 AS (SELECT *, max(CASE WHEN level=1 THEN pos END) OVER (PARTITION BY doc ORDER BY pos) AS up FROM s0),
  crumb AS (SELECT s1.*, u.heading AS uh, CASE WHEN s1.level=1 OR u.heading IS NULL THEN s1.heading ELSE u.heading || '/' || s1.heading END AS trail FROM s1 LEFT JOIN s0 u ON u.doc=s1.doc AND u.pos=s1.up)"""


@query(f"WITH {_SECT_SQL} SELECT doc, pos, trail, lower(replace(trail,' ','-')) AS section_id FROM crumb")
def heading_breadcrumb(spark, sf):
    return sections.breadcrumbs(_sections(spark, sf)).select("doc", "pos", F.array_join("trail", "/").alias("trail"), "section_id")


@query(f"""WITH {_SECT_SQL} SELECT doc, lower(replace(trail,' ','-')) AS section_id, {_STRIP_SQL.format("coalesce(text,'')")} AS text, heading AS caption,
  array_to_string(list_sort(list_distinct(string_split(lower(replace(trail,' ','-')),'/'))),'|') AS tags FROM crumb""")
def structural_nodes(spark, sf):
    return sections.structural_nodes(_sections(spark, sf)).withColumn("tags", joined(F.col("tags")))


@query("SELECT conv_id AS doc, bool_or(length(regexp_replace(coalesce(text,''),'^\\s+|\\s+$','','g'))>0) AS valid FROM conversations GROUP BY 1")
def doc_validity(spark, sf):
    return t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.collect_list(T.blank(F.col("text"))).alias("texts")).select("doc", sections.is_valid(F.col("texts")).alias("valid"))


ALLOWED = ["alpha", "beta"]


def _results(spark, sf) -> DataFrame:
    """Tagging results made from the sections: every fifth of a kind."""
    s = sections.breadcrumbs(_sections(spark, sf))
    k = (F.col("doc") + F.col("pos")) % 5
    tag = F.when(k == 1, "gamma").otherwise("alpha")
    quote = F.when(k == 2, F.lit("no such quote at all")).otherwise(F.substring(T.strip(F.col("text")), 1, 5))
    return s.select("doc", F.col("pos"), F.when(k == 4, "nowhere").otherwise(F.col("section_id")).alias("section_id"), F.array(tag).alias("tags"), F.array(F.struct(tag.alias("tag"), quote.alias("quote"))).alias("evidence"), F.when(k == 3, 0.25).otherwise(0.9).alias("confidence"), F.lit("").alias("abstain_reason"))


_RES_SQL = f"""{_SECT_SQL}, ids AS (SELECT doc, pos, (doc+pos)%5 AS k, lower(replace(trail,' ','-')) AS section_id, heading, {_STRIP_SQL.format("coalesce(text,'')")} AS text FROM crumb),
  ok AS (SELECT *, k=0 AND length(trim(substr(text,1,5)))>0 AS good FROM ids)"""


@query(f"WITH {_RES_SQL} SELECT doc, section_id, text, heading AS caption, 'alpha' AS tags FROM ok WHERE good")
def reconcile_nodes(spark, sf):
    return sections.reconcile(_sections(spark, sf), _results(spark, sf), ALLOWED)[0].withColumn("tags", joined(F.col("tags")))


@query(f"""WITH {_RES_SQL} SELECT doc, CASE WHEN k=4 THEN 'nowhere' ELSE section_id END AS section_id,
  CASE k WHEN 1 THEN 'unknown-tags' WHEN 3 THEN 'low-confidence' WHEN 4 THEN 'unknown-section' ELSE 'unsupported-tag' END AS reason,
  CASE k WHEN 1 THEN 'Tags outside the allowed taxonomy: gamma.' WHEN 3 THEN 'Confidence 0.250 is below threshold 0.600.' WHEN 4 THEN 'Result references ''nowhere'', which does not map to a document section.'
  ELSE 'Tag ''alpha'' has no evidence quote present in the source section text.' END AS detail FROM ok WHERE NOT good""")
def review_items(spark, sf):
    return sections.reconcile(_sections(spark, sf), _results(spark, sf), ALLOWED)[1]


@query(f"WITH {_RES_SQL} SELECT doc, pos, section_id, CASE WHEN section_id='user-0' THEN 'alpha' ELSE 'alpha|beta' END AS allowed_tags FROM ids")
def tagging_tasks(spark, sf):
    hints = spark.createDataFrame([(0, "user-0", ["alpha", "zeta"]), (1, "user-0", ["beta"])], "pos int, section_id string, relevant_labels array<string>")
    return sections.tagging_tasks(_sections(spark, sf), hints, ALLOWED).select("doc", "pos", "section_id", joined(F.col("allowed_tags")).alias("allowed_tags"))


def _stored(spark, sf) -> DataFrame:
    return t(spark, sf, "events").groupBy(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("node_id")).agg(F.collect_set(F.concat("event_type", F.lit("-"), (F.col("event_id") % 7).cast("string"))).alias("tags")).withColumn("tags", F.filter(F.array_sort("tags"), lambda _, i: i % 3 == 0))


def _asked(spark, sf) -> DataFrame:
    return t(spark, sf, "events").groupBy(F.concat(F.lit("h"), F.floor(F.col("event_id") / 40).cast("string")).alias("doc_id")).agg(F.collect_set(F.concat("event_type", F.lit("-"), (F.col("event_id") % 7).cast("string"))).alias("tags"))


_SETS_SQL = """st0 AS (SELECT 'u' || (user_id%50) AS node_id, list_sort(list_distinct(list(event_type || '-' || (event_id%7)))) a FROM events GROUP BY 1),
  st AS (SELECT node_id, list_filter(a, lambda x, i: (i-1)%3=0) AS tags FROM st0),
  qs AS (SELECT 'h' || (event_id//40) AS doc_id, list_distinct(list(event_type || '-' || (event_id%7))) AS tags FROM events GROUP BY 1)"""


@query(f"WITH {_SETS_SQL} SELECT doc_id, node_id FROM st, qs WHERE list_has_all(qs.tags, st.tags)")
def subset_match(spark, sf):
    return setmatch.subsets(_stored(spark, sf), _asked(spark, sf))


@query(f"WITH {_SETS_SQL}, small AS (SELECT doc_id, list_sort(tags)[1:2] AS tags FROM qs) SELECT doc_id, node_id FROM st, small WHERE list_has_all(st.tags, small.tags)")
def superset_match(spark, sf):
    return setmatch.supersets(_stored(spark, sf), _asked(spark, sf).withColumn("tags", F.slice(F.array_sort("tags"), 1, 2)))


@query(f"WITH {_SETS_SQL}, f AS (SELECT tag, count(*) AS freq FROM (SELECT unnest(tags) tag FROM st) GROUP BY 1) SELECT tag, freq, row_number() OVER (ORDER BY freq, tag) AS rank FROM f")
def tag_rarity_rank(spark, sf):
    return setmatch.rarity_rank(_stored(spark, sf))


@query(f"""WITH {_SETS_SQL}, f AS (SELECT tag, count(*) AS freq FROM (SELECT unnest(tags) tag FROM st) GROUP BY 1), r AS (SELECT tag, row_number() OVER (ORDER BY freq, tag) AS rank FROM f),
  p AS (SELECT node_id, list_sort(list(rank)) AS path FROM (SELECT node_id, unnest(tags) tag FROM st) JOIN r USING(tag) GROUP BY 1),
  x AS (SELECT DISTINCT path[1:n] AS pre FROM p, (SELECT unnest(range(1,1000)) n) WHERE n<=len(path)) SELECT count(*)+1 AS n_nodes FROM x""")
def trie_node_count(spark, sf):
    return setmatch.prefix_count(_stored(spark, sf))


_TRIE_SQL = f"""{_SETS_SQL}, f AS (SELECT tag, count(*) AS freq FROM (SELECT unnest(tags) tag FROM st) GROUP BY 1), r AS (SELECT tag, row_number() OVER (ORDER BY freq, tag) AS rank FROM f),
  p AS (SELECT node_id, list_sort(list(rank)) AS path FROM (SELECT node_id, unnest(tags) tag FROM st) JOIN r USING(tag) GROUP BY 1),
  x AS MATERIALIZED (SELECT DISTINCT path[1:n] AS pre FROM p, (SELECT unnest(range(1,1000)) n) WHERE n<=len(path)),
  q AS MATERIALIZED (SELECT doc_id, list_sort(list(coalesce(rank, 999999))) AS need FROM (SELECT doc_id, unnest(tags) tag FROM qs) LEFT JOIN r USING(tag) GROUP BY 1)"""


@query(f"WITH {_TRIE_SQL} SELECT doc_id, 1 + count(x.pre) AS visited FROM q LEFT JOIN x ON list_has_all(need, pre) GROUP BY 1")
def subset_visits(spark, sf):
    return setmatch.visits(_stored(spark, sf), _asked(spark, sf))


@query(f"""WITH {_TRIE_SQL} SELECT doc_id, 1 + count(x.pre) AS visited FROM q LEFT JOIN x ON NOT list_has_all(pre[1:len(pre)-1], need) AND list_has_all(pre[1:len(pre)-1], list_filter(need, lambda n: n < pre[len(pre)])) GROUP BY 1""")
def superset_visits(spark, sf):
    return setmatch.visits(_stored(spark, sf), _asked(spark, sf), "superset")


def _parts(spark, sf, side: int) -> DataFrame:
    p = t(spark, sf, "part").filter(F.col("p_partkey") % 2 == side)
    return p.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.substring("p_type", 1, 1)).alias("country"), (6 + F.col("p_size") % 2).alias("pillar_id"), F.lit("6.1").alias("indicator_id"), F.concat("p_name", F.lit(" "), F.col("p_brand"), F.lit(" 1999")).alias("act_name"), F.array(F.concat(F.lit("http://www.x.org/"), (F.col("p_partkey") / 4).cast("int").cast("string"), F.lit("/?a=1"))).alias("urls"))


_PART_SQL = """pa AS (SELECT p_partkey pos, CASE WHEN p_partkey%5=0 THEN '' ELSE lower(substr(p_type,1,1)) END land, 6+p_size%2 pillar, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand),'[a-z0-9]+')) a, p_partkey//4 u, p_name || ' ' || p_brand || ' 1999' AS act FROM part),
  pairs AS (SELECT p.pos AS pred, g.pos AS gold, p.pillar AS pillar_id FROM pa p, pa g WHERE p.pos%2=0 AND g.pos%2=1 AND p.pillar=g.pillar AND (p.land='' OR g.land='' OR p.land=g.land)
  AND (p.u=g.u OR len(list_intersect(p.a,g.a))/len(list_distinct(list_concat(p.a,g.a)))>=0.6))"""


@query(f"WITH {_PART_SQL} SELECT pred, gold, pillar_id FROM pairs")
def match_pairs(spark, sf):
    return scoring.candidate_pairs(_parts(spark, sf, 0), _parts(spark, sf, 1))


@query(f"WITH {_PART_SQL} SELECT pillar_id, count(*) AS n_pairs, count(DISTINCT pred) AS n_preds FROM pairs GROUP BY 1")
def pillar_match_counts(spark, sf):
    return scoring.pair_counts(_parts(spark, sf, 0), _parts(spark, sf, 1))


@query("""WITH p AS (SELECT p_partkey k, p_brand b, list_distinct(regexp_extract_all(lower(p_name),'[a-z0-9]+')) a FROM part)
  SELECT x.k AS a, y.k AS b, len(list_intersect(x.a,y.a))/len(list_distinct(list_concat(x.a,y.a))) AS sim FROM p x JOIN p y ON x.b=y.b AND x.k<y.k WHERE len(list_intersect(x.a,y.a))/len(list_distinct(list_concat(x.a,y.a)))>=0.6""")
def act_similarity_pairs(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_brand", T.act_tokens(F.col("p_name")).alias("toks"))
    return scoring.similar_pairs(p.withColumnsRenamed({"k": "pos", "p_brand": "within"}))


@query(f"""WITH p AS (SELECT page_id, {_URL_KEY_SQL.format('url')} k FROM pages) SELECT k AS url_key, count(*) AS n_pages, min(page_id) AS first_page FROM p GROUP BY 1 HAVING count(*)>1""")
def url_overlap_groups(spark, sf):
    return t(spark, sf, "pages").groupBy(U.normalize_url(F.col("url")).alias("url_key")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page")).filter("n_pages > 1")


_GREEDY_SQL = f"""WITH RECURSIVE {_PART_SQL},
  e AS MATERIALIZED (SELECT pillar_id, list(gold ORDER BY gold) AS golds, row_number() OVER (PARTITION BY pillar_id ORDER BY pred) AS i FROM pairs GROUP BY pillar_id, pred),
  r AS (SELECT DISTINCT pillar AS pillar_id, 0::BIGINT AS i, []::BIGINT[] AS taken FROM pa
    UNION ALL SELECT pillar_id, i, CASE WHEN g IS NULL THEN taken ELSE list_append(taken, g) END FROM (SELECT r.pillar_id, e.i, r.taken, list_filter(e.golds, lambda x: NOT list_contains(r.taken, x))[1] AS g FROM r JOIN e ON e.pillar_id = r.pillar_id AND e.i = r.i + 1)),
  n AS (SELECT pillar AS pillar_id, count(*) FILTER (pos%2=0) AS p, count(*) FILTER (pos%2=1) AS g FROM pa GROUP BY 1),
  h AS (SELECT pillar_id, max(len(taken)) AS tp FROM r GROUP BY 1), m AS (SELECT n.pillar_id, p, g, tp FROM n JOIN h USING (pillar_id)),
  w AS (FROM m UNION ALL SELECT 0, sum(p), sum(g), sum(tp) FROM m),
  x AS (SELECT pillar_id, tp::BIGINT AS tp, (p-tp)::BIGINT AS fp, (g-tp)::BIGINT AS fn, CASE WHEN p=0 THEN 0.0 ELSE tp::DOUBLE/p END AS "precision", CASE WHEN g=0 THEN 0.0 ELSE tp::DOUBLE/g END AS recall FROM w)
  SELECT *, CASE WHEN "precision"+recall=0 THEN 0.0 ELSE 2*"precision"*recall/("precision"+recall) END AS f1 FROM x"""


@query(_GREEDY_SQL)
def greedy_f1(spark, sf):
    """Scores of each pillar, and of all as pillar 0."""
    return scoring.score(_parts(spark, sf, 0), _parts(spark, sf, 1)).na.fill(0, ["pillar_id"])


@query(f"WITH {_PART_SQL}, novel AS (SELECT act FROM pa WHERE pos%2=0 AND pos NOT IN (SELECT pred FROM pairs)) SELECT pos, CASE WHEN act IN (SELECT act FROM novel) THEN 'NEW' ELSE 'KNOWN' END AS discovery_tag FROM pa WHERE pos%2=0")
def discovery_tag(spark, sf):
    p = _parts(spark, sf, 0)
    return scoring.tag_discovery(p, scoring.novel(p, _parts(spark, sf, 1))).select("pos", "discovery_tag")


@query("SELECT l_orderkey, l_linenumber, 'P' || (6+l_linenumber%2) || '-I' || l_linenumber AS indicator, (6+l_linenumber%2) || '.' || l_linenumber AS db, 6+l_linenumber%2 AS pillar FROM lineitem")
def indicator_codes(spark, sf):
    code = F.concat((6 + F.col("l_linenumber") % 2).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.indicator(code).alias("indicator"), T.indicator_db(code).alias("db"), T.pillar_of(code).alias("pillar"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN NULL ELSE year(o_orderdate) || '-01-01' END AS amended FROM orders")
def last_amended_year(spark, sf):
    y = F.year("o_orderdate").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("amended in"), y)).otherwise(F.concat(F.lit("Since 1950, last amended on 1 February "), y, F.lit(".")))
    return t(spark, sf, "orders").select("o_orderkey", T.last_amended(text).cast("string").alias("amended"))


@query("""SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 'Singapore' WHEN 1 THEN 'Australia' WHEN 2 THEN 'Malaysia' ELSE NULL END AS country FROM customer""")
def country_alias(spark, sf):
    code = F.element_at(F.array(F.lit(" SG "), F.lit("aus"), F.lit("Malaysia"), F.lit("Atlantis")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t(spark, sf, "customer").select("c_custkey", T.resolve_country(code).alias("country"))


#: A reader that takes every e for another sign and every full stop for two: none of those has a partner in the text, so the edit distance is their number.
_CER_SQL = """x AS (SELECT doc_id, trim(regexp_replace(coalesce(text,''),'\\s+',' ','g'), ' ') AS r FROM documents),
  y AS (SELECT doc_id, CASE WHEN r='' THEN 0.0 ELSE length(regexp_replace(r,'[^e.]','','g'))::DOUBLE/length(r) END AS cer FROM x)"""


def _misread(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.col("text").alias("reference"), F.replace(F.translate("text", "e", "☃"), F.lit("."), F.lit("..")).alias("hypothesis"))


@query(f"WITH {_CER_SQL} SELECT doc_id, cer FROM y")
def cer_pairs(spark, sf):
    """Error rates of whole texts."""
    return review.error_rates(_misread(spark, sf)).select("doc_id", "cer")


@query(f"WITH {_CER_SQL} SELECT round(avg(cer),9) AS mean_cer, count(*) AS n, avg(cer)<0.05 AS passed FROM y")
def cer_report(spark, sf):
    return review.cer_report(_misread(spark, sf)).withColumn("mean_cer", F.round("mean_cer", 9))


@query("""WITH r AS (SELECT n_name country, 6+c_custkey%2 pillar, lower(trim(c_mktsegment)) act, c_custkey%9 u FROM customer JOIN nation ON c_nationkey=n_nationkey)
  SELECT coalesce(country,'TOTAL') AS country, count(*) FILTER (pillar=6) AS p6, count(*) FILTER (pillar=7) AS p7, count(DISTINCT act) AS acts, count(DISTINCT u) AS urls FROM r GROUP BY ROLLUP(country)""")
def scorecard_rollup(spark, sf):
    c = t(spark, sf, "customer").join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return scoring.scorecard(c.select(F.col("n_name").alias("country"), (6 + F.col("c_custkey") % 2).alias("pillar_id"), F.col("c_mktsegment").alias("act_name"), F.array((F.col("c_custkey") % 9).cast("string")).alias("urls")))


def _reviewed(spark, sf) -> DataFrame:
    d, l = t(spark, sf, "documents"), t(spark, sf, "labels")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "rejected").otherwise("pending")
    return d.join(l, "doc_id", "left").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("jurisdiction"), status.alias("review_status"), (6 + F.col("doc_id") % 2).cast("int").alias("pillar"), (F.coalesce("toxic", F.lit(0)) * 0.1 + F.pmod("doc_id", F.lit(9)) * 0.1).alias("confidence"))


_REV_SQL = "rv AS (SELECT d.doc_id AS id, split_part(text,chr(10),1) AS title, source, CASE quality WHEN 1 THEN 'verified' WHEN 0 THEN 'rejected' ELSE 'pending' END AS review_status, 6+doc_id%2 AS pillar, coalesce(toxic,0)*0.1::DOUBLE + (doc_id%9)*0.1::DOUBLE AS confidence FROM documents d LEFT JOIN labels l USING(doc_id))"


@query(f"WITH {_REV_SQL} SELECT id FROM rv WHERE review_status='verified' AND pillar=6 AND (contains(lower(title),'the') OR contains(lower(source),'the'))")
def review_filter(spark, sf):
    return review.review_filter(_reviewed(spark, sf), "verified", 6, " THE", ("title", "jurisdiction")).select("id")


@query(f"WITH {_REV_SQL} SELECT count(*) AS total, count(*) FILTER (review_status='pending') AS pending, count(*) FILTER (review_status='verified') AS verified, count(*) FILTER (review_status='rejected') AS rejected, CASE WHEN count(*)=0 THEN 0 ELSE floor(count(*) FILTER (review_status<>'pending')*100.0/count(*)+0.5)::BIGINT END AS progress FROM rv")
def review_summary(spark, sf):
    return review.review_summary(_reviewed(spark, sf))


@query(f"WITH {_REV_SQL} SELECT id, CASE WHEN confidence>=0.8 THEN 'high' WHEN confidence>=0.65 THEN 'mid' ELSE 'low' END AS level FROM rv")
def confidence_level(spark, sf):
    return _reviewed(spark, sf).select("id", T.confidence_level(F.col("confidence")).alias("level"))


@query(f"WITH {_REV_SQL} SELECT id, CASE WHEN id%10=0 THEN 'verified' ELSE review_status END AS review_status FROM rv")
def review_update(spark, sf):
    r = _reviewed(spark, sf)
    updates = r.filter(F.col("id") % 10 == 0).select("id", F.lit("verified").alias("review_status"), F.lit(2).alias("pos")).unionByName(r.filter(F.col("id") % 20 == 0).select("id", F.lit("rejected").alias("review_status"), F.lit(1).alias("pos")))
    return review.with_review(r, updates).select("id", "review_status")


_STATUS = ("captcha page", "throttled", "ok", "not_found")


@query("""WITH e AS (SELECT event_id, ['captcha page','throttled','ok','not_found'][event_id%4+1] AS status, event_id%6=2 AS err, event_id%3+1 AS attempt, event_id%11<>0 AS au FROM events)
  SELECT event_id, CASE WHEN NOT au THEN 'deny' WHEN status='captcha page' THEN 'handoff' WHEN status='throttled' AND attempt<=2 THEN 'retry_later' WHEN status='throttled' THEN 'handoff' WHEN err AND attempt<=2 THEN 'retry_later' WHEN err THEN 'deny'
  WHEN status='not_found' THEN 'use_approved_fallback' ELSE 'allow' END AS kind FROM e""")
def policy_decision(spark, sf):
    e = t(spark, sf, "events")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("event_id") % 4 + 1).cast("int"))
    d = policy.decide(F.col("event_id") % 11 != 0, F.array(status), F.col("event_id") % 6 == 2, F.col("event_id") % 3 + 1, F.lit(2), F.array(F.lit("http://mirror")))
    return e.select("event_id", d["kind"].alias("kind"))


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, list(['captcha page','throttled','ok','not_found'][event_id%4+1] ORDER BY event_id) AS st FROM events GROUP BY 1),
  r AS (SELECT user_id, -1 AS step, false AS done, false AS moved, 1 AS attempt, 0 AS k, user_id%5 AS budget, ''::VARCHAR AS url, 0 AS tried, ''::VARCHAR AS kind, ''::VARCHAR AS reason, false AS final, NULL::VARCHAR AS used FROM o
    UNION ALL SELECT user_id, step + 1, final, moved OR goes, CASE WHEN goes OR over THEN attempt ELSE attempt + 1 END, CASE WHEN goes THEN 0 ELSE k + 1 END, budget - 1, addr, attempt, kind, reason, final, CASE WHEN moved OR goes THEN 'u' || user_id || '-mirror' END
    FROM (SELECT *, kind = 'use_approved_fallback' AS goes, kind IN ('deny', 'handoff') OR kind = 'allow' OR over OR (kind = 'retry_later' AND attempt >= 3) AS final
      FROM (SELECT *, CASE WHEN NOT auth THEN 'deny' WHEN over THEN 'retry_later' WHEN s = 'captcha page' THEN 'handoff' WHEN s = 'ok' THEN 'allow' WHEN s = 'not_found' THEN 'use_approved_fallback' WHEN attempt <= 2 THEN 'retry_later' WHEN s = 'gone' THEN 'deny' ELSE 'handoff' END AS kind,
          CASE WHEN NOT auth THEN 'policy not authorized' WHEN over THEN 'rate limit budget exhausted' WHEN s = 'captcha page' THEN 'blocking access signal detected' WHEN s = 'ok' THEN 'allowed' WHEN s = 'not_found' THEN 'approved fallback available for missing content'
          WHEN attempt <= 2 THEN CASE WHEN s = 'gone' THEN 'error severity signal' ELSE 'throttled or rate limited' END WHEN s = 'gone' THEN 'error severity persisted beyond retry budget' ELSE 'throttling persisted beyond retry budget' END AS reason
        FROM (SELECT r.user_id, r.step, r.moved, r.attempt, r.k, r.budget, r.budget <= 0 AS over, r.user_id%7 <> 0 AS auth, 'u' || r.user_id || CASE WHEN r.moved THEN '-mirror' ELSE '' END AS addr, CASE WHEN r.moved THEN 'gone' ELSE o.st[least(r.k, len(o.st) - 1) + 1] END AS s FROM r JOIN o USING (user_id) WHERE NOT r.done))))
  SELECT 'u' || user_id AS source_url, step, url, tried AS attempt, kind, reason, final, used AS fallback_used FROM r WHERE step >= 0""")
def retrieval_audit(spark, sf):
    """The fetch loop for each user as a source, all its events as the outcomes."""
    e = t(spark, sf, "events")
    url = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (F.col("event_id") % 4 + 1).cast("int"))
    out = e.select(url.alias("source_url"), url.alias("url"), F.col("event_id").alias("nth"), F.array(status).alias("statuses"), F.lit(False).alias("has_error"), F.lit(True).alias("ok"))
    p = e.select("user_id").distinct().select(url.alias("requested_url"), url.alias("source_url"), (F.col("user_id") % 7 != 0).alias("authorized"), (F.col("user_id") % 5).cast("int").alias("rate_limit_budget"), F.lit(2).alias("max_retries"), F.array(F.concat(url, F.lit("-mirror"))).alias("approved_fallback_urls"))
    return policy.retrieve(p, out)


@query("SELECT event_id, user_id, count(*) OVER w AS used, count(*) OVER w > 5 AS over_budget FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def rate_budget(spark, sf):
    return policy.rate_budget(t(spark, sf, "events")).select("event_id", "user_id", "used", "over_budget")


@query(f"WITH l AS (SELECT {_LAYOUT} AS key, html FROM pages), c AS (SELECT key, min(length(html)) AS one_time, max(length(html)) AS raw, 100 AS per_page FROM l GROUP BY 1), g AS (SELECT unnest([1,5,10,25,50,100,250,500]) AS pages) SELECT key, pages, one_time+pages*per_page AS pipeline_total, pages*(raw+600) AS agent_total, (pages*(raw+600))::DOUBLE/(one_time+pages*per_page) AS savings FROM c, g")
def amortization_curve(spark, sf):
    costs = layout.fingerprint(t(spark, sf, "pages")).groupBy(F.col("layout_id").alias("key")).agg(F.min(F.length("html")).cast("long").alias("one_time"), F.max(F.length("html")).cast("long").alias("raw")).withColumn("per_page", F.lit(100).cast("long"))
    return review.amortization(costs)


@query("SELECT role AS stage, count(*) AS calls, sum(length(text)) AS chars, count(DISTINCT sha256(text)) AS distinct_texts FROM conversations GROUP BY 1")
def stage_costs(spark, sf):
    return review.stage_costs(t(spark, sf, "conversations").select(F.col("role").alias("stage"), "text"))


@query("""SELECT doc_id, term, ((length(lower(text))-length(replace(lower(text),term,'')))//length(term))::BIGINT AS n FROM documents, (SELECT unnest(['cookie','licensed','the ']) AS term)""")
def contamination(spark, sf):
    return review.contamination(t(spark, sf, "documents"), ("cookie", "licensed", "the "), "doc_id")


#: What an event's properties are checked against: some are told apart by their type.
PROPS = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}


@query("""SELECT event_id, (json_valid(props) AND event_id%4<>1) AS ok, CASE WHEN event_id%4=1 THEN '$.k: not integer' END AS error,
  CASE WHEN event_id%4=1 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def json_props_check(spark, sf):
    """Properties amid other words, checked against a schema; every fourth has its number as text."""
    amid = F.concat(F.lit("Answer: "), F.when(F.col("event_id") % 4 == 1, F.regexp_replace("props", r":\s*(\d+)", r': "$1"')).otherwise(F.col("props")), F.lit(" done."))
    got = t(spark, sf, "events").select("event_id", capture.checked_json(amid, PROPS).alias("c"))
    return got.select("event_id", F.col("c.error").isNull().alias("ok"), "c.error", F.try_variant_get(F.try_parse_json("c.value"), "$.k", "string").alias("k"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's'||l_suppkey AS src, 'p'||l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p'||l_partkey, 's'||l_suppkey FROM lineitem),
  b(node, depth) AS (SELECT 's1', 0 UNION SELECT dst, depth+1 FROM b JOIN e ON src=node WHERE depth<2) SELECT node, min(depth) AS depth FROM b GROUP BY 1""")
def bfs_frontier(spark, sf):
    li = t(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    edges = li.unionByName(li.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return crawl.frontier(edges, spark.createDataFrame([("s1",)], "node string"))


@query(f"WITH u AS (SELECT page_id AS pos, regexp_replace(url,'[?#].*$','') AS url FROM pages) SELECT url, min(pos) AS pos FROM u WHERE url<>'' GROUP BY 1")
def seed_urls(spark, sf):
    return crawl.first_seen(t(spark, sf, "pages").select(F.col("page_id").alias("pos"), F.regexp_replace("url", "[?#].*$", "").alias("url")), "url").select("url", "pos")


@query("""WITH o AS (SELECT page_id, regexp_extract(url,'^[A-Za-z]+://[^/?#]*') origin, coalesce(nullif(regexp_extract(url,'^[A-Za-z]+://[^/?#]*([^?#]*)',1),''),'/') path FROM pages),
  r AS (SELECT DISTINCT origin FROM o WHERE starts_with(origin,'https')) SELECT page_id, (r.origin IS NOT NULL AND NOT starts_with(path,'/fr')) AS allowed FROM o LEFT JOIN r USING(origin)""")
def robots_gate(spark, sf):
    o = t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*", 0).alias("origin"), F.coalesce(F.nullif(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/")).alias("path"))
    rules = o.filter(F.startswith(F.col("origin"), F.lit("https"))).select("origin").distinct().withColumn("disallow", F.array(F.lit(""), F.lit("/fr")))
    return policy.robots_gate(o, rules).select("page_id", "allowed")


@query("SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(split_part(text,chr(10),1),'[^A-Za-z0-9]+','-','g'),'^-+',''),'-+$','')) AS slug FROM documents WHERE NOT regexp_matches(split_part(text,chr(10),1),'[^ -~]')")
def heading_slug(spark, sf):
    first = F.substring_index("text", "\n", 1)
    return t(spark, sf, "documents").filter(~first.rlike("[^ -~]")).select("doc_id", T.slug(first).alias("slug"))


@query()
def heading_slug_all(spark, sf):
    """The slug of every document's first line, of any alphabet; heading_slug and its SQL take ASCII lines only."""
    return t(spark, sf, "documents").select("doc_id", T.slug(F.substring_index("text", "\n", 1)).alias("slug"))


@query("SELECT page_id, 'http://a.org/' || page_id || '.pdf|https://b.org/x.PDF' AS links FROM pages")
def pdf_links(spark, sf):
    a = F.concat(F.lit("http://a.org/"), F.col("page_id").cast("string"), F.lit(".pdf"))
    return t(spark, sf, "pages").select("page_id", joined(U.pdf_links(F.concat(F.lit("see '"), a, F.lit("' and \""), a, F.lit("\" or <https://b.org/x.PDF>")))).alias("links"))


@query("SELECT user_id, time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, count(*) AS used, count(*)>5 AS over_budget FROM events GROUP BY 1,2")
def windowed_uses(spark, sf):
    from quarryline.streaming.budget import windowed_uses as uses

    return uses(t(spark, sf, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
