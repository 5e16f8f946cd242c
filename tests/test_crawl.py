"""Crawling and per-layout scraping: whole crawls as tables, revision of rules, robots files, rounds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import crawl, layout, policy
from quarryline.sources.rounds import Rounds

HOST = "https://regulator.example"
MENU = f"<html><body><header><nav><a href='/acts'>Acts</a><a href='/advice'>Advice</a><a href='https://elsewhere.example/x'>Out</a><a href='/login'>Enter</a></nav></header><main class='home'><h1>Office</h1><p>{'The office watches over data. ' * 3}</p></main></body></html>"
ACT = "<html><body><header><nav><a href='/'>Start</a></nav></header><main class='act'><h1>Records Act</h1><p>Whoever moves records abroad keeps an account of it and of the safeguards that hold there.</p><h2><a href='/acts/part-2?utm_source=menu'>Part 2</a></h2></main><footer>All rights reserved</footer></body></html>"
PART = "<html><body><main class='act'><h1>Part 2</h1><p>Whoever holds records keeps them safe by means that fit their kind, and says who may read them.</p></main></body></html>"
GOOD = {"rules": [{"selector": "header, footer", "role": "ignore", "reason": "frame"}, {"selector": "main", "role": "extract_and_crawl"}, {"selector": "", "role": "extract_only"}, {"selector": "p", "role": "unknown"}], "exclude_url_patterns": ["/login"], "confidence": 0.9}


def good_model():
    return lambda prompt: json.dumps(GOOD)


def bad_first():
    bad, start = {"rules": [{"selector": ".none", "role": "extract_only"}]}, layout.LEARN
    return lambda prompt: json.dumps(bad if prompt.startswith(start) else GOOD)


def site(spark, selected=("/acts", "/advice"), url=HOST + "/"):
    return spark.createDataFrame([(1, url, "regulator.example", [HOST + s for s in selected])], "site int, url string, host string, selected array<string>")


@pytest.fixture(scope="module")
def pages(spark):
    found = {"/": MENU, "/acts": ACT, "/advice": ACT.replace("Records", "Advice"), "/acts/part-2": PART}
    return spark.createDataFrame([(HOST + k, v) for k, v in found.items()], "url string, html string")


def test_three_pages_are_learnt_and_kept_on_their_host(spark, pages):
    scraper = layout.Scraper(good_model(), least=40)
    got = crawl.crawl(site(spark), pages, scrape=scraper, max_pages=5)
    rows = {r.url.removeprefix(HOST): (r.status, r.depth) for r in got.collect()}
    assert rows == {"/": ("visited", 0), "/acts": ("visited", 1), "/advice": ("visited", 1), "/acts/part-2": ("visited", 2)}
    seen = scraper.pages.collect()
    assert len(seen) == 4 and all(r.method == "rules" and "All rights reserved" not in r.content for r in seen)
    layouts = scraper.layouts.collect()
    assert {x.role for r in layouts for x in r.rule_set.rules} == {"ignore", "extract_and_crawl"} and {r.version for r in layouts} == {0}
    result = json.loads(crawl.crawl_results(got, scraper.pages.select("site", "url", F.struct("url", "method").alias("page")), scraper.layouts.select("site", F.struct("layout_id", "version").alias("layout"))).first().result)
    assert [u.removeprefix(HOST) for u in result["visited_urls"]] == ["/", "/acts", "/advice", "/acts/part-2"]
    assert len(result["extracted_pages"]) == 4 and len(result["learned_layouts"]) == 3 and result["failed_urls"] == result["skipped_urls"] == []


def test_rules_are_revised_at_most_twice(spark, pages):
    scraper = layout.Scraper(bad_first(), least=40)
    got = crawl.crawl(site(spark), pages, scrape=scraper, max_depth=1, max_pages=2).collect()
    assert [r.status for r in sorted(got, key=lambda r: r.place)] == ["visited", "visited", "skipped"] and got[0].reason in ("", "max_pages_reached")
    assert {(r.method, r.rule_version) for r in scraper.pages.collect()} == {("rules", 2)}
    versions = scraper.layouts.groupBy("layout_id").agg(F.max("version").alias("v")).collect()
    assert {r.v for r in versions} == {1}


def test_robots_stop_before_anything_is_read(spark, pages):
    rules = policy.robots_rules(spark.createDataFrame([(HOST, "User-agent: *\nDisallow: /")], "origin string, text string"), "r/1")
    got = crawl.crawl(site(spark), pages, rules)
    assert [(r.status, r.reason) for r in got.collect()] == [("skipped", "robots_disallowed")]
    assert crawl.crawl(site(spark), pages, rules.limit(0)).first().reason == "robots_disallowed"  # unknown rules are no permission


def test_seeds_that_cannot_be_read_end_their_crawl(spark):
    seeds = spark.createDataFrame([(1, "http://a.org/", "a.org", ["http://a.org/x"]), (2, "http://b.org/", "b.org", None), (3, "http://c.org/f.pdf", "c.org", []), (4, "", "d.org", [])], "site int, url string, host string, selected array<string>")
    pages = spark.createDataFrame([("http://a.org/", None, "timeout", False), ("http://c.org/f.pdf", ["http://c.org/"], None, True)], "url string, links array<string>, fetch_error string, is_pdf boolean")
    got = {(r.site, r.status, r.reason) for r in crawl.crawl(seeds, pages).collect()}
    assert got == {(1, "failed", "fetch_error: timeout"), (2, "failed", "fetch_error: not captured"), (3, "failed", "seed_page_is_pdf")}
    assert crawl.crawl(seeds.limit(0), pages).count() == 0


def queue_by_hand(seed, selected, pages, host, max_depth, max_pages):
    """The same crawl with one queue."""
    out, queue, queued, visited = [], [(seed, 0)], {seed}, 0
    at = 0
    while at < len(queue):
        url, depth = queue[at]
        links, error = pages.get(url, (None, None))
        if visited >= max_pages:
            out.append((url, depth, "skipped", "max_pages_reached"))
        elif not url.startswith(host + "/"):
            out.append((url, depth, "skipped", "different_domain"))
        elif "/login" in url:
            out.append((url, depth, "skipped", "unsafe_or_account_url"))
        elif links is None:
            out.append((url, depth, "failed", ("fetch_error" if depth == 0 else "processing_error") + ": not captured"))
            if depth == 0:
                break
            visited += 1
        else:
            visited += 1
            if at == 0:
                new = [u for u in dict.fromkeys(selected) if u not in queued]
                queue += [(u, 1) for u in new]
                queued |= set(new)
            out.append((url, depth, "failed" if error else "visited", error or ""))
            for u in links if depth < max_depth and not error else ():
                if u not in queued and len(queued) < max_pages * 4:
                    queued.add(u)
                    queue.append((u, depth + 1))
        at += 1
    return sorted((u, d, n, s, r) for n, (u, d, s, r) in enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_levels_equal_a_queue(spark, seed):
    r = random.Random(seed)
    host = "http://a.org"
    name = lambda: r.choice([f"{host}/{r.randrange(60)}", f"{host}/{r.randrange(60)}", f"{host}/login/{r.randrange(3)}", f"http://b.org/{r.randrange(3)}"])
    found = {f"{host}/{i}": ([name() for _ in range(r.randrange(12))], "no text" if r.random() < 0.1 else None) for i in range(60) if r.random() < 0.9}
    found[f"{host}/0"] = ([name() for _ in range(10)], None)
    pages = spark.createDataFrame([(u, links, e) for u, (links, e) in found.items()], "url string, links array<string>, page_error string")
    selected, pages_n = [f"{host}/{i}" for i in (5, 3, 5, 7)], r.choice([3, 8, 30])
    seeds = spark.createDataFrame([(k, f"{host}/{k}", "a.org", selected) for k in (0, 1)], "site int, url string, host string, selected array<string>")
    got = crawl.crawl(seeds, pages, max_depth=3, max_pages=pages_n).collect()
    for k in (0, 1):
        mine = sorted((x.url, x.depth, x.place, x.status, x.reason) for x in got if x.site == k)
        assert mine == queue_by_hand(f"{host}/{k}", [s for s in selected if s != f"{host}/{k}"], found, host, 3, pages_n)


LONG = "Words that say what the page is about, and enough of them to be taken for its content at last."


def three_layouts(spark):
    """Layout x keeps its rules, y is revised once at its second page, z is revised twice and still fails on short pages."""
    page = lambda kind, a, b: f"<html><body><div class='{kind}'><h1>{a}</h1><p class='b{kind}'>{b}</p></div></body></html>"
    rows = [(0, "x", LONG, ""), (1, "y", LONG, LONG), (2, "y", "short", LONG), (3, "y", LONG, "short too"), (4, "z", "s", "t"), (5, "x", LONG, "more"), (6, "z", LONG, "t")]
    return spark.createDataFrame([(i, f"http://a.org/{i}", page(*r)) for i, *r in rows], "page_id int, url string, html string")


def by_turn():
    def model(prompt):
        data = json.loads(prompt.split("Data:\n", 1)[1])
        assert ("previous_rules" in data) == (data["version"] > 0) == ("failures" in data) and LONG not in prompt
        return json.dumps({"rules": [{"selector": ("h1", "p", "h2")[data["version"]], "role": "extract_only"}]})

    return model


def test_a_revision_changes_what_later_pages_give(spark):
    rows, state = layout.scrape(three_layouts(spark), by_turn())
    got = {r.page_id: (r.method, r.rule_version, r.content, r.reason) for r in rows.collect()}
    assert got[0] == got[5] == ("rules", 1, LONG, "")
    assert got[1] == ("rules", 1, LONG, "")
    assert got[2] == ("rules", 2, LONG, "")  # by p, after h1 failed
    assert got[3][:2] == ("readability", 3) and got[3][2] == LONG + "\nshort too"  # p failed, h2 too
    assert got[4] == ("error", 3, "", "no_domain_specific_fallback")
    assert got[6][:2] == ("readability", 3)
    assert sorted(r.version for r in state.collect()) == [0, 0, 0, 1, 1, 2, 2]


def test_state_goes_on(spark):
    whole = {r.page_id: (r.method, r.rule_version, r.content) for r in layout.scrape(three_layouts(spark), by_turn())[0].collect()}
    for cut in (2, 4):
        _, state = layout.scrape(three_layouts(spark).filter(F.col("page_id") < cut), by_turn())
        rows, after = layout.scrape(three_layouts(spark).filter(F.col("page_id") >= cut), by_turn(), state)
        assert {r.page_id: (r.method, r.rule_version, r.content) for r in rows.collect()} == {k: v for k, v in whole.items() if k >= cut}
        assert after.groupBy("layout_id", "version").count().filter("count > 1").count() == 0


def test_scaffolds_come_last(spark):
    html = f"<html><body><main><h1>x</h1></main><div id='side'><li>{LONG}</li></div></body></html>"
    pages = spark.createDataFrame([(0, "http://a.org/", html), (1, "http://b.org/", html), (2, "http://a.org/e", None)], "page_id int, url string, html string")
    rows, _ = layout.scrape(pages, by_turn(), scaffolds=(("a.org", "#side", "li"),))
    assert {r.page_id: (r.method, r.content, r.reason) for r in rows.collect()} == {0: ("scaffold", LONG, ""), 1: ("error", "", "no_domain_specific_fallback"), 2: ("error", "", "all_extraction_methods_failed")}


def test_a_failing_model_gives_no_rules(spark):
    def fails(prompt):
        raise OSError("down")

    rows, state = layout.scrape(three_layouts(spark), fails)
    assert {r.method for r in rows.collect()} == {"readability", "error"} and all(r.error == "OSError: down" and r.rule_set.rules == [] for r in state.collect())


def test_patterns_of_a_layout(spark):
    html = "<html><body><main><a href='/acts/1'>One</a><a href='/news'>News</a><p>" + LONG + "</p></main></body></html>"
    pages = spark.createDataFrame([(0, "http://a.org/", html)], "page_id int, url string, html string")

    def links(**more):
        reply = json.dumps({"rules": [{"selector": "main", "role": "extract_and_crawl"}], **more})
        return [x.url.removeprefix("http://a.org") for x in layout.scrape(pages, lambda p: reply)[0].first().links]

    assert links() == ["/acts/1", "/news"]
    assert links(include_url_patterns=["/acts"]) == ["/acts/1"] and links(exclude_url_patterns=["/acts"]) == ["/news"]
    assert links(include_url_patterns=["("]) == links(exclude_url_patterns=["["]) == []


@pytest.mark.parametrize(
    ("text", "path", "allowed"),
    [
        ("", "/a", True), ("User-agent: *\nDisallow:", "/a", True), ("User-agent: *\nDisallow: /a", "/ab", False), ("User-agent: *\nAllow: /a/b\nDisallow: /a", "/a/b/c", True), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b", False),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf", False), ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf?z", True), ("User-agent: other\nDisallow: /", "/a", True), ("user-agent: RES\nUser-agent: b\nDisallow: /r # no\n\nUser-agent: *\nDisallow: /", "/a", True),
        ("user-agent: RES\nUser-agent: b\nDisallow: /r # no\n\nUser-agent: *\nDisallow: /", "/r", False), ("Disallow: /", "/a", True), ("User-agent: *\nDisallow: /a.b", "/aXb", True), ("User-agent: *\nDisallow: *", "", False), (None, "/a", True),
    ],
)
def test_robots_files(spark, text, path, allowed):
    rules = policy.robots_rules(spark.createDataFrame([("http://a.org", text)], "origin string, text string"), "Research/2.0")
    assert rules.select(policy.robots_allowed(F.lit("http://a.org" + path), F.col("rules"))).first()[0] == allowed


def test_a_model_that_commits_to_nothing_drops_no_links(spark):
    offered = F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("c"))
    pick = lambda reply: spark.range(1).select(crawl.choose_links(offered, F.lit(reply).cast("string"))).first()[0]
    assert pick('{"selected_urls": ["c", "x", "b"]}') == ["b", "c"] and pick('{"selected_urls": []}') == []
    assert pick(None) == pick("no json") == pick('{"other": 1}') == pick('{"selected_urls": null}') == ["b", "a", "c"]


def test_rounds(spark):
    r = Rounds(spark, "test")
    for i in range(3):
        assert r.put(spark.range(i).withColumn("n", F.lit(i))).count() == i
    assert r.all().count() == 3 and {x.n for x in r.last().collect()} == {2}
    r.drop()


def test_links_of_pages_that_are_not_expanded_are_not_moved(spark):
    """Many sites end at pages with many links each: what is shuffled doesn't grow with those links."""
    seeds = spark.createDataFrame([(i, f"{HOST}/s/{i}", "regulator.example", None) for i in range(40)], "site int, url string, host string, selected array<string>")
    start = spark.range(40).select(F.format_string(HOST + "/s/%d", "id").alias("url"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.format_string(HOST + "/hub/%d", k)).alias("links"))
    hubs = spark.range(20).select(F.format_string(HOST + "/hub/%d", "id").alias("url"), F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda k: F.sha2(F.concat(F.col("id"), F.lit("/"), k).cast("binary"), 256)).alias("links"))
    context = spark.sparkContext

    def shuffled():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum({stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}.values())

    before = shuffled()
    got = crawl.crawl(seeds, start.unionByName(hubs), max_depth=1).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"visited": 40 * 21} and shuffled() - before < 20e6
