"""Operator 9: main text of web pages by a site style tree.

Pages of one host are merged: a node of the merged tree is a path of elements with their classes. For
each container node the tree knows on how many pages it stands, how often it had which sequence of
children (its presentation styles) and on how many pages each text block below it occurred. The
entropy of the styles is the node's importance as presentation; one less the mean entropy of its
blocks is its importance as content: a block that stands on every page says nothing. Both are
combined, the more by content the more children a node has, and branches of which no node reaches
LEAST, on hosts with enough pages, are removed from each page. Nodes that hold a block themselves (paragraphs, headings,
quotations) are nodes of the tree too, inside articles as well as outside, and so are their single
blocks: the importance of a block is one less the share of the node's other pages that have it. What
remains of a page's articles (of its main part, else of its body) is its text, without elements and
classes whose meaning is known: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments. Those decide first, since adverts and footers often differ from page to
page and are then important to any tree. A page of which no block would be left keeps those outside
low branches, and an article itself is no branch, so a host that repeats an article keeps it.

Where words differ from page to page nothing repeats, and the tree tells the main part by its mass: the
merged tree's branch with most of the host's text is the main one, down to where no branch holds half
of it. Beside it, branches with less than SLIGHT of the text are removed from pages that have no
article or main element, whatever their classes; such an element, where there is one, says the same.

Nodes of all depths count; a path is a hash of its parent's path and its own element, so deep pages
cost no more a node than flat ones.

Blocks end where a block element starts or ends; a line break is a space. Only counts by host, path
and feature are shuffled, and they are summed before; the pages are not.

Defined results: null html is empty, with an empty text; null urls are one host; repeated rows are
pages each; markup that is never closed ends with the page; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import cut

#: Weight of presentation against content by children; importance below which a branch goes; pages that a host needs for that.
GAMMA, LEAST, PAGES = 0.9, 0.3, 8
#: Share of a host's text that makes a branch the main one; share below which a branch beside it goes.
MOST, SLIGHT = 0.5, 0.2
#: A path with these bits flipped is the key of a branch beside the main one.
BESIDE = 0x5BD1E995A5A5C3C3
#: Noise nodes and blocks of hosts up to which they are sent to every executor; beyond, pages are joined by host.
BROADCAST_ROWS = 200_000

#: Element names and class words whose meaning is known.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CONTAINER = frozenset("div section ul ol dl table nav header footer aside form figure main center details".split())
NOISE = frozenset("head title script style noscript template nav footer aside form button select textarea iframe object svg canvas menu dialog audio video".split())
MAIN = frozenset("article main".split())
NOISE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|sidebar|side-bar|widget|menu|nav|navbar|navigation|breadcrumbs?|masthead|site-?header|page-?header|footer|comments?|commentlist|disqus|replies|respond|search|toolbar|pagination|pager|skip-link)(?:$|[\s_-])"
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_CLOSED_BY = {"li": {"li"}, "p": set(), "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def block_key(path: int, feature: int) -> int:
    """A block at a path, as one number of 64 bits beside the paths."""
    return _hash(f"{path} {feature}")


class Node:
    __slots__ = ("tag", "path", "parent", "noise", "main", "children", "container", "leaf", "above")

    def __init__(self, tag: str, path: int, parent: Node | None, noise: bool, main: bool):
        self.tag, self.path, self.parent, self.noise, self.main = tag, path, parent, noise, main
        self.children: list[str] = []
        self.container = tag in CONTAINER and tag not in MAIN
        self.leaf = not (self.container or main or tag in ("", "html", "body"))
        #: The innermost branch around it.
        self.above = parent if parent is None or parent.branch else parent.above

    @property
    def branch(self) -> bool:
        return self.container or self.main


class Page(HTMLParser):
    """A page's blocks of text, each with its node."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        root = Node("", 0, None, False, False)
        self.nodes, self.stack = [root], [root]
        self.blocks: list[tuple[Node, str]] = []
        self.parts: list[str] = []
        self.at = root
        self.feed(html)
        self.close()
        self._end()

    def _end(self) -> None:
        if self.parts:
            if text := _SPACE.sub(" ", "".join(self.parts)).strip():
                self.blocks.append((self.at, text))
            self.parts = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in INLINE and not any(k in ("class", "id", "style", "hidden", "aria-hidden") for k, _ in attrs):
            return
        inline = tag in INLINE
        if not inline:
            self._end()
            if (close := _CLOSED_BY.get(tag)) is not None or tag in CONTAINER or tag in MAIN:
                for i in range(len(self.stack) - 1, 0, -1):
                    open_ = self.stack[i].tag
                    if open_ == "p" or close and open_ in close:
                        del self.stack[i:]
                    elif open_ in CONTAINER or open_ in MAIN or open_ in ("table", "td", "th"):
                        break
        if tag in VOID:
            return
        have = dict(attrs)
        name = " ".join(filter(None, (have.get("class"), have.get("id"), have.get("role")))).lower()
        above = self.stack[-1]
        noise = tag in NOISE or bool(name and tag not in ("body", "html") and NOISE_WORD.search(name)) or "hidden" in have or have.get("aria-hidden") == "true" or bool(HIDDEN.search(have.get("style") or ""))
        noise = noise or tag == "header" and not self._in_main(above)
        sign = f"{tag}.{'.'.join(sorted((have.get('class') or '').split()))}"
        node = Node(tag, _hash(f"{above.path}>{sign}"), above, noise or above.noise, tag in MAIN or have.get("role") == "main")
        above.children.append(sign)
        self.nodes.append(node)
        self.stack.append(node)
        if not inline:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "script", "iframe"):
            self.handle_endtag(tag)

    @staticmethod
    def _in_main(node: Node | None) -> bool:
        while node is not None:
            if node.main:
                return True
            node = node.parent
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break
            if tag in INLINE and self.stack[i].tag not in INLINE:
                break
        if tag not in INLINE:
            self.at = self.stack[-1]

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.noise and top.tag in INLINE:  # a noisy inline element inside a block
            return
        if not self.parts:
            self.at = top
        self.parts.append(data)

    def features(self) -> Iterator[tuple[int, int, int, int]]:
        """(path, kind, feature, children) of containers and of nodes with a block: kind 0 a style, 1 a block at or below it, 2 its pages, 3 its text (feature: the branch around it; children: the code points); once a page each."""
        seen = set()
        for n in {id(n): n for n in (*(n for n in self.nodes if n.container), *(n for n, _ in self.blocks if not n.noise))}.values():
            seen.add((n.path, 0, _hash("|".join(n.children)), len(n.children)))
            seen.add((n.path, 2, 0, 0))
        for node, text in self.blocks:
            feature, at = None, node
            while at is not None:
                if at.container or at is node and not at.noise:
                    feature = _hash(text) if feature is None else feature
                    seen.add((at.path, 1, feature, 0))
                at = at.parent
        mass: Counter[tuple[int, int]] = Counter()
        for node, text in self.blocks:
            if not node.noise:
                at = node if node.branch else node.above
                while at is not None:
                    mass[at.path, at.above.path if at.above else 0] += len(text)
                    at = at.above
                mass[0, 0] += len(text)
        seen.update((path, 3, above, n) for (path, above), n in mass.items())
        return iter(seen)

    def text(self, removed: frozenset[int]) -> str:
        """The main text, without branches whose path, and blocks whose path or block_key(), is in removed."""

        def known(n: Node, t: str) -> bool:
            """The tree knows the block, or the node that holds it, as noise."""
            return n.leaf and n.path in removed or block_key(n.path, _hash(t)) in removed

        gone: set[int] = set()
        if removed:
            high = {id(n) for n in self.nodes if n.container and not n.noise and n.path not in removed}
            high |= {id(n) for n, t in self.blocks if not n.noise and not n.container and not known(n, t)}
            for n in reversed(self.nodes):  # a branch goes only if nothing in it is important
                if id(n) in high:
                    high.add(id(n.parent))
            for n in self.nodes:  # parents come first
                if n.container and n.path in removed and id(n) not in high or not n.main and id(n.parent) in gone:
                    gone.add(id(n))

        def joined(blocks: Iterable[tuple[Node, str]]) -> str:
            high = [(n, t) for n, t in blocks if id(n) not in gone]
            left = [t for n, t in high if not known(n, t)] if removed else []
            return "\n".join(left or [t for _, t in high])

        def root(n: Node | None) -> Node | None:
            """The outermost main node that n is in, of those that aren't themselves noise."""
            best = None
            while n is not None:
                if n.main:
                    best = n
                n = n.parent
            return best

        mains = {id(r): r for n, _ in self.blocks if (r := root(n)) is not None}
        clean = [r for r in mains.values() if not r.noise]
        articles = [r for r in clean if r.tag == "article"] or clean
        if articles:
            keep = {id(r) for r in articles}
            return joined((n, t) for n, t in self.blocks if (r := root(n)) is not None and id(r) in keep and not n.noise)
        if mains:  # an article inside an element that was never closed
            return joined((n, t) for n, t in self.blocks if root(n) is not None and not self._noise_below(n))
        beside: set[int] = set()
        for n in self.nodes if removed else ():  # parents come first
            if n.branch and n.path ^ BESIDE in removed or id(n.parent) in beside:
                beside.add(id(n))
        plain = [(n, t) for n, t in self.blocks if not n.noise]
        return joined([(n, t) for n, t in plain if id(n) not in beside] or plain)

    @staticmethod
    def _noise_below(n: Node) -> bool:
        """Noise of n's own branch, up to its innermost main node."""
        while n is not None and not n.main:
            own = n.parent is None or not n.parent.noise
            if n.noise and own or n.tag in NOISE:
                return True
            n = n.parent
        return False


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_COUNTS = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int8()), ("feature", pa.int64()), ("pages", pa.int64()), ("children", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages, children = Counter(), Counter()
        for url, html in zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True):
            at = host(url)
            for path, kind, feature, n in Page(html or "").features():
                pages[at, path, kind, feature] += 1
                children[at, path, kind, feature] += n
        rows = [(*k, n, children[k]) for k, n in pages.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, _COUNTS, strict=True)], schema=_COUNTS)


def _summed(pages: DataFrame) -> DataFrame:
    """The pages of each host, path and feature."""
    counts = pages.select("url", "html").mapInArrow(_count, "host string, path long, kind byte, feature long, pages long, children long")
    return counts.groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("c"), F.sum("children").alias("children"))


def _importance(summed: DataFrame) -> DataFrame:
    """(host, path, importance, n) of the nodes that were counted PAGES times at least; n: on how many pages."""
    style, block = F.col("kind") == 0, F.col("kind") == 1
    c = F.col("c").cast("double")
    nodes = summed.groupBy("host", "path").agg(
        F.sum(F.when(style, c)).alias("m"), F.sum(F.when(style, c * F.log(c))).alias("styles"), F.sum(F.when(style, F.col("children"))).alias("children"),
        F.sum(F.when(block, c)).alias("blocks"), F.sum(F.when(block, c * F.log(c))).alias("repeats"),
        F.sum(F.when(F.col("kind") == 2, F.col("c"))).alias("n"),
    ).filter(F.col("m") >= PAGES)
    log_m = F.log("m")
    presentation = F.when(F.col("m") > 1, (log_m - F.col("styles") / F.col("m")) / log_m).otherwise(1.0)
    content = F.when(F.coalesce("blocks", F.lit(0)) > 0, 1 - F.col("repeats") / F.col("blocks") / log_m).otherwise(0.0)
    fade = F.pow(F.lit(GAMMA), F.col("children") / F.col("m"))
    importance = F.when(F.col("children") > 0, (1 - fade) * content + fade * presentation).otherwise(content)
    return nodes.select("host", "path", importance.alias("importance"), "n")


def noise_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, importance) of the site style trees' nodes; low ones are noise."""
    return _importance(_summed(pages)).select("host", "path", "importance")


def low_keys(pages: DataFrame) -> DataFrame:
    """(host, key) of what is removed: the paths of low nodes, and the block_key() of low blocks."""
    summed = cut(_summed(pages), "site-counts")
    nodes = _importance(summed)
    # A low block stands on so many pages at least, since its node stands on PAGES.
    often = summed.filter((F.col("kind") == 1) & (F.col("c") > (1 - LEAST) * (PAGES - 1))).select("host", "path", "feature", "c")
    blocks = often.join(nodes.filter(F.col("n") >= PAGES), ["host", "path"]).filter((F.col("c") - 1) / (F.col("n") - 1) > 1 - LEAST)
    keyed = blocks.select("host", "path", "feature").mapInArrow(_keys, "host string, key long")
    low = nodes.filter(F.col("importance") < LEAST).select("host", F.col("path").alias("key"))
    beside = _beside(summed).select("host", F.col("path").bitwiseXOR(F.lit(BESIDE)).alias("key"))
    return low.unionByName(keyed).unionByName(beside)


def _beside(summed: DataFrame) -> DataFrame:
    """(host, path) of the branches that stand beside a host's main one and hold little of its text."""
    mass = summed.filter("kind = 3").select("host", "path", F.col("feature").alias("above"), F.col("children").alias("mass"), "c")
    whole = mass.filter("path = 0").select("host", F.col("mass").alias("whole"), F.col("c").alias("n")).filter(F.col("n") >= PAGES)
    shares = mass.filter("path != 0").join(whole, "host").select("host", "path", "above", (F.col("mass") / F.col("whole")).alias("share"))
    main = shares.filter(F.col("share") > MOST).select("host", "above").distinct()
    return shares.filter(F.col("share") < SLIGHT).join(main, ["host", "above"], "left_semi").select("host", "path")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [block_key(p, f) for p, f in zip(b["path"].to_pylist(), b["feature"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["host"], pa.array(keys, pa.int64())], ["host", "key"])


def _extract(batches: Iterator[pa.RecordBatch], lookup) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(html or "").text(lookup(b, i, url)) for i, (url, html) in enumerate(zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True))]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Every page's main text."""
    spark = pages.sparkSession
    low = cut(low_keys(pages).groupBy("host").agg(F.collect_set("key").alias("paths"), F.count("*").alias("n")), "site-noise")
    kind = "page_id long, url string, text string, n_chars long"
    plain = pages.select("page_id", "url", "html")
    if (low.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_ROWS:
        sent = spark.sparkContext.broadcast({r["host"]: frozenset(r["paths"]) for r in low.select("host", "paths").collect()})
        none = frozenset()
        return plain.mapInArrow(lambda batches: _extract(batches, lambda b, i, url: sent.value.get(host(url), none)), kind)
    name = F.udf(host, "string")("url")  # the rule that made the trees
    joined = plain.withColumn("host", name).join(low.select("host", "paths"), "host", "left").drop("host")
    return joined.mapInArrow(lambda batches: _extract(batches, lambda b, i, url: frozenset(b["paths"][i].as_py() or ())), kind)
