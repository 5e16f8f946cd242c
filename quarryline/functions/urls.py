"""URL functions, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import blank, strip

#: Path words of account and action pages, which are never followed.
BLOCKED = r"(?i)(?:^|[/_.?=&-])(login|logout|signin|signout|delete|remove|action|account|register|captcha)(?:$|[/_.?=&-])"
#: The depth to which a crawl goes.
MAX_DEPTH = 2


def normalize_url(c: Column) -> Column:
    """The key by which two URLs are equal: lower case, without scheme, www., query, fragment and closing slashes."""
    u = F.regexp_replace(F.regexp_replace(F.lower(strip(blank(c))), "^https?://", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(u, r"[?#][\s\S]*$", ""), "/+$", "")


_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def _part(c: Column, k: int) -> Column:
    return F.regexp_extract(strip(blank(c)), _PARTS, k)


def _authority(c: Column) -> Column:
    return F.regexp_replace(_part(c, 2), "^[^@]*@", "")


def host(c: Column) -> Column:
    """Lower-case host without one leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(_authority(c)), r":\d*$", ""), r"^www\.", "")


def _encoded(c: Column) -> Column:
    """Decoded and encoded anew, so that equal queries are equal text."""
    plain = F.coalesce(F.try_url_decode(c), c)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, single slashes, sorted query without utm_ keys, no fragment; '' if it isn't a web address."""
    scheme, name = F.lower(_part(c, 1)), F.lower(F.regexp_replace(_authority(c), r":\d*$", ""))
    port = F.regexp_extract(_authority(c), r":(\d+)$", 1)
    shown = F.when((port == "") | port.isin("80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_replace(_part(c, 3), "/{2,}", "/"), "/+$", "")
    pairs = F.filter(F.split(_part(c, 4), "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("").alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_")))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), name, shown, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (name != ""), whole).otherwise("")


def url_rejection(url: Column, seed_host: Column, depth: Column, max_depth: int = MAX_DEPTH) -> Column:
    """The first reason not to follow a URL, '' if there is none."""
    return F.when(host(url) != seed_host, "different_domain").when(depth > max_depth, "max_depth_exceeded").when(url.rlike(BLOCKED), "unsafe_or_account_url").otherwise("")


def pattern_allows(url: Column, include: list[str] | Column, exclude: list[str] | Column) -> Column:
    """No exclude pattern is found, and some include pattern is, if there are any. Patterns are given, or columns of arrays (null: none)."""

    def found(patterns: list[str] | Column) -> Column:
        if isinstance(patterns, Column):
            return F.coalesce(F.exists(patterns, lambda p: F.regexp_like(url, p)), F.lit(False))
        hit = F.lit(False)
        for p in patterns:
            hit = hit | url.rlike(p)
        return hit

    free = F.coalesce(F.size(include) <= 0, F.lit(True)) if isinstance(include, Column) else F.lit(not include)
    return ~found(exclude) & (free | found(include))


def followable(links: Column, seed_host: Column, depth: int = 1, include: list[str] | Column = (), exclude: list[str] | Column = ()) -> Column:
    """Of links (url, text), those that may be followed, with canonical addresses: each address once, where it came first."""
    numbered = F.transform(links, lambda l, i: F.struct(canonical_url(l["url"]).alias("url"), i.alias("pos"), l["text"].alias("text")))
    ok = F.filter(numbered, lambda l: (l["url"] != "") & (url_rejection(l["url"], seed_host, F.lit(depth)) == "") & pattern_allows(l["url"], include, exclude))
    # An array of one array names the sorted links inside the lambda, so they are sorted once.
    first = F.flatten(F.transform(F.array(F.array_sort(ok)), lambda s: F.filter(s, lambda l, i: (i == 0) | (F.get(s, i - 1)["url"] != l["url"]))))
    in_order = F.array_sort(F.transform(first, lambda l: F.struct(l["pos"].alias("pos"), l["url"].alias("url"), l["text"].alias("text"))))
    return F.transform(in_order, lambda l: F.struct(l["url"].alias("url"), l["text"].alias("text")))


def is_pdf(url: Column, content_type: Column) -> Column:
    return F.lower(blank(content_type)).startswith("application/pdf") | F.lower(F.regexp_replace(blank(url), "[?#].*$", "")).endswith(".pdf")


def pdf_links(html: Column) -> Column:
    """Distinct addresses of PDF files in the markup or scripts, in order."""
    return F.array_distinct(F.regexp_extract_all(blank(html), F.lit(r"""(?i)https?://[^\s"'<>]+?\.pdf"""), 0))
