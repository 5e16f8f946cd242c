"""Scalar text functions, all as Columns inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest snippet, title and rationale.
SNIPPET = 300
#: A word character for word boundaries in any language; lookarounds, since \b differs between JDKs.
_W = r"[\p{L}\p{N}_]"

#: Names and codes of economies that a caller may give.
COUNTRY_ALIASES = {
    "sg": "Singapore", "singapore": "Singapore",
    "au": "Australia", "aus": "Australia", "australia": "Australia",
    "my": "Malaysia", "mys": "Malaysia", "malaysia": "Malaysia",
}


def blank(c: Column) -> Column:
    """Null text is the empty text."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any alphabet at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z0-9]+"), 0))


def normalize_act(c: Column) -> Column:
    return F.concat_ws(" ", F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z0-9]+"), 0))


def act_tokens(c: Column) -> Column:
    """Tokens of an act's name without the years that stand alone in it."""
    return tokens(F.regexp_replace(blank(c), rf"(?<!{_W})(?:19|20)\d{{2}}(?!{_W})", ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def act_similarity(a: Column, b: Column) -> Column:
    return jaccard(act_tokens(a), act_tokens(b))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(blank(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(c: Column) -> Column:
    """Each run of letters starts upper case, also after digits, hyphens and apostrophes."""
    return F.concat_ws("", F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), 0), lambda p: F.initcap(p)))


def title_from_url(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(blank(url), r"[?#][\s\S]*$", ""), "/+$", "")
    segment = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)\.(pdf|html?|aspx)$", "")
    words = strip(F.regexp_replace(segment, "[-_]+", " "))
    return F.when(words == "", "Untitled Document").otherwise(title_case(words))


def derive_title(text: Column, url: Column) -> Column:
    """The first line of three characters or more, else a name from the URL."""
    first = F.get(F.filter(F.transform(F.split(blank(text), r"\R|[\x1c-\x1e]"), strip), lambda t: F.length(t) >= 3), 0)
    return F.coalesce(F.substring(first, 1, SNIPPET), title_from_url(url))


def last_amended(c: Column) -> Column:
    """January 1st of the greatest year that stands alone in the text, else null."""
    years = F.regexp_extract_all(blank(c), F.lit(rf"(?<!{_W})(?:19|20)\d{{2}}(?!{_W})"), 0)
    return F.make_date(F.array_max(F.transform(years, lambda y: y.cast("int"))), F.lit(1), F.lit(1))


def resolve_country(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in COUNTRY_ALIASES.items() for x in kv])
    return F.element_at(known, F.lower(strip(blank(c))))


_DB, _CANONICAL = r"^(\d+)\.(\d+)([a-z]?)$", r"^P(\d+)-I(\d+)([a-z]?)$"


def indicator(c: Column, strict: bool = False) -> Column:
    """P6-I1a from 6.1a or P6-I1a; other text is an error if strict, else itself, stripped."""
    s = strip(blank(c))

    def made(pattern: str) -> Column:
        part = lambda k: F.regexp_extract(s, pattern, k)
        number = lambda k: F.when(part(k).rlike("^0*$"), "0").otherwise(F.regexp_replace(part(k), "^0+", ""))
        return F.concat(F.lit("P"), number(1), F.lit("-I"), number(2), part(3))

    other = F.raise_error(F.concat(F.lit("malformed indicator: "), s)).cast("string") if strict else s
    return F.when(s.rlike(_DB), made(_DB)).when(s.rlike(_CANONICAL), made(_CANONICAL)).otherwise(other)


def indicator_db(c: Column) -> Column:
    """6.1a from either form."""
    return F.regexp_replace(indicator(c), r"^P(\d+)-I(\d+)([a-z]?)$", "$1.$2$3")


def pillar_of(c: Column) -> Column:
    return F.regexp_extract(indicator(c), r"^P(\d+)-", 1).try_cast("int")


def verbatim_clause(text: Column, start: Column, keyword: Column) -> Column:
    """The clause around the keyword at start (from 1): up to the nearest full stop, semicolon or line end on each side, at most SNIPPET characters around the keyword."""
    before, after = F.substring(text, F.lit(1), start - 1), F.substring(text, start + F.length(keyword), F.length(text))
    for end in (".", ";", "\n"):
        before, after = F.substring_index(before, end, -1), F.substring_index(after, end, 1)
    middle = F.substring(text, start, F.length(keyword))
    clause = strip(F.concat(before, middle, after))
    window = F.greatest(F.lit(0), F.length(before) - SNIPPET // 2)
    return F.when(F.length(clause) > SNIPPET, strip(F.substring(clause, window + 1, F.lit(SNIPPET)))).otherwise(clause)


def rationale(keyword: Column, code: Column) -> Column:
    return F.substring(F.concat(F.lit("Matched keyword '"), keyword, F.lit("' in document text; mapped to indicator "), code, F.lit(" by the deterministic mock keyword table.")), 1, SNIPPET)


#: Pairs whose lengths' product is at most this are compared inside the JVM, cell by cell; longer ones in Arrow batches, by bounds and bits.
PLAIN_CELLS = 10_000


#: Characters after a mismatch that decide how an alignment goes on, and characters compared at a time.
_AHEAD, _RUN = 32, 256


def edit_bounds(x, y) -> tuple[int, int]:
    """Bounds of the Levenshtein distance of two arrays of code points, in linear time.

    No alignment pairs more equal characters than the texts have in common, in any order: that is the
    lower bound. The upper one is the cost of one alignment, which at each mismatch takes the step that
    goes on longest without the next one, or just the longer text's length once that alignment costs more than the lower
    bound. Characters that the other text has nowhere can't be matched and are replaced.
    """
    import numpy as np

    letters, count = np.unique(x, return_counts=True)
    others, count_y = np.unique(y, return_counts=True)
    _, at, at_y = np.intersect1d(letters, others, assume_unique=True, return_indices=True)
    lower = max(len(x), len(y)) - int(np.minimum(count[at], count_y[at_y]).sum())
    alone, alone_y = ~np.isin(x, others), ~np.isin(y, letters)

    def apart(i: int, j: int, n: int):
        n = min(n, len(x) - i, len(y) - j)
        return (x[i : i + n] != y[j : j + n]) & ~(alone[i : i + n] & alone_y[j : j + n])

    i = j = cost = 0
    while i < len(x) and j < len(y):
        if cost > lower:
            return lower, max(len(x), len(y))
        miss = apart(i, j, _RUN)
        n = int(miss.argmax()) if miss.any() else len(miss)
        cost += int(np.count_nonzero(alone[i : i + n]))
        i, j = i + n, j + n
        if n < len(miss):
            cost += 1
            looks = [(apart(i + di, j + dj, _AHEAD), di, dj) for di, dj in ((1, 1), (1, 0), (0, 1))]
            _, di, dj = max(looks, key=lambda v: int(v[0].argmax()) if v[0].any() else len(v[0]))
            i, j = i + di, j + dj
    return lower, cost + len(x) - i + len(y) - j


def edit_distance_bits(a: str, b: str) -> int:
    """The Levenshtein distance of two texts: where edit_bounds() meet, that; else a column of the table at a time as two bit vectors (of rises and falls from row to row), so that memory is linear and a machine word holds 64 rows."""
    import numpy as np

    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    a, b = sorted((a[: len(a) - end], b[: len(b) - end]), key=len)
    if not a:
        return len(b)
    letters = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower, upper = edit_bounds(letters, np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32))
    if lower == upper:
        return lower
    at = {chr(c): int.from_bytes(np.packbits(letters == c, bitorder="little").tobytes(), "little") for c in np.unique(letters)}
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, distance = every, 0, len(a)
    for c in b:
        same = at.get(c, 0) | fall
        level = (((same & rise) + rise) ^ rise) | same
        up, down = fall | (every & ~(level | rise)), level & rise
        distance += bool(up & last) - bool(down & last)
        up = (up << 1) | 1
        rise, fall = ((down << 1) | ~(level | up)) & every, up & level
    return distance


def edit_distance(a: Column, b: Column) -> Column:
    """The Levenshtein distance of two texts of any length and alphabet, by code points; null if either is."""
    import pandas as pd

    short = F.length(a).cast("long") * F.length(b) <= PLAIN_CELLS
    long = F.pandas_udf(lambda x, y: pd.Series([None if p is None or q is None else edit_distance_bits(p, q) for p, q in zip(x.astype(object).where(x.notna(), None), y.astype(object).where(y.notna(), None), strict=True)], dtype="Int64"), "long")
    # Short pairs are null to the Arrow function, which costs them nothing.
    return F.when(short, F.levenshtein(a, b).cast("long")).otherwise(long(F.when(~short, a), F.when(~short, b)))


def character_error_rate(reference: Column, hypothesis: Column, normalize: bool = True) -> Column:
    """Edit distance over the reference's length; 0 if both are empty, 1 if only the reference is."""
    r, h = (collapse(blank(c)) if normalize else blank(c) for c in (reference, hypothesis))
    return F.when((r == "") & (h == ""), 0.0).when(r == "", 1.0).otherwise(edit_distance(r, h) / F.length(r))


def money2(c: Column) -> Column:
    """Two decimals, the exact binary value rounded as printf does."""
    return F.format_string("%.2f", F.bround(c, 2))


def excerpt(summary: Column, labels: Column, warnings: Column) -> Column:
    """A guide section's optional lines, joined; empty ones are left out."""
    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", F.nullif(blank(summary), F.lit("")), line("Relevant labels", F.array_join(F.array_sort(labels), ", ")), line("Warnings", F.array_join(warnings, "; ")))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.65, "mid").otherwise("low")


def salvage_json(c: Column) -> Column:
    """The text if it is JSON, else from its first to its last brace if that is, else null."""
    inner = F.regexp_extract(blank(c), r"(\{[\s\S]*\})", 1)
    return F.when(F.try_parse_json(c).isNotNull(), c).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)
