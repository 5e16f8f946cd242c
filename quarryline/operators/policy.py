"""Compliant retrieval: decisions on access signals, the retry loop, and rate budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of statuses that block, throttle, or call for a fallback.
BLOCKING, THROTTLED, MISSING = ("captcha", "challenge", "forbidden", "auth", "identity"), ("throttle", "rate"), ("missing", "not_found")
#: Uses and seconds of a rate window.
USES, WINDOW_SECONDS = 5, 60


def _any(statuses: Column, words: tuple[str, ...]) -> Column:
    return F.exists(statuses, lambda s: F.lower(s).rlike("|".join(words)))


#: The decisions, the first that holds counting: its sign, whether tries must be left (None: no matter), its kind and reason.
DECISIONS = (
    ("unauthorized", None, "deny", "policy not authorized"),
    ("blocking", None, "handoff", "blocking access signal detected"),
    ("throttled", True, "retry_later", "throttled or rate limited"),
    ("throttled", False, "handoff", "throttling persisted beyond retry budget"),
    ("error", True, "retry_later", "error severity signal"),
    ("error", False, "deny", "error severity persisted beyond retry budget"),
    ("replaceable", None, "use_approved_fallback", "approved fallback available for missing content"),
    ("", None, "allow", "allowed"),
)


def decide(authorized: Column, statuses: Column, has_error: Column, attempt: Column, max_retries: Column, fallbacks: Column) -> Column:
    """The decision of one attempt, by DECISIONS: its kind, reason and fallback address."""
    signs = {
        "unauthorized": ~authorized, "blocking": _any(statuses, BLOCKING), "throttled": _any(statuses, THROTTLED), "error": has_error,
        "replaceable": (F.size(fallbacks) > 0) & _any(statuses, MISSING), "": F.lit(True),
    }
    rows = [
        F.when(signs[sign] & (F.lit(True) if left is None else (attempt <= max_retries) == left), F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), (F.get(fallbacks, 0) if sign == "replaceable" else F.lit(None).cast("string")).alias("fallback_url")))
        for sign, left, kind, reason in DECISIONS
    ]
    return F.coalesce(*rows)


#: What a judged fetch leads to: whether it ends the retrieval with content, without content, and on the last try; whether it goes on elsewhere.
_LEADS = {"allow": (True, False, False, False), "handoff": (True, True, True, False), "deny": (True, True, True, False), "retry_later": (False, False, True, False), "use_approved_fallback": (False, False, False, True)}
_ROW = "struct<url:string,attempt:int,kind:string,reason:string,final:boolean,fallback_used:string>"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def retrieve(policies: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The audit trail of fetching each policy's source, the last event of which is the result.

    policies: (requested_url, source_url, authorized, rate_limit_budget, max_retries,
    approved_fallback_urls), a row for each source. outcomes: (source_url, url, nth, statuses,
    has_error, ok), what the nth fetch of url gives; the last one stands for all later ones, and an
    address without any can't be fetched.

    A retrieval is at the source or at its first fallback, and each fetch costs one of its budget, so
    it is a fold over as many steps as that; only so many outcomes of an address matter, and they are
    all that is gathered. Each outcome is judged before, with tries left and without, and _LEADS says
    where that leads.
    """
    judge = lambda statuses, error, left: decide(F.lit(True), statuses, error, F.lit(0 if left else 1), F.lit(0), F.col("approved_fallback_urls"))
    none = F.array().cast("array<string>")
    other = F.get("approved_fallback_urls", 0)
    known = policies.withColumn("gone", F.struct(F.lit(False).alias("ok"), judge(none, F.lit(True), True).alias("left"), judge(none, F.lit(True), False).alias("spent")))
    rows = outcomes.join(policies.select("source_url", "approved_fallback_urls", "rate_limit_budget"), "source_url").filter((F.col("url") == F.col("source_url")) | (F.col("url") == other))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("source_url", "url").orderBy("nth"))).filter(F.col("k") <= F.col("rate_limit_budget"))
    judged = F.struct("k", "ok", judge(F.col("statuses"), F.col("has_error"), True).alias("left"), judge(F.col("statuses"), F.col("has_error"), False).alias("spent"))
    told = lambda here: F.transform(F.array_sort(F.collect_list(F.when(here, judged))), lambda o: F.struct(o["ok"].alias("ok"), o["left"].alias("left"), o["spent"].alias("spent")))
    at_source = F.col("url") == F.col("source_url")
    queues = rows.groupBy("source_url").agg(told(at_source).alias("first"), told(~at_source).alias("second"))
    p = known.join(queues, "source_url", "left")

    early = F.when(F.col("requested_url") != F.col("source_url"), "source URL does not match retrieval policy").when(~F.col("authorized"), "policy not authorized")
    row = lambda url, attempt, kind, reason, final, used: F.struct(url.alias("url"), attempt.cast("int").alias("attempt"), kind.alias("kind"), reason.alias("reason"), final.alias("final"), used.alias("fallback_used"))
    no_rows = F.array().cast(f"array<{_ROW}>")
    denied = F.array(row(F.col("requested_url"), F.lit(1), F.lit("deny"), early, F.lit(True), F.lit(None).cast("string")))
    start = F.struct(early.isNotNull().alias("done"), F.lit(False).alias("moved"), F.lit(1).alias("attempt"), F.lit(0).alias("k"), F.when(early.isNotNull(), denied).otherwise(no_rows).alias("rows"))
    most = F.greatest(F.lit(1), F.col("max_retries") + 1)

    def step(s: Column, i: Column) -> Column:
        url, used = F.when(s["moved"], other).otherwise(F.col("source_url")), F.when(s["moved"], other)
        queue = F.when(s["moved"], F.col("second")).otherwise(F.col("first"))
        outcome = F.coalesce(F.get(queue, F.least(s["k"], F.size(queue) - 1)), F.col("gone"))
        judged_now = F.struct(outcome["ok"].alias("ok"), F.when(s["attempt"] <= F.col("max_retries"), outcome["left"]).otherwise(outcome["spent"]).alias("v"), url.alias("url"), used.alias("used"))
        return _let(judged_now, lambda o: _let(led(o), lambda x: moved_on(s, i, o, x)))

    def led(o: Column) -> Column:
        """Kind and reason, and where they lead."""
        stuck = (o["v"]["kind"] == "use_approved_fallback") & (o["v"]["fallback_url"] == o["url"])
        kind = F.when(stuck, "handoff").otherwise(o["v"]["kind"])
        leads = F.element_at(F.create_map(*[x for k, v in _LEADS.items() for x in (F.lit(k), F.struct(*[F.lit(f).alias(n) for n, f in zip(("content", "without", "last", "goes"), v, strict=True)]))]), kind)
        return F.struct(kind.alias("kind"), F.when(stuck, "approved fallback unavailable").otherwise(o["v"]["reason"]).alias("reason"), leads.alias("to"))

    def moved_on(s: Column, i: Column, o: Column, x: Column) -> Column:
        last, goes, over = s["attempt"] >= most, x["to"]["goes"], i >= F.col("rate_limit_budget")
        ends = (o["ok"] & x["to"]["content"]) | x["to"]["without"] | (last & x["to"]["last"])
        fetched = row(o["url"], s["attempt"], x["kind"], x["reason"], ends, F.when(goes, other).otherwise(o["used"]))
        # The last try is over without content: the retrieval is, too.
        empty = F.when(~ends & ~goes & last, F.array(row(o["url"], s["attempt"], F.lit("retry_later"), F.lit("retrieval completed without compliant content"), F.lit(True), o["used"]))).otherwise(no_rows)
        spent = row(o["url"], s["attempt"], F.lit("retry_later"), F.lit("rate limit budget exhausted"), F.lit(True), o["used"])
        new = F.when(s["done"], no_rows).when(over, F.array(spent).cast(f"array<{_ROW}>")).otherwise(F.concat(F.array(fetched).cast(f"array<{_ROW}>"), empty.cast(f"array<{_ROW}>")))
        return F.struct(
            (s["done"] | over | ends | (last & ~goes)).alias("done"), (s["moved"] | (~over & goes)).alias("moved"), (s["attempt"] + F.when(goes, 0).otherwise(1)).alias("attempt"), F.when(goes, 0).otherwise(s["k"] + 1).alias("k"),
            F.concat(s["rows"], new).alias("rows"),
        )

    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("rate_limit_budget").cast("int")))
    trail = p.select("source_url", F.posexplode(F.aggregate(steps, start.cast(f"struct<done:boolean,moved:boolean,attempt:int,k:int,rows:array<{_ROW}>>"), lambda s, i: step(s, i).cast(f"struct<done:boolean,moved:boolean,attempt:int,k:int,rows:array<{_ROW}>>"), lambda s: s["rows"])).alias("step", "r"))
    return trail.select("source_url", "step", "r.*")


def rate_budget(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = WINDOW_SECONDS, uses: int = USES) -> DataFrame:
    """events with used, how many of the key fall in the seconds before and at each, a use just that old not counted, and over_budget."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("used", F.count("*").over(w)).withColumn("over_budget", F.col("used") > uses)


def origin_of(url: Column) -> Column:
    """Scheme, host and port of an address, in lower case; its rules are kept by it."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(origin, rules array<struct<allow,path>>) of robots files (origin, text): the rules for the agent, in order: of the groups that name it, else of those for all agents.

    An agent's name is compared by its first part, in any case. A file without text has no rules.
    """
    name = agent.split("/")[0].strip().lower()
    kind = "array<struct<allow:boolean,path:string>>"
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\R"), lambda l: F.regexp_replace(l, "#.*$", ""))
    pairs = F.transform(F.filter(lines, lambda l: F.contains(l, F.lit(":"))), lambda l: F.struct(F.lower(F.trim(F.substring_index(l, ":", 1))).alias("key"), F.trim(F.regexp_replace(l, "^[^:]*:", "")).alias("value")))
    empty = F.array().cast(kind)
    start = F.struct(F.lit(False).alias("ruled"), F.lit(False).alias("mine"), F.lit(False).alias("every"), F.lit(False).alias("named"), empty.alias("own"), empty.alias("rest"))

    def step(s: Column, p: Column) -> Column:
        is_agent, is_rule = p["key"] == "user-agent", p["key"].isin("allow", "disallow")
        value = F.lower(F.trim(F.substring_index(p["value"], "/", 1)))
        fits = is_agent & (value != "") & (value != "*") & F.contains(F.lit(name), value)
        # An agent line after rules opens a new group.
        mine = F.when(is_agent, (s["mine"] & ~s["ruled"]) | fits).otherwise(s["mine"])
        every = F.when(is_agent, (s["every"] & ~s["ruled"]) | (p["value"] == "*")).otherwise(s["every"])
        rule = F.array(F.struct(((p["key"] == "allow") | (p["value"] == "")).alias("allow"), p["value"].alias("path"))).cast(kind)
        return F.struct(
            (is_rule | (s["ruled"] & ~is_agent)).alias("ruled"), mine.alias("mine"), every.alias("every"), (s["named"] | mine).alias("named"),
            F.when(is_rule & s["mine"], F.concat(s["own"], rule)).otherwise(s["own"]).alias("own"), F.when(is_rule & s["every"], F.concat(s["rest"], rule)).otherwise(s["rest"]).alias("rest"),
        )

    return files.select("origin", F.aggregate(pairs, start, step, lambda s: F.when(s["named"], s["own"]).otherwise(s["rest"])).alias("rules"))


def robots_patterns(rules: Column) -> Column:
    """Rules with the patterns of their paths, so that many addresses need them made once. In a rule * is anything, and a closing $ the end."""
    # Quoted but for * and a closing $.
    pattern = lambda p: F.concat(F.lit(r"^\Q"), F.regexp_replace(F.regexp_replace(p, r"\$$", ""), r"\*+", r"\\E.*\\Q"), F.when(p.rlike(r"\$$"), r"\E$").otherwise(r"\E"))
    return F.transform(rules, lambda r: F.struct(r["allow"].alias("allow"), r["path"].alias("path"), pattern(r["path"]).alias("pattern")))


def robots_allowed(url: Column, rules: Column) -> Column:
    """Whether the first rule that an address's path and query fit allows it; no fitting rule does, unknown rules (null) don't."""
    return allowed_by(url, robots_patterns(rules))


def allowed_by(url: Column, patterns: Column) -> Column:
    """robots_allowed, with the rules' patterns made before."""
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(F.when(path.rlike("^/"), path).otherwise(F.concat(F.lit("/"), path)), "#.*$", "")
    # An array of one path names it inside the lambda, so it is made once for all rules.
    fits = F.flatten(F.transform(F.array(path), lambda u: F.filter(patterns, lambda r: (r["path"] == "") | F.regexp_like(u, r["pattern"]))))
    return F.when(patterns.isNull(), False).otherwise(F.coalesce(F.get(fits, 0)["allow"], F.lit(True)))


def robots_gate(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Addresses whose origin's rules are known and disallow no prefix of their path; an unknown origin is refused.

    urls: (url, origin, path); rules: (origin, disallow array<string>), a row for each origin.
    """
    held = urls.join(rules, "origin", "left")
    return held.withColumn("allowed", F.coalesce(~F.exists("disallow", lambda d: (d != "") & F.startswith(F.col("path"), d)), F.lit(False))).drop("disallow")
