"""Review: filters, summaries, status updates; character error rates; contamination; costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import PLAIN_CELLS, character_error_rate

STATUSES = ("pending", "verified", "rejected")
#: The mean error rate below which a reader passes; an agent's overhead in tokens a turn; page counts of a cost curve.
CER_LIMIT, AGENT_OVERHEAD, PAGE_GRID = 0.05, 600, (1, 5, 10, 25, 50, 100, 250, 500)


def review_filter(findings: DataFrame, status: str | None = None, pillar: int | None = None, words: str = "", columns: tuple[str, ...] = ("title", "provisions", "jurisdiction", "indicator")) -> DataFrame:
    if status:
        findings = findings.filter(F.col("review_status") == status)
    if pillar:
        findings = findings.filter(F.col("pillar") == pillar)
    if words.strip():
        found = F.lit(False)
        for c in columns:
            found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(words.strip().lower()))
        findings = findings.filter(found)
    return findings


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100.0 / whole + 0.5)).cast("long")


def review_summary(findings: DataFrame) -> DataFrame:
    n = {s: F.count_if(F.col("review_status") == s) for s in STATUSES}
    done = n["verified"] + n["rejected"]
    return findings.agg(F.count("*").alias("total"), *[c.alias(s) for s, c in n.items()], percent(done, F.count("*")).alias("progress"))


def with_review(findings: DataFrame, updates: DataFrame) -> DataFrame:
    """findings with new statuses by id; of several updates the last by pos counts, unknown ids do nothing."""
    last = updates.groupBy("id").agg(F.max_by("review_status", "pos").alias("new"))
    return findings.join(last, "id", "left").withColumn("review_status", F.coalesce("new", "review_status")).drop("new")


def error_rates(samples: DataFrame, normalize: bool = True) -> DataFrame:
    """samples (reference, hypothesis, ..) with cer, of whole texts. Short pairs stay where they are; long ones, each worth a task's while, are dealt evenly to all tasks first."""
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("long")
    short = length("reference") * length("hypothesis") <= PLAIN_CELLS
    cer = character_error_rate(F.col("reference"), F.col("hypothesis"), normalize).alias("cer")
    width = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return samples.filter(short).select("*", cer).unionByName(samples.filter(~short).repartition(width).select("*", cer))


def cer_report(samples: DataFrame, normalize: bool = True) -> DataFrame:
    """mean, n, passed of samples (reference, hypothesis); nothing is a mean of 0 and passes."""
    got = error_rates(samples.select("reference", "hypothesis"), normalize)
    mean = F.coalesce(F.avg("cer"), F.lit(0.0))
    return got.agg(mean.alias("mean_cer"), F.count("*").alias("n"), (mean < CER_LIMIT).alias("passed"))


def contamination(texts: DataFrame, terms: tuple[str, ...], key: str) -> DataFrame:
    """How often each boilerplate term occurs in each text."""
    low = F.lower(F.coalesce("text", F.lit("")))
    counts = F.array(*[F.struct(F.lit(t).alias("term"), ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("long").alias("n")) for t in terms])
    return texts.select(key, F.explode(counts).alias("t")).select(key, "t.term", "t.n")


def amortization(costs: DataFrame, grid: tuple[int, ...] = PAGE_GRID) -> DataFrame:
    """Total and mean cost by pages read, beside an agent that reads each page raw.

    costs: (key, one_time, per_page, raw), a row for each layout. The grid is a fixed list of numbers.
    """
    g = costs.withColumn("pages", F.explode(F.array(*[F.lit(n).cast("long") for n in grid])))
    total, agent = F.col("one_time") + F.col("pages") * F.col("per_page"), F.col("pages") * (F.col("raw") + AGENT_OVERHEAD)
    return g.select("key", "pages", total.alias("pipeline_total"), agent.alias("agent_total"), F.try_divide(agent.cast("double"), total).alias("savings"))


def stage_costs(calls: DataFrame) -> DataFrame:
    """Calls (stage, text): their number, characters, distinct contents."""
    return calls.groupBy("stage").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("chars"), F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"))
