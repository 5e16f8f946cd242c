"""Rate budgets over a stream of uses, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.policy import USES, WINDOW_SECONDS


def windowed_uses(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = WINDOW_SECONDS, slide: int | None = None, late: str = "5 minutes", uses: int = USES) -> DataFrame:
    """Uses of each key in each window, and whether they are over the budget. Works on streams and tables alike."""
    slide_by = f"{slide or seconds} seconds"
    at = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    got = at.groupBy(F.window("__at", f"{seconds} seconds", slide_by).alias("w"), key).agg(F.count("*").alias("used"))
    return got.select(F.col("w.start").alias("window_start"), key, "used", (F.col("used") > uses).alias("over_budget"))
