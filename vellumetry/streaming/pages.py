"""Page scores as a stream: issue counts that stay current while pages arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import LEVELS
from ..operators.pages import levelled


def issue_counts(pages: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours", by: str = "model") -> DataFrame:
    """Pages of each level by window and model; pages later than `late` are left out once their window has closed."""
    marked = levelled(pages).withWatermark(time, late)
    counts = [F.count_if(F.col("issue_level") == level).alias(name) for level, name in zip(LEVELS, ("ok", "minor", "moderate", "severe"), strict=True)]
    return marked.groupBy(F.window(time, window), by).agg(F.count("*").alias("pages"), *counts).select("window.start", by, "pages", *[c for c in ("ok", "minor", "moderate", "severe")])
