"""Pairs of documents and pages, and what their page scores say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import LEVELS, MISMATCH, issue_level

#: Documents that one run compares at most (fixed value).
TOP = 115


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, "(?<=.)\\.[^.]+$", "")


def document_pairs(expected: DataFrame, actual: DataFrame, name: str = "name", top: int | None = TOP) -> DataFrame:
    """base, expected name, actual name of the documents that both sides have, by name, the first `top`."""
    a = expected.select(base_name(F.col(name)).alias("base"), F.col(name).alias("expected"))
    b = actual.select(base_name(F.col(name)).alias("base"), F.col(name).alias("actual"))
    pairs = a.join(b, "base").select("base", "expected", "actual").orderBy("expected")
    return pairs.limit(top) if top else pairs


def positional_pages(expected: DataFrame, actual: DataFrame, doc: str, page: str, value: str) -> DataFrame:
    """The i-th page of one side beside the i-th of the other: doc, page, expected, actual.

    A document whose sides have different page counts, one of them perhaps none, gives one row with null page and
    values instead.
    """

    def placed(d: DataFrame, name: str) -> DataFrame:
        return d.select(doc, F.row_number().over(Window.partitionBy(doc).orderBy(page, value)).alias("page"), F.lit(True).alias(f"in_{name}"), F.col(value).alias(name))

    both = placed(expected, "expected").join(placed(actual, "actual"), [doc, "page"], "full")
    uneven = F.max(F.col("in_expected").isNull() | F.col("in_actual").isNull()).over(Window.partitionBy(doc))
    both = both.withColumn("mismatch", uneven).filter(~F.col("mismatch") | (F.col("page") == 1))
    even = lambda c: F.when(~F.col("mismatch"), F.col(c))
    return both.select(doc, even("page").cast("int").alias("page"), even("expected").alias("expected"), even("actual").alias("actual"), "mismatch")


def levelled(pages: DataFrame, cosine: str = "cosine", lpips: str = "lpips", mismatch: Column | None = None) -> DataFrame:
    level = issue_level(F.col(cosine), F.col(lpips))
    return pages.withColumn("issue_level", F.when(mismatch, MISMATCH).otherwise(level) if mismatch is not None else level)


def issue_summary(pages: DataFrame, doc: str = "doc_id", by: list[str] | None = None) -> DataFrame:
    """Documents, pages without mismatch rows, pages of each level, documents with a mismatch."""
    odd = F.col("issue_level") == MISMATCH
    counts = [F.count_if(F.col("issue_level") == level).alias(name) for level, name in zip(LEVELS, ("ok", "minor", "moderate", "severe"), strict=True)]
    return pages.groupBy(*(by or [])).agg(F.countDistinct(doc).alias("documents"), F.count_if(~odd).alias("pages"), *counts, F.countDistinct(F.when(odd, F.col(doc))).alias("mismatch_docs"))
