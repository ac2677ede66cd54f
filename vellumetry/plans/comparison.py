"""Comparison of two folders of Markdown documents, from files to index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators.tables import extracted_rows, label_rows, markdown_rows, richest_by_code
from ..sources.files import text_files
from .lineage import cut


def sides(docs: DataFrame, sections: str = "cyrillic", unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """Coded rows and rows without code of documents (pair_id, side, text)."""
    keys = ["pair_id", "side"]
    keyed = docs.withColumn("doc_key", F.struct(*keys))
    rows = markdown_rows(keyed, "doc_key", "text").select("doc_key.*", "table_no", "row_no", "cells")
    rows = cut(extracted_rows(rows, keys))
    return richest_by_code(rows, keys), label_rows(rows, keys, sections, unicode)


def compare_documents(docs: DataFrame, sections: str = "cyrillic", unicode: bool = True, exclusive_bare: bool = False) -> DataFrame:
    """Matched rows of every pair (pair_id, side, text). Pairs without tables give none."""
    return M.compared(*sides(docs, sections, unicode), sections, unicode, exclusive_bare)


def compare_folders(spark: SparkSession, gt_folder: str, res_folder: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(matched rows, index) of two folders."""
    gt, res = (text_files(spark, f, recursive=recursive) for f in (gt_folder, res_folder))
    pairs = cut(M.numbered_pairs(M.paired_files(gt, res)))
    side = lambda d, p: pairs.join(d.withColumnRenamed("path", f"{p}_path"), f"{p}_path").select(F.col("folder").alias("pair_id"), F.lit(p).alias("side"), "text")
    rows = cut(compare_documents(side(gt, "gt").unionByName(side(res, "res"))))
    return rows, index_rows(rows, pairs)


def index_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    named = pairs.select(F.col("folder").alias("pair_id"), name("gt_path").alias("gt_name"), name("res_path").alias("res_name"), F.concat("folder", F.lit("/md_compare_report.html")).alias("report_rel"), "pair_reason")
    return named.join(M.pair_summary(rows), "pair_id").select("gt_name", "res_name", "report_rel", "avg_over", "avg_label", "avg_num", "rows_total", "paired_rows", "gt_only_rows", "res_only_rows", "pair_reason")
