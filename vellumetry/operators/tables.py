"""Markdown text to tables, rows, and coded or labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_code, parse_number
from ..functions.text import alignment_row, blank_row, has_letters, lines, normalize, strip_html, trim


def islands(df: DataFrame, key: str, order: str, member: Column) -> DataFrame:
    """df's rows for which `member` holds, with the island (run of such rows in order) that they are in.

    `order` numbers all rows of a key without gaps. Rows that follow each other share it minus their rank
    among members, so the other rows need not move.
    """
    return df.filter(member).withColumn("island", F.col(order) - F.row_number().over(Window.partitionBy(key).orderBy(order)))


def pipe_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line, island: trimmed lines that start and end with a pipe."""
    each = df.select(key, F.posexplode(F.transform(lines(F.col(text)), trim)).alias("line_no", "line"))
    return islands(each, key, "line_no", F.col("line").startswith("|") & F.col("line").endswith("|"))


def markdown_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, table_no and row_no (from 0), cells: rows of tables of two or more lines, without the separator below the head."""
    island = Window.partitionBy(key, "island")
    rows = pipe_lines(df, key, text).withColumn("n", F.count("*").over(island)).filter("n >= 2")
    rows = rows.withColumn("at", F.row_number().over(island.orderBy("line_no")) - 1)
    inner = F.when(F.length("line") >= 2, F.expr("substring(line, 2, length(line) - 2)")).otherwise("")
    rows = rows.withColumn("cells", F.transform(F.split(inner, "\\|", -1), trim)).filter(~((F.col("at") == 1) & alignment_row(F.col("cells"))))
    return rows.select(
        key,
        (F.dense_rank().over(Window.partitionBy(key).orderBy("island")) - 1).alias("table_no"),
        (F.row_number().over(island.orderBy("line_no")) - 1).alias("row_no"),
        "cells",
    )


def extracted(cells: Column) -> Column:
    """(code, label, start, end) of a row.

    The code is the first cell of three or four digits. The label is the nearest cell with letters left of the
    code, else the first right of it; without a code, the first of the row. Numbers are the first two right
    of the code, or of the row.
    """
    at = F.array_position(F.transform(cells, is_code), F.lit(True)).cast("int")
    label = lambda part: F.filter(F.transform(part, lambda c: trim(strip_html(F.coalesce(c, F.lit(""))))), has_letters)
    left = F.reverse(label(F.slice(cells, 1, F.greatest(at - 1, F.lit(0)))))
    right = F.when(at > 0, F.slice(cells, at + 1, F.size(cells))).otherwise(cells)
    numbers = F.filter(F.transform(right, parse_number), lambda n: n.isNotNull())
    return F.struct(
        F.when(at > 0, trim(strip_html(F.get(cells, at - 1)))).alias("code"),
        F.coalesce(F.get(left, F.lit(0)), F.get(label(right), F.lit(0)), F.lit("")).alias("label"),
        F.get(numbers, F.lit(0)).alias("start"),
        F.get(numbers, F.lit(1)).alias("end"),
    )


def extracted_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal (order in the document), code, label, start, end of rows that are not blank. Table keys stay for the order."""
    got = rows.filter(~blank_row(F.col("cells"))).withColumn("r", extracted(F.col("cells")))
    ordinal = F.row_number().over(Window.partitionBy(*keys).orderBy("table_no", "row_no")) - 1
    return got.select(*keys, ordinal.alias("ordinal"), "r.code", "r.label", "r.start", "r.end")


def richest_by_code(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of a code, the first with the most numbers."""
    n = F.col("start").isNotNull().cast("int") + F.col("end").isNotNull().cast("int")
    best = F.min_by(F.struct("ordinal", "label", "start", "end"), F.struct((-n).alias("n"), "ordinal")).alias("r")
    return rows.filter("code is not null").groupBy(*keys, "code").agg(best).select(*keys, "code", "r.ordinal", "r.label", "r.start", "r.end")


def label_rows(rows: DataFrame, keys: list[str], sections: str = "cyrillic", unicode: bool = True) -> DataFrame:
    """Rows without a code whose label says something, numbered in order."""
    norm = normalize(F.col("label"), sections, unicode)
    kept = rows.filter("code is null").withColumn("norm", norm).filter("norm <> ''")
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal")) - 1)
