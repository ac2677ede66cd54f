"""Files: scans, text, Markdown and key-value reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim
from ..functions.unicode import utf8_lenient


def file_scan(spark: SparkSession, folder: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """path, name, content (bytes), in order of path when sorted by it. Files are read by the tasks that hold them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    found = (files.option("recursiveFileLookup", "true") if recursive else files).load(folder)
    return found.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")


def text_files(spark: SparkSession, folder: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """path, name, text: UTF-8 with bad bytes dropped."""
    return file_scan(spark, folder, pattern, recursive).select("path", "name", utf8_lenient("content").alias("text"))


def pdf_files(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """PDF files of a folder; strict raises where there are none."""
    found = file_scan(spark, folder, "*.[pP][dD][fF]")
    if strict and found.select("path").isEmpty():
        raise FileNotFoundError(f"no PDF in {folder}")
    return found


def key_values(df: DataFrame, text: str = "text") -> DataFrame:
    """key, value of the lines 'key: value'; blank lines and rules of = are no such lines."""
    line = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    kept = line.filter((trim(F.col("line")) != "") & ~F.col("line").startswith("=") & F.col("line").contains(":"))
    parts = F.split("line", ":", 2)
    return kept.withColumns({"key": trim(parts[0]), "value": trim(parts[1])}).drop("line")
