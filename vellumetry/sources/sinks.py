"""Writers of results."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV part files with headers."""
    df.write.option("header", True).csv(path)


def csv_text(df: DataFrame) -> str:
    """One CSV text with a byte-order mark, for a report small enough to hand over as one file."""
    return BOM + df.toPandas().to_csv(index=False)


def page_files(pages: DataFrame, path: str, doc: str = "doc_id", page: str = "page", text: str = "text") -> None:
    """A folder for each document with a text file for each of its pages (page_0001.yaml). Null texts are empty files.

    Executors write the files, each under a name of its own first, so a task that runs twice leaves whole ones. path:
    any place that Arrow's file systems reach (file, hdfs, s3, gs) and all executors share.
    """
    rows = pages.select(F.col(doc).cast("string").alias("folder"), page_file(F.col(page)).alias("file"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def write(batches):
        system, root = pa_fs.FileSystem.from_uri(path)
        made = set()
        for b in batches:
            for folder, file, body in zip(*(b.column(c).to_pylist() for c in ("folder", "file", "text")), strict=True):
                if folder not in made:
                    system.create_dir(f"{root}/{folder}", recursive=True)
                    made.add(folder)
                part = f"{root}/{folder}/.{file}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(body.encode("utf-8", "surrogatepass"))
                system.move(part, f"{root}/{folder}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def page_file(page: Column) -> Column:
    return F.format_string("page_%04d.yaml", page)


def layout_json(page_index: Column, image_path: Column, text: Column, blocks: Column) -> Column:
    return F.to_json(F.struct(page_index.alias("page_index"), image_path.alias("image_path"), text.alias("text"), blocks.alias("blocks")), {"pretty": "true"})


def perf_text(perf: DataFrame, seconds: float) -> str:
    r = perf.head()
    return f"Processed documents: {r['documents']}\nTotal time: {seconds:.2f} sec\nAverage CPU usage: {r['avg_cpu']} %\nAverage RAM usage: {r['avg_ram_mb']} MB\n"
