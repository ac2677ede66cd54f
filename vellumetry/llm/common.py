"""What the operators share: the shared folder, written tables, state of a Python worker."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on one machine (tests) a local one, which is then set.

    A cluster's machines share no local folder, so there the setting must be there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "vellumetry-shared")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vellumetry/{name}-{uuid.uuid4().hex}"


_MADE: ContextVar[list[str] | None] = ContextVar("written tables", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of the tables that `written` makes meanwhile, in this thread."""
    token = _MADE.set(paths := [])
    try:
        yield paths
    finally:
        _MADE.reset(token)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if (paths := _MADE.get()) is not None:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def done_with(*tables: DataFrame) -> None:
    """Deletes tables made by `written`: all that was made of them is written itself."""
    for t in tables:
        removed(t.sparkSession, [t.written_to])


def labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """rows with the columns of labels, which has one row per key and `n`, how many of the rows have it.

    A key that more than a hundred-thousandth of all rows have would be one task's work in a sort-merge join, so
    such keys' labels are broadcast: there cannot be more than a hundred thousand of them.
    """
    many = max(10_000, (labels.agg(F.sum("n")).head()[0] or 0) // 100_000)
    hot, rest = labels.filter(F.col("n") > many).drop("n"), labels.filter(F.col("n") <= many).drop("n")
    out = rows.join(rest.hint("merge"), key)
    return out if hot.isEmpty() else out.unionByName(rows.join(F.broadcast(hot), key))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def worker_state(key: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps over its tasks (models, bounded caches)."""
    kept = sys.modules.setdefault("_vellumetry_worker", types.ModuleType("_vellumetry_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def unused_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not have yet."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish = f"_{wish}"
    return wish


def few_rows(batches: Iterator, rows: int = 2000, size: int = 32 << 20) -> Iterator:
    """Arrow batches cut into slices of so many rows, or of about so many bytes."""
    for b in batches:
        n = b.num_rows
        step = max(1, min(rows, int(size * n / max(1, b.nbytes)))) if n else 1
        for at in range(0, n, step):
            yield b.slice(at, step)
