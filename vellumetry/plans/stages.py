"""Stages that call a model or a renderer, and what becomes of their failures.

No model ships with this package. A stage takes a factory, called once in each Python worker, whose result is
called with each row's value; recognition, rendering, embedding and perceptual distance all have this form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def model_stage(df: DataFrame, columns: list[str], output: str, kind: str, factory: Callable[[], Callable[..., Any]]) -> DataFrame:
    """df with `output` (null on failure) and `error` (null on success). One bad row does not end the run."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, T._parse_datatype_string(kind)), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for b in batches:
            values, errors = [], []
            for args in zip(*(b[c] for c in columns), strict=True):
                try:
                    values.append(call(*args))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any failure of a model is the row's
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(**{output: pd.Series(values, index=b.index, dtype=object), "error": pd.Series(errors, index=b.index, dtype=object)})

    return df.mapInPandas(run, schema)


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What went well, and the quarantine."""
    return df.filter("error is null").drop("error"), df.filter("error is not null")


def strict(df: DataFrame) -> DataFrame:
    """Raises at the first error."""
    return df.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error("error").cast("string")))


def or_empty(df: DataFrame, text: str) -> DataFrame:
    """A failed text is empty."""
    return df.withColumn(text, F.coalesce(text, F.lit(""))).drop("error")
