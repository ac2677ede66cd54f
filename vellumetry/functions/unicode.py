"""What Spark has no expression for: Unicode forms, sequence ratios, lenient decoding. Arrow-batched."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cyrillic letters that look like Roman numerals, and these (fixed values).
ROMAN = {"І": "i", "Ї": "i", "Х": "x", "С": "c", "В": "v", "М": "m", "Д": "d", "Л": "l"}


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, then letters, digits, spaces and - _ . only."""
    return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if c.isalnum() or c in " -_."), na_action="ignore")


@F.pandas_udf(T.StringType())
def roman_numerals(s: pd.Series) -> pd.Series:
    """Numeral words written with Cyrillic look-alikes, in Latin letters. Upper-case look-alikes only, so folded text stays as it is."""
    table = str.maketrans(ROMAN)
    word = re.compile(rf"\b[ivxlcdm{''.join(ROMAN)}]+\b", re.IGNORECASE)
    return s.map(lambda x: word.sub(lambda m: m[0].translate(table), x), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio of matching characters."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def utf8_lenient(s: pd.Series) -> pd.Series:
    """Bytes as UTF-8, bad bytes dropped; a byte-order mark stays."""
    return s.map(lambda x: bytes(x).decode("utf-8", "ignore"), na_action="ignore")
