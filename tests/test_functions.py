import math

import pytest
from pyspark.sql import functions as F

from vellumetry.functions import numbers as N
from vellumetry.functions import quality as Q
from vellumetry.functions import similarity as S
from vellumetry.functions import text as T
from vellumetry.functions.unicode import nfkc_casefold, roman_numerals, sequence_ratio, utf8_lenient, without_marks


def each(spark, values, kind, make):
    frame = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, " + kind)
    return [r.out for r in frame.select("i", make().alias("out")).orderBy("i").collect()]


def test_parse_number(spark):
    cells = ["684,4", "6 366,7", "( 4 190,2 )", "-34373", "( - )", "—", "1 Власний", None, "", "<b>12</b>", "2024 04 01", " 7 5", "9" * 39, "abc 5"]
    got = each(spark, cells, "c string", lambda: N.parse_number(F.col("c")))
    assert [None if x is None else int(x) for x in got] == [6844, 63667, -41902, 34373, None, None, None, None, None, 12, 20240401, 75, None, None]


def test_codes(spark):
    assert each(spark, ["1011", "999", "12", "4 874,6", None, " <i>123</i> ", "12345"], "c string", lambda: N.is_code(F.col("c"))) == [True, True, False, False, False, True, False]


def test_relative_error(spark):
    assert each(spark, [(None, None), (1, None), (0, 0), (100, 200)], "a long, b long", lambda: N.relative_error(F.col("a"), F.col("b"))) == [0.0, None, 0.0, 0.5]


def test_number_similarity(spark):
    rows = [(100, 200, None, None), (None, None, None, None), (1, None, None, 1), (100, 100, 50, 100), (1, None, 5, 5), (10, -10, None, None)]
    kind = "gs long, rs long, ge long, re long"
    assert each(spark, rows, kind, lambda: N.number_similarity(*map(F.col, ("gs", "rs", "ge", "re")))) == [0.75, 1.0, None, 0.75, 1.0, 0.5]


def test_number_similarity_with_codes(spark):
    rows = [(None, None, False, False), (None, None, True, True), (None, None, True, False), (1, None, True, True), (4, 2, False, True)]
    got = each(spark, rows, "g long, r long, gc boolean, rc boolean", lambda: N.number_similarity_with_codes(F.col("g"), F.col("r"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.col("gc"), F.col("rc")))
    assert got == [1.0, None, 0.0, 0.0, 0.75]


def test_overall_and_format(spark):
    assert each(spark, [(0.5, None), (0.5, 1.0), (None, 0.25)], "a double, b double", lambda: N.overall_similarity(F.col("a"), F.col("b"))) == [0.5, 0.75, 0.25]
    assert each(spark, [(1, None, "77"), (None, 2, None), (None, None, None)], "s long, e long, c string", lambda: N.format_numbers(F.col("s"), F.col("e"), F.col("c"))) == ["77 1", "2", ""]


def test_normalize(spark):
    texts = ["І. Необоротні активи", "в тому числі", "1. Total<br/>assets", "<b>Bold</b>&x", "mild cheese", "  IV  Part_2 – ﬁne ", None, "Straße", "12", "x. y. z"]
    want = ["необоротні активи", "тому числі", "total assets", "bold x", "cheese", "part_2 fine", None, "strasse", "12", "y z"]
    assert each(spark, texts, "c string", lambda: T.normalize(F.col("c"))) == want
    assert each(spark, ["в тому числі", "IV. b"], "c string", lambda: T.normalize(F.col("c"), "ascii")) == ["в тому числі", "b"]


def test_sets(spark):
    assert each(spark, ["to be or not to be", "", "é é"], "c string", lambda: F.concat_ws(",", T.tokens(F.col("c")))) == ["to,be,or,not", "", "é"]
    assert each(spark, ["a ab", "", "😀"], "c string", lambda: F.size(T.characters(F.col("c")))) == [3, 0, 1]
    assert each(spark, ["to be or nothing"], "c string", lambda: F.concat_ws(",", T.meaningful(T.tokens(F.col("c"))))) == ["nothing"]


def test_label_similarity(spark):
    rows = [("total assets", "total assets"), ("", ""), ("a", ""), ("total assets", "total costs"), ("ab", "cd")]
    make = lambda: S.label_similarity(T.tokens(F.col("a")), T.characters(F.col("a")), T.tokens(F.col("b")), T.characters(F.col("b")))

    def slow(a, b):
        if not a or not b:
            return float(a == b)
        share = lambda x, y: len(x & y) / len(x | y)
        return round(0.5 * share(set(a.split()), set(b.split())) + 0.5 * share(set(a), set(b)), 4)

    assert each(spark, rows, "a string, b string", make) == pytest.approx([slow(*r) for r in rows], abs=1e-4)


def test_token_jaccard_and_cosine(spark):
    assert each(spark, [("a b", "c"), ("total", "total of"), ("one two", "two three")], "a string, b string", lambda: S.token_jaccard(T.meaningful(T.tokens(F.col("a"))), T.meaningful(T.tokens(F.col("b"))))) == [1.0, 1.0, pytest.approx(1 / 3)]
    assert each(spark, [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>", lambda: S.cosine(F.col("a"), F.col("b"))) == [pytest.approx(math.sqrt(0.5)), None]


def test_issue_levels(spark):
    rows = [(0.9994, 0.2343), (0.9847, 0.1264), (0.9797, 0.1453), (0.9741, 0.7773), (0.8547, 0.3694), (float("nan"), 0.1), (None, 0.1), (0.99, 0.5), (0.95, 0.0)]
    want = [Q.LEVELS[i] for i in (0, 0, 1, 2, 3, 3, 3, 1, 2)]
    assert each(spark, rows, "c double, p double", lambda: Q.issue_level(F.col("c"), F.col("p"))) == want


def test_other_classes(spark):
    rows = [(0.98, 0.11), (0.97, 0.22), (0.92, 0.75), (0.91, 0.0), (float("nan"), 0.1)]
    assert each(spark, rows, "c double, p double", lambda: Q.strict_class(F.col("c"), F.col("p"))) == ["OK", "Minor", "Moderate", "Severe", "Severe"]
    rows = [(0.99, 0.11), (0.98, 0.11), (0.1, 0.4), (1.0, 0.41), (float("nan"), 0.1), (1.0, float("nan"))]
    assert each(spark, rows, "c double, p double", lambda: Q.perceptual_class(F.col("c"), F.col("p"))) == ["OK", "Minor", "Moderate", "Severe", "Minor", "Severe"]
    assert each(spark, ["OK ✅", "minor x", "SEVERE", "none"], "c string", lambda: Q.printed_class(F.col("c"))) == ["OK", "Minor", "Severe", None]
    assert each(spark, ["Severe", "OK", "?"], "c string", lambda: Q.ordinal(F.col("c"))) == [3, 0, 0]


def test_pages(spark):
    assert each(spark, ["page_12.png", "cover.png"], "c string", lambda: Q.page_number(F.col("c"))) == [12, -1]
    specs = [("1-3,6,10-12", 12), (None, 3), ("3-1", 12), ("2,2,99", 12), (" ", 2), (" 4 , 2-3 ", 12), ("1", 0), (None, 0)]
    assert each(spark, specs, "s string, n int", lambda: Q.page_selection(F.col("s"), F.col("n"))) == [[1, 2, 3, 6, 10, 11, 12], [1, 2, 3], [], [2], [1, 2], [2, 3, 4], [], []]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        each(spark, [("x", 3)], "s string, n int", lambda: Q.page_selection(F.col("s"), F.col("n")))
    assert each(spark, [[1.0, 2.5, -1.0, 0.5]], "b array<double>", lambda: Q.scaled_box(F.col("b"), 300)) == [[4, 10, -4, 2]]


def test_unicode(spark):
    assert each(spark, ["ﬁ Ⅳ", None], "c string", lambda: nfkc_casefold("c")) == ["fi iv", None]
    assert each(spark, ["й ї/a"], "c string", lambda: without_marks("c")) == ["и іa"]
    assert each(spark, ["ІХ том", "іх"], "c string", lambda: roman_numerals("c")) == ["ix том", "іх"]
    assert each(spark, [("abcd", "bcde"), ("a", None)], "a string, b string", lambda: sequence_ratio("a", "b")) == [0.75, None]
    assert each(spark, [bytearray(b"\xef\xbb\xbfa\xffb")], "c binary", lambda: utf8_lenient("c")) == ["﻿ab"]
