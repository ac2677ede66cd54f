"""Numbers printed in table cells, and how far two pairs of them agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_letters, strip_html, trim

EPS = 1e-12


def parse_number(cell: Column) -> Column:
    """The digits of a cell without letters as one integer, negative in parentheses; else null.

    Separators do not count, so a decimal comma is lost. Over 38 digits give null.
    """
    s = trim(strip_html(cell))
    value = F.regexp_replace(s, "[^0-9]", "").try_cast("decimal(38,0)")
    return F.when(s.isin("-", "—", "–") | has_letters(s), None).when(s.startswith("(") & s.endswith(")"), -value).otherwise(value)


def is_code(cell: Column) -> Column:
    return F.coalesce(trim(strip_html(cell)).rlike("^[0-9]{3,4}$"), F.lit(False))


def relative_error(a: Column, b: Column) -> Column:
    """0 if both are missing, null if one is."""
    x, y = a.cast("double"), b.cast("double")
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNotNull() & b.isNotNull(), F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(EPS)))


def number_similarity(gs: Column, rs: Column, ge: Column, re: Column) -> Column:
    """Mean over start and end of 1 - relative error, at least 0, where that can be told; both missing counts as equal."""
    # least() skips nulls, so what cannot be told must be kept out of it
    start, end = (F.when(relative_error(a, b).isNotNull(), 1 - F.least(F.lit(1.0), relative_error(a, b))) for a, b in ((gs, rs), (ge, re)))
    return F.round(F.when(start.isNull(), end).when(end.isNull(), start).otherwise((start + end) / 2), 4)


def number_similarity_with_codes(gs: Column, rs: Column, ge: Column, re: Column, gt_code: Column, res_code: Column) -> Column:
    """0 if only one side has numbers. If neither has: 1 without codes, null with two, 0 with one."""
    gt, res = gs.isNotNull() | ge.isNotNull(), rs.isNotNull() | re.isNotNull()
    return F.when(gt & res, number_similarity(gs, rs, ge, re)).when(gt | res, 0.0).when(~gt_code & ~res_code, 1.0).when(gt_code & res_code, None).otherwise(0.0)


def overall_similarity(label: Column, number: Column) -> Column:
    return F.round(F.when(number.isNull(), label).when(label.isNull(), number).otherwise((label + number) / 2), 4)


def percent_difference(a: Column, b: Column) -> Column:
    return F.round(100 * relative_error(a, b), 4)


def format_numbers(start: Column, end: Column, code: Column | None = None) -> Column:
    """Code, start and end as far as they are there, parted by spaces."""
    return F.concat_ws(" ", *([code] if code is not None else []), start.cast("string"), end.cast("string"))
