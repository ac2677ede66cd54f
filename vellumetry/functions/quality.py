"""Page quality classes, page numbers and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the classes from best to worst, short and as issue levels (fixed values).
CLASSES = ("OK", "Minor", "Moderate", "Severe")
LEVELS = ("OK", "MINOR ISSUE", "MODERATE ISSUE", "SEVERE ISSUE")
MISMATCH = "PAGE COUNT MISMATCH"


def _number(c: Column) -> Column:
    """NaN as null: NaN compares greater than any number here, and must not pass a threshold."""
    return F.when(~F.isnan(c), c)


def issue_level(cosine: Column, lpips: Column) -> Column:
    """By cosine above all; lpips decides near its edges."""
    c, p = _number(cosine), _number(lpips)
    ok = (c >= 0.9991) | ((c >= 0.98) & (c < 0.9991) & (p <= 0.13))
    minor = (c >= 0.98) | ((c >= 0.97) & (p <= 0.75))
    return F.when(ok, LEVELS[0]).when(minor, LEVELS[1]).when(c >= 0.92, LEVELS[2]).otherwise(LEVELS[3])


def strict_class(cosine: Column, lpips: Column) -> Column:
    """Both measures must hold for each class."""
    c, p = _number(cosine), _number(lpips)
    return F.when((p <= 0.11) & (c >= 0.98), CLASSES[0]).when((p <= 0.22) & (c >= 0.97), CLASSES[1]).when((p <= 0.75) & (c >= 0.92), CLASSES[2]).otherwise(CLASSES[3])


def perceptual_class(cosine: Column, lpips: Column) -> Column:
    """By lpips; cosine counts for the best class only."""
    c, p = _number(cosine), _number(lpips)
    return F.when((p <= 0.11) & (c >= 0.99), CLASSES[0]).when(p <= 0.22, CLASSES[1]).when(p <= 0.40, CLASSES[2]).otherwise(CLASSES[3])


def printed_class(text: Column) -> Column:
    """The class named in a printed label, null if none is."""
    t = F.lower(text)
    out = F.lit(None).cast("string")
    for name in reversed(CLASSES):
        out = F.when(t.contains(name.lower()), name).otherwise(out)
    return out


def ordinal(name: Column, unknown: int = 0) -> Column:
    """0 for OK to 3 for Severe."""
    out = F.lit(unknown)
    for i, c in enumerate(CLASSES):
        out = F.when(name == c, i).otherwise(out)
    return out


def page_number(name: Column) -> Column:
    """The first run of digits in a file name, -1 without."""
    return F.coalesce(F.regexp_extract(name, "[0-9]+", 0).try_cast("int"), F.lit(-1))


def page_selection(spec: Column, pages: Column) -> Column:
    """Pages that a list like '1-3,6' names, in order, within 1..pages; all for null or blank. A bad number raises."""
    bounds = lambda part: F.transform(F.split(part, "-"), lambda x: F.trim(x).cast("int"))
    span = lambda b: F.when(F.element_at(b, 1) <= F.element_at(b, -1), F.sequence(F.element_at(b, 1), F.element_at(b, -1))).otherwise(F.array().cast("array<int>"))
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    named = F.array_sort(F.array_distinct(F.flatten(F.transform(F.transform(parts, bounds), span))))
    every = F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    return F.when(spec.isNull() | (F.trim(spec) == ""), every).otherwise(F.filter(named, lambda p: (p >= 1) & (p <= pages)))


def scaled_box(box: Column, dpi: int) -> Column:
    """A box in points (1/72 inch) in pixels, cut toward zero."""
    return F.transform(box, lambda x: (x * dpi / 72).cast("int"))
