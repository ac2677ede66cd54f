"""Text as columns. Regular expressions name their character classes in full, since \\w and \\s differ between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import nfkc_casefold

#: White space as Unicode text functions strip it (a class body).
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Ends of lines.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: Letters that a label may have: Latin, Cyrillic and the Ukrainian ones (fixed values).
LETTERS = "A-Za-zА-Яа-яЁёЇїІіЄєҐґ"
#: Letters of section numerals before a heading (fixed values), by alphabet.
SECTION_LETTERS = {"cyrillic": "ivxlcdmІЇХСВМДЛ", "ascii": "ivxlcdm"}


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_html(c: Column) -> Column:
    """Line breaks and other tags become spaces; plain bold and italic tags vanish."""
    c = F.regexp_replace(c, f"(?i)<br[{SPACE}]*/?>", " ")
    c = F.regexp_replace(c, "(?i)</?(?:b|i|strong|em)>", "")
    return F.regexp_replace(c, "<[^>]+>", " ")


def normalize(c: Column, sections: str = "cyrillic", unicode: bool = True) -> Column:
    """Comparable text: no markup, folded case, no leading section numeral, words parted by single spaces.

    unicode=False takes lower() for compatibility forms and folded case: the same for text without
    compatibility characters, and it stays in the JVM. Null stays null.
    """
    c = strip_html(c)
    c = nfkc_casefold(c) if unicode else F.lower(c)
    c = F.regexp_replace(c, f"(?iu)^[{SPACE}]*(?:[{SECTION_LETTERS[sections]}]+|\\p{{Nd}}+)\\.?[{SPACE}]+", "")
    c = F.regexp_replace(c, f"[^\\p{{L}}\\p{{N}}_{SPACE}]+", " ")
    return F.regexp_replace(F.regexp_replace(c, f"[{SPACE}]+", " "), "^ | $", "")


def tokens(norm: Column) -> Column:
    """Distinct words of normalized text."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda t: t != ""))


def meaningful(token_array: Column) -> Column:
    return F.filter(token_array, lambda t: F.length(t) >= 3)


def characters(norm: Column) -> Column:
    """Distinct characters of normalized text, the space included."""
    return F.array_distinct(F.filter(F.split(norm, ""), lambda t: t != ""))


def has_letters(c: Column) -> Column:
    return c.rlike(f"[{LETTERS}]")


def alignment_row(cells: Column) -> Column:
    return F.forall(cells, lambda c: F.coalesce(c, F.lit("")).rlike(f"^[{SPACE}]*:?-{{3,}}:?[{SPACE}]*$"))


def blank_row(cells: Column) -> Column:
    return F.forall(cells, lambda c: trim(F.coalesce(c, F.lit(""))) == "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_END)
