"""Value cleaning and flags as native column expressions.

Java's ``\\s``, ``\\w`` and ``\\d`` are ASCII only, so the classes are spelled out: whitespace as
Unicode defines it, word characters as letters, numbers and the underscore, digits as decimal
digits of any script.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DIGIT = r"\p{Nd}"
# Characters kept by normalization, and the unit words of the unit flag.
KEPT = r"\p{L}\p{N}_ \-.,()"
UNIT_WORDS = "mm|cm|m|in|inch|ft|kg|g|lb|oz|v|a|w|hz|°c|°f"


def text(column) -> Column:
    """Null and non-string values as strings."""
    return F.coalesce(_col(column).cast("string"), F.lit(""))


# The same characters, to trim.
SPACES = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)])
) + "\u2028\u2029\u202f\u205f\u3000"


def strip(column) -> Column:
    return F.btrim(_col(column), F.lit(SPACES))


def normalize(column, lower: bool = True) -> Column:
    """Strip, lower, collapse whitespace, then drop symbols; in that order, so a dropped symbol
    can leave two spaces behind."""
    value = strip(text(column))
    spaced = F.regexp_replace(F.lower(value) if lower else value, f"{SPACE}+", " ")
    return F.regexp_replace(spaced, f"[^{KEPT}]", "")


def has_units(column) -> Column:
    low = F.lower(text(column))
    known = low.rlike(f"{DIGIT}+{SPACE}*({UNIT_WORDS})")
    short = low.rlike(rf"{DIGIT}+{SPACE}*[a-z]{{1,3}}(?={SPACE}|$|,|\))")
    return known | short


def has_numbers(column) -> Column:
    return text(column).rlike(DIGIT)


def has_commas(column) -> Column:
    return text(column).contains(",")


def composite_key(*columns) -> Column:
    return F.concat_ws("|", *(text(c) for c in columns))


def truncate(column, length: int = 100) -> Column:
    value = _col(column)
    return F.when(
        F.char_length(value) > length, F.concat(F.substring(value, 1, length), F.lit("..."))
    ).otherwise(value)


def percent(column, digits: int = 1) -> Column:
    """A score as text, ``85.7%``; ties round half-even, null stays null."""
    value = F.bround(_col(column).cast("double"), digits)
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f%%", value))


def tokens(column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(_col(column), f"{SPACE}+"), lambda t: t != "")


def sorted_tokens(column) -> Column:
    return F.array_join(F.array_sort(tokens(column)), " ")


def numbers(column) -> Column:
    """All decimal numbers of a value, as doubles."""
    found = F.regexp_extract_all(_col(column), F.lit(rf"({DIGIT}+\.?{DIGIT}*)"), F.lit(1))
    return F.transform(found, lambda x: x.try_cast("double"))


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column
