"""Formats learned per key from the reference values, and value functions that use them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import DIGIT, SPACE
from ..schema import KEYS
from ..session import stage

# Multiplier letters, separators, letters of a unit, and the patterns that name the
# typical format of a key.
MULTIPLIERS = list("mknupfMKNUPFGTgt")
SEPARATORS = [",", ";", "|", " - ", " to "]
LETTERS = "[a-zA-Z°]"
NUMBER = rf"{DIGIT}+\.?{DIGIT}*"
FORMATS = {
    "number_unit": rf"{DIGIT}+[a-zA-Z]+",
    "text_number": rf"[a-zA-Z]+,{SPACE}*{DIGIT}+",
}

CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def case_pattern(column) -> Column:
    """``all_uppercase``, ``all_lowercase``, ``title_case`` or ``mixed_case``, tested in order."""
    v = X._col(column)
    upper, lower = v.rlike(r"[\p{Lu}\p{Lt}]"), v.rlike(r"\p{Ll}")
    broken = v.rlike(rf"[{CASED}][\p{{Lu}}\p{{Lt}}]") | v.rlike(rf"(^|[^{CASED}])\p{{Ll}}")
    return (
        F.when(v.rlike(r"\p{Lu}") & ~v.rlike(r"[\p{Ll}\p{Lt}]"), "all_uppercase")
        .when(lower & ~upper, "all_lowercase")
        .when((lower | upper) & ~broken, "title_case")
        .otherwise("mixed_case")
    )


# Names of the case counts.
CASES = ["all_uppercase", "all_lowercase", "title_case", "mixed_case"]


def extract_units(column, skip_decimals: bool = False) -> Column:
    """Letter runs after a number; with ``skip_decimals`` the number may have decimals."""
    number = NUMBER if skip_decimals else f"{DIGIT}+"
    return F.regexp_extract_all(X._col(column), F.lit(f"{number}{SPACE}*({LETTERS}+)"), F.lit(1))


def decimal_places(column) -> Column:
    """Digits after the dot of each number that has one."""
    found = F.regexp_extract_all(X._col(column), F.lit(rf"{DIGIT}+\.({DIGIT}*)"), F.lit(1))
    return F.transform(found, lambda d: F.char_length(d))


def typical_formats(reference: DataFrame) -> DataFrame:
    """``typical_format`` per key: the one that all its values have, else ``mixed``."""
    v = F.col("preset_value")
    digit, letter = v.rlike(DIGIT), v.rlike("[a-zA-Z]")
    tests = {n: v.rlike(p) for n, p in FORMATS.items()}
    tests["number_only"] = digit & ~letter
    tests["text_only"] = letter & ~digit
    chosen = reduce(lambda acc, nt: acc.when(F.every(nt[1]), nt[0]), tests.items(), F)
    return reference.groupBy(*KEYS).agg(chosen.otherwise("mixed").alias("typical_format"))


def case_sensitivity(reference: DataFrame) -> DataFrame:
    """Whether a key lacks the lower or upper form of one of its values.

    Spellings are grouped by key and spelling, so a large key spreads over the cluster.
    """
    v = F.col("preset_value")
    forms = F.array_distinct(F.array(v, F.lower(v), F.upper(v)))
    spelled = reference.select(*KEYS, v, F.explode(forms).alias("form"))
    known = spelled.groupBy(*KEYS, "form").agg(F.max(v == F.col("form")).alias("known"))
    return known.groupBy(*KEYS).agg(F.bool_or(~F.col("known")).alias("case_sensitivity"))


#: Units, combinations and decimals that a key's profile lists at most, the most used ones; ``key_items`` has all.
MOST_ITEMS = 1000


def key_items(reference: DataFrame, most: int | None = None) -> DataFrame:
    """(key, kind, item, uses, place): units, unit combinations and decimals of each key as a child table.

    ``uses`` counts occurrences; places go by uses, then item. With ``most`` only so many of a kind are kept, and
    what is sorted of a key are its distinct items, counted before the shuffle.
    """
    v = F.col("preset_value")

    def token(kind, items):
        return F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("item")))

    tokens = F.concat(
        token("unit", extract_units(v)),
        token("combination", F.filter(extract_units(v, True), lambda u: F.char_length(u) >= 2)),
        token("decimals", decimal_places(v)),
    )
    counted = reference.select(*KEYS, F.inline(tokens)).groupBy(*KEYS, "kind", "item").agg(F.count("*").alias("uses"))
    by_use = Window.partitionBy(*KEYS, "kind").orderBy(F.desc("uses"), "item")
    placed = counted.withColumn("place", F.row_number().over(by_use))
    return placed if most is None else placed.where(F.col("place") <= most)


def profile_keys(reference: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """One row of learned formats per key.

    Each part is a plain aggregation with map-side combine: counters and flags in one pass,
    the most used units and decimals from their counts, typical format and case from their own
    small groupings. Nothing holds all values of a key.
    """
    v = F.col("preset_value")
    figures = X.numbers(v)
    counters = reference.groupBy(*KEYS).agg(
        F.count("*").alias("values"),
        F.array_compact(
            F.array(*(F.when(F.bool_or(v.contains(s)), s) for s in SEPARATORS))
        ).alias("separators"),
        F.struct(
            *(F.count_if(case_pattern(v) == c).alias(c) for c in CASES)
        ).alias("case_patterns"),
        F.map_from_arrays(
            F.array(*(F.lit(m) for m in MULTIPLIERS)),
            F.array(*(F.count_if(v.contains(m)) for m in MULTIPLIERS)),
        ).alias("multipliers"),
        F.min(F.array_min(figures)).alias("min_value"),
        F.max(F.array_max(figures)).alias("max_value"),
    )

    found = key_items(reference, most)

    def items(kind, as_type="string"):
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("item").cast(as_type))))

    sets = found.groupBy(*KEYS).agg(
        items("unit").alias("common_units"),
        items("combination").alias("unit_combinations"),
        items("decimals", "int").alias("decimal_places"),
    )
    profile = (
        counters.join(typical_formats(reference), KEYS)
        .join(case_sensitivity(reference), KEYS)
        .join(sets, KEYS, "left")
    )
    empty = {
        c: F.coalesce(c, F.array().cast(profile.schema[c].dataType))
        for c in ("common_units", "unit_combinations", "decimal_places")
    }
    return profile.withColumns(empty)


def key_index(reference: DataFrame) -> DataFrame:
    """Reference rows laid out by key, then row id: each key's ordered list of values, numbered by ``place``.

    Range partitions follow key and row, so a large key spans several of them. Places come from the row's place in its
    partition and the counts of the partitions before it; no task sorts a whole key.
    """
    entry = ["row_id", "preset_value", "normalized", "has_units", "has_numbers", "has_commas"]
    laid = reference.select(*KEYS, *entry).repartitionByRange(*KEYS, "row_id").sortWithinPartitions(*KEYS, "row_id")
    # partition number and place inside it; written, so both are fixed
    laid = stage(laid.withColumn("at", F.monotonically_increasing_id()), "key-index")
    part = F.shiftright("at", 33).alias("part")
    runs = laid.groupBy(*(F.col(c) for c in KEYS), part).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy(*KEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first") + 1
    runs = runs.select(*(F.col(c).alias(f"run_{c}") for c in KEYS), "part", shift.alias("shift"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"run_{c}")) for c in KEYS))
    placed = laid.withColumn("part_of", F.shiftright("at", 33)).join(runs, same & (F.col("part_of") == F.col("part")))
    return placed.select(*KEYS, (F.col("at") + F.col("shift")).alias("place"), *entry)


# ------------------------------------------------------------------ value functions


def normalize_multipliers(column) -> Column:
    """Drop the spaces between a number, its multiplier letter and its unit."""
    letters = "".join(MULTIPLIERS)
    v = F.regexp_replace(
        X._col(column), f"({NUMBER}){SPACE}*([{letters}]){SPACE}*({LETTERS}+)", "$1$2$3"
    )
    return F.regexp_replace(v, f"({NUMBER}){SPACE}*([{letters}])(?!{LETTERS})", "$1$2")


def smart_normalize(column, case_sensitive) -> Column:
    """Strip, lower unless the key is case sensitive, join multipliers, collapse spaces."""
    v = X.strip(X.text(column))
    v = F.when(X._col(case_sensitive), v).otherwise(F.lower(v))
    return F.regexp_replace(normalize_multipliers(v), f"{SPACE}+", " ")


def value_parts(column) -> Column:
    """Numbers, multiplier letters and units of a value, in order of appearance."""
    pattern = rf"({NUMBER}){SPACE}*([{''.join(MULTIPLIERS)}]?){SPACE}*({LETTERS}*)"

    def group(n):
        return F.regexp_extract_all(X._col(column), F.lit(pattern), F.lit(n))

    return F.struct(
        F.transform(group(1), lambda x: x.try_cast("double")).alias("numbers"),
        group(2).alias("multipliers"),
        group(3).alias("units"),
    )


def numbers_equivalent(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    close = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)
    return F.when(F.size(a) == F.size(b), close).otherwise(False)


def format_to_pattern(column, typical_format) -> Column:
    """Rewrite an input to the typical format of its key; without a number it stays as it is."""
    v, kind = X._col(column), X._col(typical_format)
    number = F.regexp_extract(v, f"({NUMBER})", 1)
    unit = F.regexp_extract(v, f"({LETTERS}+)", 1)
    words = X.strip(F.regexp_replace(v, f"{NUMBER}{SPACE}*{LETTERS}*", ""))
    return (
        F.when(number == "", v)
        .when(kind == "number_unit", F.concat(number, F.upper(unit)))
        .when((kind == "text_number") & (words != ""), F.concat(words, F.lit(", "), number))
        .when(kind.isin("text_number", "number_only"), number)
        .otherwise(v)
    )


def letter_runs(column) -> Column:
    return F.regexp_extract_all(X._col(column), F.lit(f"({LETTERS}+)"), F.lit(1))


def multiplier_letters(column) -> Column:
    pattern = f"([{''.join(MULTIPLIERS)}])"
    return F.regexp_extract_all(X._col(column), F.lit(pattern), F.lit(1))


def profile_notes(a, b, case_sensitive) -> list[Column]:
    """Comment parts of a profiled match; a part that does not hold is null."""
    a, b, sensitive = X._col(a), X._col(b), X._col(case_sensitive)
    same = F.lower(a) == F.lower(b)
    sets = [F.array_sort(F.array_distinct(letter_runs(x))) for x in (a, b)]
    return [
        F.when(sensitive & (a != b) & same, "case difference").when(
            ~sensitive & same, "case normalized"
        ),
        F.when(multiplier_letters(a) != multiplier_letters(b), "multiplier difference"),
        F.when(sets[0] != sets[1], "unit difference"),
    ]
