"""Validation, cleaning and computed columns of the reference and input tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import (
    INPUT_ALIASES,
    INPUT_COLUMNS,
    INPUT_HEADERS,
    INPUT_VALUE,
    KEYS,
    MissingColumns,
    PRESET_VALUE,
    REFERENCE_COLUMNS,
    REFERENCE_HEADERS,
)

IDS = ("row_id", "input_id")


# ------------------------------------------------------------------ validation


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required columns a table lacks; looks at the schema only, runs no job."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise MissingColumns(missing)
    return df


def has_structure(df: DataFrame, kind: str = "reference") -> bool:
    """Whether a table has the columns of a ``reference`` or an ``input`` table."""
    return not missing_columns(df, REFERENCE_COLUMNS if kind == "reference" else INPUT_COLUMNS)


def validate_inputs(df: DataFrame) -> DataFrame:
    """One row ``(ok, message)``: missing columns first, else rows with a null key column."""
    missing = missing_columns(df, INPUT_COLUMNS)
    if missing:
        message = f"Missing required columns: {missing}"
        return df.sparkSession.range(1).select(
            F.lit(False).alias("ok"), F.lit(message).alias("message")
        )
    any_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in KEYS))
    bad = F.col("bad")
    return df.agg(F.count_if(any_null).alias("bad")).select(
        (bad == 0).alias("ok"),
        F.when(
            bad > 0,
            F.concat(
                F.lit("Found "), bad.cast("string"), F.lit(" rows with empty values in key columns")
            ),
        )
        .otherwise("Data validation passed")
        .alias("message"),
    )


# ------------------------------------------------------------------ column names


def use_headers(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Rename display headers to column names where the name is not taken yet."""
    names = {h: n for h, n in headers.items() if h in df.columns and n not in df.columns}
    return df.withColumnsRenamed(names)


def alias_inputs(df: DataFrame) -> DataFrame:
    """Accept the alternative input headers where the usual one is absent."""
    names = {a: h for a, h in INPUT_ALIASES.items() if a in df.columns and h not in df.columns}
    return df.withColumnsRenamed(names)


def infer_inputs(df: DataFrame, compat_positional: bool = False) -> DataFrame:
    """Without a category column, take the fields by position (three columns or more).

    With exactly three columns there is no value column and ``input_value`` is empty;
    ``compat_positional`` repeats the category there instead. Row identifiers are not counted.
    """
    names = [c for c in df.columns if c not in IDS]
    if "Category" in names or "category" in names or len(names) < 3:
        return df
    fields = [F.col(f"`{n}`") for n in names[:4]]
    if len(fields) == 3:
        fields.append(fields[0] if compat_positional else F.lit(""))
    return df.select(
        *(c for c in df.columns if c in IDS), *(f.alias(n) for f, n in zip(fields, INPUT_COLUMNS))
    )


# ------------------------------------------------------------------ cleaning


def clean(df: DataFrame, columns) -> DataFrame:
    """Drop all-null rows, null to '', drop rows without any key, then strip.

    The key filter comes before the strip: keys made of spaces survive one pass.
    """
    data = [c for c in df.columns if c not in IDS]
    present = [c for c in columns if c in df.columns]
    empty = reduce(lambda a, b: a & b, (F.col(c) == "" for c in KEYS))
    return (
        df.na.drop("all", subset=data)
        .withColumns({c: X.text(c) for c in present})
        .filter(~empty)
        .withColumns({c: X.strip(c) for c in present})
    )


def clean_reference(df: DataFrame) -> DataFrame:
    df = use_headers(df, REFERENCE_HEADERS)
    return clean(require_columns(df, REFERENCE_COLUMNS), REFERENCE_COLUMNS)


def clean_inputs(df: DataFrame, compat_positional: bool = False) -> DataFrame:
    df = use_headers(infer_inputs(alias_inputs(df), compat_positional), INPUT_HEADERS)
    return clean(require_columns(df, KEYS), INPUT_COLUMNS)


# ------------------------------------------------------------------ computed columns


def add_computed_columns(df: DataFrame) -> DataFrame:
    """Normalized value, key and flags; columns that are already there stay as they are."""
    new = {
        "normalized": X.normalize(PRESET_VALUE),
        "composite_key": X.composite_key(*KEYS),
        "has_units": X.has_units(PRESET_VALUE),
        "has_numbers": X.has_numbers(PRESET_VALUE),
        "has_commas": X.has_commas(PRESET_VALUE),
    }
    return df.withColumns({n: c for n, c in new.items() if n not in df.columns})


def prepare_inputs(df: DataFrame) -> DataFrame:
    """Inputs ready to match: missing fields read as '', blank values left out."""
    df = df.withColumns({c: F.lit("") for c in INPUT_COLUMNS if c not in df.columns})
    df = df.withColumns({c: X.text(c) for c in INPUT_COLUMNS})
    return df.filter(X.strip(INPUT_VALUE) != "")


def clean_for_display(df: DataFrame, length: int = 100) -> DataFrame:
    """Cut long text columns for a preview."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: X.truncate(c, length) for c in texts})
