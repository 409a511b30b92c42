"""Data summary and quality reports of any table, as long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


WIDE = 64


def short_key(value: Column) -> Column:
    """A value, or for a long one its start and its digest: as distinct, but narrow to shuffle."""
    start = F.substring(value, 1, WIDE)
    return F.when(
        F.char_length(value) > WIDE, F.concat(start, F.lit("#"), F.sha2(value, 256))
    ).otherwise(value)


def _cells(df: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in text_columns(df)]
    typed = F.array(*cells).cast("array<struct<column:string,value:string>>")
    return df.select(F.inline(typed)).withColumn("key", short_key(F.col("value")))


def value_counts(df: DataFrame) -> DataFrame:
    """``(column, key, count)`` over all text columns; one scan and one shuffle.

    Rows are counted on the map side first, so a hot value crosses the network once per task, and
    whole texts never do: long values travel as digests.
    """
    return _cells(df).groupBy("column", "key").agg(F.count("*").alias("count"))


def top_values(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values per text column; equal counts by value.

    Counted by key. A value's start orders like the value, so the keys that can be among the first ``n``
    are known without the texts; only theirs are fetched, and ordered in full.
    """
    start = F.substring("key", 1, WIDE)
    by_start = Window.partitionBy("column").orderBy(F.desc("count"), start)
    counts = value_counts(df).filter("key IS NOT NULL")
    able = counts.withColumn("rank", F.rank().over(by_start)).filter(F.col("rank") <= n).drop("rank")
    texts = _cells(df).join(able, ["column", "key"])
    texts = texts.groupBy("column", "key", "count").agg(F.any_value("value").alias("value"))
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = texts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select("column", "value", "count", "rank")


def most_common(df: DataFrame) -> DataFrame:
    """The most frequent value per text column."""
    return top_values(df, 1).drop("rank")


def data_summary(df: DataFrame) -> DataFrame:
    """``(column, metric, value)``: records and columns of the table (column ''), then distinct
    and null counts per text column. An empty table has no summary."""
    counts = value_counts(df)
    per_column = counts.groupBy("column").agg(
        F.count("key").alias("unique"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("count"))), F.lit(0)).alias("null"),
    )
    whole = df.agg(F.count("*").alias("total_records"))
    whole = whole.filter("total_records > 0").select(
        F.lit("").alias("column"),
        F.inline(_metrics(total_records=F.col("total_records"), columns=F.lit(len(df.columns)))),
    )
    stats = per_column.select(
        "column", F.inline(_metrics(unique=F.col("unique"), null=F.col("null")))
    )
    return whole.unionByName(stats)


def _metrics(**values: Column) -> Column:
    return F.array(
        *(
            F.struct(F.lit(n).alias("metric"), v.cast("string").alias("value"))
            for n, v in values.items()
        )
    )


def row_digest(df: DataFrame) -> Column:
    """One digest per row: fields with their lengths, nulls marked, nothing ambiguous."""
    parts = []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        nested = field.dataType.typeName() in ("array", "map", "struct")
        cell = F.to_json(cell) if nested else cell.cast("string")
        sized = F.concat(F.char_length(cell).cast("string"), F.lit(":"), cell)
        parts.append(F.coalesce(sized, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows (nulls equal). Only digests shuffle."""
    groups = df.select(row_digest(df).alias("digest")).groupBy("digest")
    extra = groups.agg((F.count("*") - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, of any type, as ``(column, data_type, nulls, rows)``."""
    counted = df.agg(
        F.count("*").alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}")
                                       for i, c in enumerate(df.columns))
    )
    cells = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"n{i}").alias("nulls"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counted.select("rows", F.inline(F.array(*cells)))


def quality_report(df: DataFrame) -> DataFrame:
    """``(column, metric, value)``: table figures under column '', then per column its type and
    nulls, and for text columns distinct values and the share of nulls. ``top_values`` has the
    most common values."""
    nulls = null_counts(df)
    share = F.round(F.try_divide(F.col("nulls") * F.lit(100.0), F.col("rows")), 6)
    text = F.col("column").isin(text_columns(df))
    per_column = nulls.select(
        "column",
        F.inline(
            F.filter(
                F.concat(
                    _metrics(data_type=F.col("data_type"), null_count=F.col("nulls")),
                    F.when(text, _metrics(null_percentage=share)).otherwise(F.array()),
                ),
                lambda m: m["value"].isNotNull(),
            )
        ),
    )
    unique = value_counts(df).groupBy("column").agg(F.count("key").alias("n"))
    unique = unique.select("column", F.inline(_metrics(unique_values=F.col("n"))))
    total = df.agg(F.count("*").alias("n")).select(
        F.lit("").alias("column"),
        F.inline(_metrics(total_rows=F.col("n"), total_columns=F.lit(len(df.columns)))),
    )
    repeated = duplicate_rows(df).select(
        F.lit("").alias("column"), F.inline(_metrics(duplicate_rows=F.col("duplicate_rows")))
    )
    return reduce(DataFrame.unionByName, [total, repeated, per_column, unique])


# ------------------------------------------------------------------ distinct counts of large tables

#: Size of a sketch: 2**14 slots, a relative standard error of 0.65 %.
SKETCH_SLOTS_LOG = 14


def distinct_sketches(df: DataFrame, columns: list[str], version: str) -> DataFrame:
    """(version, column, rows, sketch): one small mergeable sketch of the distinct values of each column.

    Nulls are not counted. Sketches of several versions of a table are merged without reading its rows again."""
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_SLOTS_LOG)) for c in columns]
    parts = F.array(*(F.struct(F.lit(c).alias("column"), s.alias("sketch")) for c, s in zip(columns, sketches, strict=True)))
    made = df.agg(F.count("*").alias("rows"), parts.alias("parts")).select("rows", F.inline("parts"))
    return made.select(F.lit(version).alias("version"), "column", "rows", "sketch")


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """(column, rows, estimate) over all versions whose sketches are given."""
    return sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")
    )
