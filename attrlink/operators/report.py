"""Result analysis: summary, breakdowns, filters, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import EXACT, KEYS, NOT_FOUND, SIMILAR, STATUSES

# The lines of the summary, in order.
METRICS = [
    "Total Comparisons",
    "Exact Matches",
    "Similar Matches",
    "Not Found",
    "Average Similarity Score",
    "Highest Similarity Score",
    "Lowest Similarity Score",
    "Export Date",
]
STAMP = "yyyy-MM-dd HH:mm:ss"
HISTOGRAM_BINS = 20


def summary(results: DataFrame, exported_at: Column | str | None = None) -> DataFrame:
    """The summary as ``(position, metric, value)``, from one pass over the results.

    ``exported_at`` is the stamp to print; without it the current time is taken.
    """
    if exported_at is None:
        exported_at = F.date_format(F.current_timestamp(), STAMP)
    elif isinstance(exported_at, str):
        exported_at = F.lit(exported_at)
    counts = [F.count("*")] + [
        F.count_if(F.col("status") == s) for s in (EXACT, SIMILAR, NOT_FOUND)
    ]
    if "similarity" in results.columns:
        scores = [f("similarity") for f in (F.avg, F.max, F.min)]
        scores = [F.coalesce(X.percent(s, 2), F.lit("nan%")) for s in scores]
    else:
        scores = [F.lit("N/A")] * 3
    values = F.array(*(c.cast("string") for c in counts), *scores)
    lines = F.arrays_zip(F.array(*(F.lit(m) for m in METRICS)).alias("metric"), "values")
    return (
        results.agg(values.alias("values"))
        .withColumn("values", F.concat("values", F.array(exported_at)))
        .select(F.posexplode(lines).alias("position", "line"))
        .select("position", "line.metric", F.col("line.values").alias("value"))
    )


def status_breakdown(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("count")).orderBy(
        F.desc("count"), "status"
    )


def category_status(results: DataFrame) -> DataFrame:
    """Rows per category and status; a status that does not occur counts 0."""
    return (
        results.groupBy("category").pivot("status", STATUSES).agg(F.count(F.lit(1))).na.fill(0)
    )


def load_metrics(table: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows and distinct keys of a loaded table; a column that is missing counts 0."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    names = dict(zip(KEYS, ("categories", "sub_categories", "attributes")))
    return table.agg(
        F.count("*").alias("records"),
        *(
            (distinct(c) if c in table.columns else F.lit(0)).cast("long").alias(n)
            for c, n in names.items()
        ),
    )


def top_counts(table: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values; equal counts by value."""
    counts = table.filter(F.col(column).isNotNull()).groupBy(column)
    return counts.agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)


def preview(table: DataFrame, n: int = 20, order: str = "row_id") -> DataFrame:
    """The first ``n`` rows in row order."""
    return table.orderBy(order).limit(n)


def category_distribution(reference: DataFrame, n: int = 20) -> DataFrame:
    return top_counts(reference, "category", n)


def worst_categories(results: DataFrame, n: int = 10) -> DataFrame:
    """Categories with the most inputs that were not found."""
    return top_counts(results.filter(F.col("status") == NOT_FOUND), "category", n)


def filter_results(
    results: DataFrame,
    status: str | None = None,
    category: str | None = None,
    min_similarity: float | None = None,
) -> DataFrame:
    """Chosen rows; ``All`` or None means no choice. A minimum is inclusive and drops rows without a match."""
    if status not in (None, "All"):
        results = results.filter(F.col("status") == status)
    if category not in (None, "All"):
        results = results.filter(F.col("category") == category)
    return results if min_similarity is None else results.filter(F.col("similarity") >= min_similarity)


def filter_choices(results: DataFrame) -> DataFrame:
    """Statuses and categories that occur, as ``(field, value)``, from one pass."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("status", "category")]
    return results.select(F.inline(F.array(*fields))).distinct()


def score_histogram(results: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins over the range of scores; the last bin is closed.

    A single score value gets a range of half a point to each side.
    """
    scores = results.select(F.col("similarity").alias("x")).filter("x IS NOT NULL")
    edge = scores.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    edge = edge.select((F.col("lo") - half).alias("lo"), (F.col("hi") + half).alias("hi"))
    low, high = edge.select("lo").scalar(), edge.select("hi").scalar()
    place = F.floor((F.col("x") - low) / (high - low) * bins)
    counts = scores.groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin"))
    counts = counts.agg(F.count("*").alias("count"))
    every = results.sparkSession.range(bins).withColumnRenamed("id", "bin")
    width = (high - low) / bins
    return every.join(counts, "bin", "left").select(
        "bin",
        (low + F.col("bin") * width).alias("bin_start"),
        (low + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
