"""Similarity scores as columns of a DataFrame of string pairs."""

from __future__ import annotations

from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import compute_partitions
from . import kernels, native_scores, trees
from .text import DIGIT, SPACE, _col, numbers

cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(trees)

# Weights of the weighted score.
WEIGHTS = {
    "exact_match": 1.0,
    "ratio": 0.9,
    "partial_ratio": 0.8,
    "token_sort_ratio": 0.85,
    "token_set_ratio": 0.8,
    "jaro_winkler": 0.75,
    "levenshtein": 0.7,
    "pattern": 0.6,
    "semantic": 0.65,
}

SCORE_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in kernels.SCORES])


def pair_scores(a, b, full: bool = False) -> Column:
    """Struct of all scores of two normalized strings; field order breaks ties.

    Without ``full``, Jaro-Winkler and Levenshtein stay 0 and the number rules of the pattern
    score hold for strings without numbers too.
    """
    return F.pandas_udf(kernels.pair_score_frame, SCORE_TYPE)(_col(a), _col(b), F.lit(full))


def best_score(scores: Column) -> Column:
    return F.greatest(*(scores[n] for n in kernels.SCORES))


def best_type(scores: Column, best: Column) -> Column:
    """The first score, in field order, that reaches the best one."""
    return reduce(lambda acc, n: acc.when(scores[n] == best, n), kernels.SCORES, F)


def weighted_score(scores: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the named scores."""
    weights = weights or WEIGHTS
    named = {n: weights[n] for n in kernels.SCORES if n in weights}
    total = sum(named.values())
    return sum((scores[n] * w for n, w in named.items()), F.lit(0.0)) / F.lit(total)


def score_pairs(df: DataFrame, a: str, b: str, full: bool = False) -> DataFrame:
    """Score every row's pair; each distinct pair is scored once.

    The pair columns are grouped first, so repeated pairs (and hot ones) cost one score and
    combine before the shuffle; the scores then join back on the pair.
    """
    n = compute_partitions(df.sparkSession)
    pairs = df.select(a, b).distinct().repartition(n, a, b)
    scored = pairs.withColumn("scores", pair_scores(a, b, full))
    scored = scored.withColumn("score", best_score(F.col("scores")))
    scored = scored.withColumn("match_type", best_type(F.col("scores"), F.col("score")))
    return df.join(scored, [a, b])


def score_natively(df: DataFrame, a: str, b: str, names: list[str]) -> DataFrame:
    """The named scores of every row's pair as columns, by expressions alone; each distinct pair is scored once."""
    n = compute_partitions(df.sparkSession)
    pairs = df.select(a, b).distinct().repartition(n, a, b)
    return df.join(pairs.select(a, b, *(NATIVE[name](a, b).alias(name) for name in names)), [a, b])


# ------------------------------------------------------------------ native parts


def bare(column) -> Column:
    """Lower text without punctuation."""
    word = r"\p{L}\p{N}_"
    return F.lower(F.regexp_replace(_col(column), f"[^{word}{SPACE[1:-1]}]", ""))


def number_format(column) -> Column:
    """Digits and dots only."""
    return F.regexp_replace(_col(column), f"[^{DIGIT}.]", "")


def is_number_format_difference(a, b) -> Column:
    return number_format(a) == number_format(b)


def is_unit_conversion(a, b) -> Column:
    """Same count of numbers, each quotient within range; true when there are none."""
    low, high = kernels.QUOTIENT_RANGE
    quotient = F.transform(
        F.arrays_zip(numbers(a).alias("x"), numbers(b).alias("y")),
        lambda z: F.coalesce(F.try_divide(z["x"], z["y"]), F.lit(0.0)).between(low, high),
    )
    return (F.size(numbers(a)) == F.size(numbers(b))) & F.forall(quotient, lambda q: q)


def pattern_score(a, b) -> Column:
    """The pattern score as a native expression."""
    points = kernels.PATTERN_POINTS
    rules = {
        "unit": is_unit_conversion(a, b),
        "equal": F.lower(_col(a)) == F.lower(_col(b)),
        "punctuation": bare(a) == bare(b),
        "number_format": is_number_format_difference(a, b),
    }
    parts = [F.when(rule, points[n]).otherwise(0) for n, rule in rules.items()]
    return F.least(sum(parts[1:], parts[0]), F.lit(100)).cast("double")


def levenshtein_score(a, b) -> Column:
    longest = F.greatest(F.char_length(_col(a)), F.char_length(_col(b)))
    return F.when(longest == 0, 100.0).otherwise(
        (1.0 - F.levenshtein(_col(a), _col(b)) / longest) * 100.0
    )


#: Scores that need no Python.
NATIVE = {**native_scores.NATIVE, "levenshtein": levenshtein_score, "pattern": pattern_score}
