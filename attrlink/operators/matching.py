"""The match stages: exact in key, fuzzy in key, fuzzy across keys, nearest vectors."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import text as X
from ..schema import KEYS
from .blocks import TREE_BLOCKS, block_hits, merge_hits
from .pruning import few_blocks, pruned_hits, streamed_vector_hits, text_arrangement, vector_arrangement


def first_rows(reference: DataFrame, by: list[str], columns: list[str], k: int) -> DataFrame:
    """Per distinct value its first ``k`` rows in row order, and the first row id as ``rank``.

    The row limit is applied before the shuffle as well, so a value that fills a third of the
    table costs each task ``k`` rows.
    """
    order = Window.partitionBy(*by).orderBy("row_id")
    held = F.struct("row_id", *columns).alias("row")
    rows = reference.select(*by, "row_id", held)
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    rows = rows.groupBy(*by).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return rows.withColumn("rank", F.col("rows")[0]["row_id"])


def distinct_queries(inputs: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct match questions: inputs that differ only in spelling noise are asked once."""
    return inputs.select(*columns).distinct()


def exact_in_key(queries: DataFrame, values: DataFrame) -> DataFrame:
    """Queries with the first reference row of the same key and normalized value, or null."""
    hit = values.select(*KEYS, "normalized", F.col("rows")[0].alias("exact"))
    return queries.join(hit, [*KEYS, "normalized"], "left")


def fuzzy_search(threshold: float, k: int, full: bool):
    def search(q: pa.Table, p: pa.Table, need=threshold):
        return kernels.best_in_block(
            q.column("normalized").to_pylist(),
            p.column("value").to_pylist(),
            p.column("rank").to_numpy(),
            need,
            k,
            full,
        )

    return search


def fuzzy(
    queries: DataFrame,
    values: DataFrame,
    keys: list[str],
    threshold: float,
    k: int,
    full: bool = False,
) -> DataFrame:
    """Best ``k`` rows per query by the largest of the pair scores, at least ``threshold``.

    Within keys every block of a key meets every other; without keys blocks are ordered and pruned."""
    presets = values.withColumnRenamed("normalized", "value")
    bare, search = presets.select(*keys, "value", "rank"), fuzzy_search(float(threshold), int(k), full)
    if keys or few_blocks(queries, bare):
        larger = (1, 1) if full else TREE_BLOCKS
        hits = block_hits(queries, bare, keys, ["normalized"], ["value"], search, ["value", "rank"], larger)
    else:
        hits = pruned_hits(
            queries, bare, "normalized", "value", ["value", "rank"], search, text_arrangement(full), int(k), float(threshold)
        ).hits
    on = [*keys, "value"]
    return merge_hits(hits, [*keys, "normalized"], k, presets.select(*on, "rows"), on)


# ------------------------------------------------------------------ vectors


def hashed_trigrams(column, size: int = 256) -> Column:
    """Default text encoder: hashed character trigrams. Any column function that returns an
    array of doubles of one length can take its place."""
    padded = F.concat(F.lit(" "), F.lower(X.text(column)), F.lit(" "))
    places = F.sequence(F.lit(1), F.greatest(F.char_length(padded) - 2, F.lit(1)))
    digest = lambda i: F.substring(F.md5(F.substring(padded, i, F.lit(3))), 1, 8)
    slots = F.transform(places, lambda i: F.conv(digest(i), 16, 10).cast("long") % size)
    every = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))

    def scaled(counts, table):
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda total, c: total + c * c))
        return _let(norm, lambda n: F.transform(every, lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0.0)) / n))

    def count(found, used):
        counts = F.transform(used, lambda u: F.size(F.filter(found, lambda s: s == u)).cast("double"))
        return _let(counts, lambda c: _let(F.map_from_arrays(used, c), lambda table: scaled(c, table)))

    return _let(slots, lambda found: _let(F.array_distinct(found), lambda used: count(found, used)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vector_search(k: int, threshold: float):
    def search(q: pa.Table, p: pa.Table, need=threshold):
        return kernels.nearest_in_block(
            kernels.matrix(q.column("vector")),
            kernels.matrix(p.column("vector")),
            p.column("rank").to_numpy(),
            need,
            k,
        )

    return search


def nearest_vectors(
    queries: DataFrame,
    presets: DataFrame,
    query_id: str,
    preset_id: str,
    k: int,
    threshold: float = float("-inf"),
    keys: list[str] | None = None,
) -> DataFrame:
    """Best ``k`` presets per query by the dot product of their ``vector`` columns, times 100.

    Equal scores are ordered by ``rank``. Exact: within keys every query block meets every preset block
    as one matrix product; without keys packed blocks of near vectors are read where they lie, and those that can't
    hold any of the ``k`` best are left out.
    """
    keys = keys or []
    bare = presets.select(*keys, preset_id, "rank", "vector")
    if not keys and not few_blocks(queries, bare):
        asked = queries.select(query_id, "vector")
        return streamed_vector_hits(asked, bare, query_id, preset_id, vector_arrangement(bare), int(k), float(threshold))
    return block_hits(
        queries, bare, keys, [query_id], [preset_id], vector_search(k, threshold), [preset_id, "rank"]
    )


# ------------------------------------------------------------------ comments and result rows


def kind_name(kind: Column, names) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), kind + 1)


# What a fuzzy comment says about the score that decided; other scores say nothing.
COMMENT_WORDS = {
    "ratio": "overall similarity",
    "partial_ratio": "partial match",
    "token_sort_ratio": "reordered words",
    "pattern": "pattern match",
    "multiplier_unit": "multiplier/unit match",
}


def similarity_comment(score: Column, match_type: Column, extra: list[Column] = ()) -> Column:
    """``similar 86% | overall similarity``; the percentage rounds half-even."""
    percent = F.concat(
        F.lit("similar "), F.bround(score, 0).cast("long").cast("string"), F.lit("%")
    )
    words = reduce(
        lambda acc, kv: acc.when(match_type == kv[0], kv[1]), COMMENT_WORDS.items(), F
    )
    return F.concat_ws(" | ", percent, *extra, words)


# The long explanation of a match.
EXPLANATIONS = {
    "ratio": "High overall similarity",
    "partial_ratio": "Contains similar substring",
    "token_sort_ratio": "Similar words in different order",
    "token_set_ratio": "Similar word set",
    "jaro_winkler": "Similar character sequence",
    "levenshtein": "Small edit distance",
    "pattern": "Pattern-based match (format/unit differences)",
}
EXPLANATION_DEFAULT = "Similar match found"
EXPLANATION_NOTES = {
    "case": " (case difference)",
    "punctuation": " (punctuation difference)",
    "unit": " (unit conversion)",
    "number": " (number format difference)",
}


def explain_match(a, b, match_type) -> Column:
    """Explanation of a match plus the first difference note that holds for the raw values."""
    from ..functions import similarity as S

    a, b, kind = X._col(a), X._col(b), X._col(match_type)
    words = F.element_at(F.create_map(*(F.lit(x) for kv in EXPLANATIONS.items() for x in kv)), kind)
    notes = EXPLANATION_NOTES
    note = (
        F.when(F.lower(a) == F.lower(b), notes["case"])
        .when(S.bare(a) == S.bare(b), notes["punctuation"])
        .when(S.is_unit_conversion(a, b), notes["unit"])
        .when(S.is_number_format_difference(a, b), notes["number"])
        .otherwise("")
    )
    return F.concat(F.coalesce(words, F.lit(EXPLANATION_DEFAULT)), note)
