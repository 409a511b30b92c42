"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores a posting (term, row, place) for each training token that is a benchmark term,
written once to the shared folder without a shuffle. A phrase window (13 consecutive item words, or the
whole item if shorter) is searched from its rarest terms: the list of the rarest, shifted by its place in
the item, is intersected with the shifted list of the second rarest. What remains are alignments
(item, row, shift); the lists of all item terms, shifted alike, are met with them, and runs of
consecutive matches of a window's length are the exact phrase occurrences. ``near`` gives proximity
matches from the same index. All steps are DataFrame functions.

Terms are short: the whole benchmark vocabulary is broadcast only if its counted size allows, else it is
joined. Alignments of common passages grow with the documents that hold them, never with pairs of them.

Null and empty texts have no words. Rows with equal doc_id and text share their postings and are
returned once each; an empty benchmark leaves every document clean. Very long texts are whole: one
posting each token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .common import ascii_lower, small

WINDOW = 13
#: Share of a document's words inside occurrences from which it is contaminated, as 1 / PART.
PART = 20
#: Fixed value of the contract: characters that separate words, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def row_id() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def benchmark_terms(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, place, term, n) of all item words, and the numbered vocabulary (word, term)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).dropDuplicates(["item", "words"])
    # items of one id and several texts stay apart by their text
    placed = items.select(
        "item", F.xxhash64("item", "words").alias("key"), F.size("words").alias("n"), F.posexplode("words").alias("place", "word")
    )
    placed = stage(placed, "benchmark-words")
    terms = placed.select("word").distinct().select("word", F.xxhash64("word").alias("term"))
    return placed.withColumn("term", F.xxhash64("word")).drop("word"), terms


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, row, place), and one row (null, row, number of words, doc_id) per document."""
    vocabulary = small(stage(terms.withColumn("known", F.lit(True)), "benchmark-terms"))
    listed = documents.select("doc_id", row_id().alias("row"), words(F.col("text")).alias("words"))
    tokens = listed.select("doc_id", "row", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("place", "word"))
    joined = tokens.join(vocabulary, "word", "left").where(F.col("known") | F.col("word").isNull())
    return stage(
        joined.select("term", "row", "place", F.when(F.col("word").isNull(), F.col("doc_id")).alias("doc_id"), F.col("word").isNull().alias("end")),
        "posting-lists",
    )


def anchors(items: DataFrame, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """(first, first_place, second, second_place, key, start) per window: its two rarest terms."""
    counts = postings.groupBy("term").agg(F.count("*").alias("uses"))
    ranked = items.join(small(counts), "term", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    starts = ranked.withColumn(
        "start",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - (window - 1)), F.least(F.col("place"), F.greatest(F.lit(0), F.col("n") - window)))),
    )
    order = F.array_sort(F.collect_list(F.struct("uses", "place", "term")))  # at most one window's words
    found = starts.groupBy("key", "start").agg(order.alias("rare"))
    first, second = F.element_at("rare", 1), F.coalesce(F.try_element_at("rare", F.lit(2)), F.element_at("rare", 1))
    return found.where(first["uses"] > 0).select(
        "key", first["term"].alias("first"), first["place"].alias("first_place"),
        second["term"].alias("second"), second["place"].alias("second_place"),
    ).distinct()


def alignments(postings: DataFrame, rare: DataFrame) -> DataFrame:
    """(key, row, shift): where the two rarest terms of some window stand at the item's distance."""
    rare = stage(rare, "window-anchors")
    rare_rows = rare.count()
    one = postings.select(F.col("term").alias("first"), "row", "place").join(small(rare, rare_rows), "first")
    one = one.select("key", "row", (F.col("place") - F.col("first_place")).alias("shift"), "second", "second_place").distinct()
    two = rare.select("second", "second_place").distinct()
    two = postings.select(F.col("term").alias("second"), "row", "place").join(small(two, rare_rows), "second")
    two = two.select("second", "second_place", "row", (F.col("place") - F.col("second_place")).alias("shift"))
    return one.join(two.distinct(), ["second", "second_place", "row", "shift"]).select("key", "row", "shift").distinct()


def hits(documents_index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, place, item): document words inside an occurrence of a window."""
    postings = documents_index.where(~F.col("end")).select("term", "row", "place")
    found = stage(alignments(postings, anchors(items, postings, window)), "alignments")
    rows = stage(found.select("row").distinct(), "aligned-rows")
    mine = postings.join(small(rows), "row", "left_semi")
    expected = found.join(small(items.select("key", "item", "n", "term", F.col("place").alias("item_place"))), "key")
    expected = expected.select("key", "item", "n", "row", "shift", "term", (F.col("shift") + F.col("item_place")).alias("place"))
    matched = expected.join(mine, ["row", "place", "term"]).distinct()  # repeated rows share their places
    # runs of consecutive places; a partition holds one item's words at most
    line = Window.partitionBy("row", "key", "shift").orderBy("place")
    runs = matched.withColumn("run", F.col("place") - F.row_number().over(line))
    sizes = Window.partitionBy("row", "key", "shift", "run")
    inside = runs.withColumn("size", F.count("*").over(sizes)).where(F.col("size") >= F.least(F.lit(window), F.col("n")))
    return inside.select("row", "place", "item")


def judge(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row, n_words, n_hit, n_items, items (sorted) and contaminated of each document."""
    items, terms = benchmark_terms(benchmark)
    index = build_index(documents.select("doc_id", "text"), terms)
    inside = stage(hits(index, items, window).distinct(), "phrase-hits")
    counts = inside.groupBy("row", "place").agg(F.lit(1)).groupBy("row").agg(F.count("*").alias("n_hit"))
    named = inside.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    marks = counts.join(named, "row")
    whole = index.where("end").select("doc_id", "row", F.col("place").cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return whole.join(small(marks), "row", "left").select(
        "doc_id", "row", "n_words", hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"), ((hit > 0) & (hit * PART >= F.col("n_words"))).alias("contaminated"),
    )


def near(documents: DataFrame, phrases: DataFrame, slop: int) -> DataFrame:
    """Proximity matches: (item, doc_id, start) where all words of a phrase occur, in any order, within
    its length plus ``slop`` words from a place of its rarest term. ``phrases``: item_id, text."""
    items, terms = benchmark_terms(phrases)
    index = build_index(documents.select("doc_id", "text"), terms)
    postings = index.where(~F.col("end")).select("term", "row", "place")
    counts = postings.groupBy("term").agg(F.count("*").alias("uses"))
    wanted = items.groupBy("key", "item", "n", "term").agg(F.count("*").alias("times"))
    ranked = wanted.join(counts, "term", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    best = ranked.groupBy("key").agg(F.min(F.struct("uses", "term")).alias("best"), F.count("*").alias("distinct"))
    seeds = best.select("key", "distinct", F.col("best.term").alias("term")).join(postings, "term")
    seeds = seeds.select("key", "distinct", "row", F.col("place").alias("at"))
    around = seeds.join(wanted, "key").join(postings, ["row", "term"])
    reach = F.col("n") + slop
    around = around.where(F.abs(F.col("place") - F.col("at")) < reach)
    # every window of the reach that holds the seed starts at one of the matched places up to it
    starts = around.where("place <= at").select("key", "row", "at", F.col("place").alias("start")).distinct()
    met = starts.join(around, ["key", "row", "at"]).where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + reach) & (F.col("at") < F.col("start") + reach))
    per = met.groupBy("key", "item", "row", "at", "start", "distinct", "term", "times").agg(F.countDistinct("place").alias("have"))
    full = per.where("have >= times").groupBy("item", "row", "start", "at", "distinct").agg(F.count("*").alias("terms")).where("terms = distinct")
    names = index.where("end").select("row", "doc_id").distinct()
    return full.select("item", "row", "start").distinct().join(names, "row").select("item", "doc_id", "start")
