"""Named queries over the trade tables, one or more per operator."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import similarity as S
from ..functions import text as X
from ..operators import clean as C
from ..operators import matching as M
from ..operators import profiles as P
from ..operators import quality as Q
from ..operators import report as R
from ..operators import terms as U
from ..schema import INPUT_COLUMNS, KEYS, REFERENCE_COLUMNS, STATUSES
from ..session import stage, stage_folder
from ..sources import sample, sinks, snapshot, tables
from . import views as V
from .cascade import match_values
from .prepared import prepare_reference

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(column, digits=6):
    return F.round(column, digits)


def scores_rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", rounded("similarity"))


# ------------------------------------------------------------------ cleaning and columns


@query
def clean_reference(spark: SparkSession, folder: str) -> DataFrame:
    return C.clean_reference(V.raw_reference(spark, folder))


@query
def computed_columns(spark, folder):
    return tables.load_reference(V.raw_reference(spark, folder)).drop(*REFERENCE_COLUMNS)


@query
def normalize_values(spark, folder):
    text = V.table(spark, folder, "documents").select("doc_id", X.normalize("text").alias("n"))
    return text.select(
        "doc_id", F.md5("n").alias("digest"), F.char_length("n").alias("length").cast("long")
    )


@query
def value_flags(spark, folder):
    return V.table(spark, folder, "conversations").select(
        "conv_id", "turn", X.has_units("text").alias("has_units"),
        X.has_numbers("text").alias("has_numbers"), X.has_commas("text").alias("has_commas"),
    )


@query
def alias_inputs(spark, folder):
    raw = V.inputs(spark, folder).toDF(
        "input_id", "Structure", "Full Structure", "Attribute Name", "Attribute value"
    )
    return C.clean_inputs(raw)


@query
def positional_inputs(spark, folder):
    raw = V.inputs(spark, folder).toDF("input_id", "first", "second", "third", "fourth")
    return C.clean_inputs(raw)


@query
def positional_three(spark, folder):
    """Three columns hold no value; with ``compat_positional`` the category stands in for it."""
    raw = V.inputs(spark, folder).drop("input_value").toDF("input_id", "first", "second", "third")
    both = [C.clean_inputs(raw, compat).withColumn("compat", F.lit(compat)) for compat in (False, True)]
    return both[0].unionByName(both[1])


@query
def structure_report(spark, folder):
    """What each table lacks as a reference and as inputs, beside its rows."""
    shapes = {
        "reference": V.reference(spark, folder), "inputs": V.inputs(spark, folder), "accounts": V.accounts(spark, folder),
        "raw": V.raw_reference(spark, folder), "keyless": V.inputs(spark, folder).drop("sub_category", "input_value"),
    }
    rows = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("shape"), F.lit(",".join(C.missing_columns(df, REFERENCE_COLUMNS))).alias("reference_lacks"),
            F.lit(",".join(C.missing_columns(df, INPUT_COLUMNS))).alias("inputs_lack"),
            F.lit(C.has_structure(df)).alias("is_reference"), F.lit(C.has_structure(df, "input")).alias("is_input"), "n_rows",
        )
        for name, df in shapes.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query
def blank_inputs(spark, folder):
    """Null, empty and blank values leave the inputs before they are matched."""
    blank = F.expr("CASE input_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' \t ' ELSE input_value END")
    return C.prepare_inputs(V.inputs(spark, folder).withColumn("input_value", blank))


@query
def computed_if_absent(spark, folder):
    """Columns that a table brings stay as they are; the others are computed."""
    own = V.reference(spark, folder).withColumns({"normalized": F.upper("preset_value"), "has_units": F.lit(False)})
    return C.add_computed_columns(own)


@query
def row_positions(spark, folder):
    placed = tables.with_row_ids(V.table(spark, folder, "customer").select("c_custkey"))
    return placed.select("c_custkey", "row_id")


@query
def display_cut(spark, folder):
    cut = C.clean_for_display(V.table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return cut


@query
def validation_report(spark, folder):
    raw = V.raw_reference(spark, folder).toDF("input_id", *INPUT_COLUMNS)
    return C.validate_inputs(raw)


# ------------------------------------------------------------------ pair scores


def _scored(spark, folder, full=False):
    return S.score_pairs(V.pairs(spark, folder), "a", "b", full)


def _score_query(name, full=False):
    def run(spark, folder):
        if name in S.NATIVE:
            return S.score_natively(V.pairs(spark, folder), "a", "b", [name]).select("p_partkey", "a", "b", rounded(name).alias("score"))
        scored = _scored(spark, folder, full)
        return scored.select("p_partkey", "a", "b", rounded(f"scores.{name}").alias("score"))

    return run


for _name in kernels.SCORES:
    QUERIES[f"score_pairs_{_name}"] = _score_query(_name, _name in ("jaro_winkler", "levenshtein"))


@query
def score_pairs_best(spark, folder):
    return _scored(spark, folder).select(
        "p_partkey", "a", "b", rounded("score").alias("score"), "match_type",
        M.similarity_comment(F.col("score"), F.col("match_type")).alias("comment"),
        X.percent(rounded("score")).alias("shown"),
    )


@query
def score_pairs_native(spark, folder):
    """The scores that Spark has built-in functions for, without Python."""
    return V.pairs(spark, folder).select(
        "p_partkey", "a", "b", rounded(S.levenshtein_score("a", "b")).alias("levenshtein"),
        S.pattern_score("a", "b").alias("pattern"), X.sorted_tokens("a").alias("sorted_a"),
    )


@query
def explain_match(spark, folder):
    scored = _scored(spark, folder)
    return scored.select("p_partkey", "a", "b", M.explain_match("a", "b", "match_type").alias("note"))


@query
def weighted_score(spark, folder):
    scored = _scored(spark, folder, full=True)
    return scored.select(
        "p_partkey", "a", "b", rounded(S.weighted_score(F.col("scores"))).alias("score")
    )


@query
def score_conversation_turns(spark, folder):
    """Long values: each turn's whole text against the next turn's, by the measures of whole texts."""
    turns = V.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    pair = turns.join(after, ["conv_id", "turn"])
    return pair.select(
        "conv_id", "turn",
        rounded(S.levenshtein_score(F.lower("text"), F.lower("next"))).alias("levenshtein"),
        S.pattern_score(F.lower("text"), F.lower("next")).alias("pattern"),
    )


# ------------------------------------------------------------------ match stages


def _tables(spark, folder):
    inputs = C.prepare_inputs(V.inputs(spark, folder))
    inputs = inputs.withColumn("normalized", X.normalize("input_value"))
    return inputs, C.add_computed_columns(V.reference(spark, folder))


@query
def exact_match(spark, folder):
    inputs, reference = _tables(spark, folder)
    values = stage(M.first_rows(reference, [*KEYS, "normalized"], ["preset_value"], 1), "values")
    hits = M.exact_in_key(inputs, values).filter("exact IS NOT NULL")
    return hits.select(
        "input_id", *KEYS, "input_value", F.col("exact.preset_value").alias("matched_value"),
        F.col("exact.row_id").alias("preset_row_id"),
    )


@query
def fuzzy_in_key(spark, folder):
    """Best rows in the key for every distinct name and size, exact ones included."""
    inputs, reference = _tables(spark, folder)
    ask = [*KEYS, "normalized"]
    values = M.first_rows(reference, ask, ["preset_value"], 5)
    near = M.fuzzy(M.distinct_queries(inputs, ask), values, KEYS, 75.0, 5)
    return _spread(near, ask)


@query
def cross_key(spark, folder):
    """Best rows of the whole reference table for every distinct normalized value."""
    inputs, reference = _tables(spark, folder)
    values = M.first_rows(reference, ["normalized"], ["preset_value", *KEYS], 5)
    near = M.fuzzy(M.distinct_queries(inputs, ["normalized"]), values, [], 75.0, 5)
    return _spread(near, ["normalized"])


def _spread(near, ask):
    rows = near.select(*ask, F.posexplode("matches").alias("place", "m"))
    return rows.select(
        *ask, (F.col("place") + 1).alias("match_rank"), F.col("m.row_id").alias("preset_row_id"),
        F.col("m.row.preset_value").alias("matched_value"),
        rounded("m.score").alias("similarity"),
        M.kind_name(F.col("m.kind"), kernels.SCORES).alias("match_type"),
    )


def _cascade(spark, folder, **options):
    return match_values(V.inputs(spark, folder), V.reference(spark, folder), **options)


@query
def match_cascade(spark, folder):
    return scores_rounded(_cascade(spark, folder))


@query
def match_cascade_full(spark, folder):
    return scores_rounded(_cascade(spark, folder, profile="full", threshold=85.0, max_matches=3))


@query
def match_profiled(spark, folder):
    return scores_rounded(_cascade(spark, folder, profile="profiled", max_matches=3))


@query
def match_semantic(spark, folder):
    """All four stages: the nearest encoded values answer what the scores leave open."""
    options = {"threshold": 60.0, "max_matches": 3}
    return scores_rounded(_cascade(spark, folder, encoder=M.hashed_trigrams, **options))


@query
def match_prepared(spark, folder):
    """The reference reduced once and kept in buckets; two sets of inputs are matched against it."""
    inputs = V.inputs(spark, folder)
    with prepare_reference(V.reference(spark, folder)) as prepared:
        halves = [match_values(inputs.where(F.col("input_id") % 2 == i), prepared, digits=6) for i in (0, 1)]
    # the answers are staged, so the rows read no prepared table and need not be written here
    return halves[0].unionByName(halves[1])


@query
def match_semantic_in_key(spark, folder):
    """What the key leaves open goes straight to the nearest encoded values."""
    options = {"threshold": 60.0, "max_matches": 3, "cross_key": False}
    return scores_rounded(_cascade(spark, folder, encoder=M.hashed_trigrams, **options))


@query
def match_low_threshold(spark, folder):
    """At 55 every text is similar to every text of its key; the best rows still come first."""
    return scores_rounded(_cascade(spark, folder, threshold=55.0, max_matches=3))


@query
def unmatched(spark, folder):
    found = _cascade(spark, folder, emit_unmatched=True)
    return found.filter("status = 'Not Found'").select("input_id", *KEYS, "original_input", "status")


@query
def match_accounts(spark, folder):
    """A reference whose distinct values grow with the data: account names per order."""
    found = match_values(V.account_inputs(spark, folder), V.accounts(spark, folder), max_matches=3)
    return scores_rounded(found)


@query
def semantic_topk(spark, folder):
    """The five nearest vectors of every vector, itself included."""
    vectors = V.table(spark, folder, "embeddings")
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    presets = vectors.withColumnsRenamed({"vec_id": "match_id"}).withColumn("rank", F.col("match_id"))
    hits = M.nearest_vectors(vectors, presets, "vec_id", "match_id", 5)
    by = F.row_number().over(
        M.Window.partitionBy("vec_id").orderBy(F.desc("score"), F.asc("match_id"))
    )
    top = hits.withColumn("match_rank", by).filter("match_rank <= 5")
    return top.select("vec_id", "match_rank", "match_id", rounded("score", 4).alias("similarity"))


# ------------------------------------------------------------------ profiles


@query
def key_profile(spark, folder):
    profile = P.profile_keys(V.reference(spark, folder))
    lists = ["separators", "common_units", "unit_combinations", "decimal_places"]
    return profile.select(
        *KEYS, F.col("values").alias("n_values"), "typical_format", "case_sensitivity", "min_value",
        "max_value", *(F.concat_ws("/", F.col(c).cast("array<string>")).alias(c) for c in lists),
        *(F.col(f"case_patterns.{c}").alias(c) for c in P.CASES),
        *(
            F.try_element_at("multipliers", F.lit(m)).alias(f"has_{m}" if m.islower() else f"has_upper_{m.lower()}")
            for m in P.MULTIPLIERS
        ),
    )


@query
def key_units(spark, folder):
    """Units, unit combinations and decimals of each key, one row each, the most used first."""
    return P.key_items(V.reference(spark, folder))


@query
def typical_format(spark, folder):
    return P.typical_formats(V.reference(spark, folder))


@query
def value_parts(spark, folder):
    parts = V.pairs(spark, folder).select("p_partkey", "b", P.value_parts("b").alias("v"))
    return parts.select(
        "p_partkey", "b",
        F.array_join(F.transform("v.numbers", lambda x: F.round(x * 10).cast("long").cast("string")), "/").alias("numbers"),
        F.array_join("v.multipliers", "/").alias("multipliers"),
        F.array_join("v.units", "/").alias("units"),
    )


@query
def smart_normalize(spark, folder):
    """Inputs normalized and rewritten by what their key has taught."""
    learned = P.profile_keys(V.reference(spark, folder)).select(
        *KEYS, "typical_format", "case_sensitivity"
    )
    inputs = V.inputs(spark, folder).join(learned, KEYS)
    return inputs.select(
        "input_id", "input_value",
        P.smart_normalize("input_value", "case_sensitivity").alias("smart"),
        P.format_to_pattern("input_value", "typical_format").alias("formatted"),
    )


@query
def key_index(spark, folder):
    return P.key_index(C.add_computed_columns(V.reference(spark, folder)))


# ------------------------------------------------------------------ reports on results


def _results(spark, folder):
    found = _cascade(spark, folder, emit_unmatched=True, max_matches=3)
    return stage(found, "results")


@query
def result_summary(spark, folder):
    return R.summary(_results(spark, folder), "2024-01-01 00:00:00")


@query
def status_breakdown(spark, folder):
    return R.status_breakdown(_results(spark, folder))


@query
def category_pivot(spark, folder):
    pivot = R.category_status(_results(spark, folder))
    return pivot.toDF("category", "exact", "similar", "not_found")


@query
def score_histogram(spark, folder):
    found = R.score_histogram(_results(spark, folder))
    return found.select("bin", rounded("bin_start").alias("bin_start"), "count")


@query
def result_filter(spark, folder):
    found = R.filter_results(_results(spark, folder), "Similar Match", "PROMO", 80.0)
    return scores_rounded(found.select("input_id", "match_rank", "similarity", "preset_row_id"))


@query
def result_filter_not_found(spark, folder):
    found = R.filter_results(_results(spark, folder), "Not Found")
    return found.select("input_id", "category", "original_input")


@query
def filter_choices(spark, folder):
    return R.filter_choices(_results(spark, folder))


@query
def worst_categories(spark, folder):
    return R.worst_categories(_results(spark, folder))


@query
def top_categories(spark, folder):
    return R.category_distribution(V.reference(spark, folder))


@query
def load_metrics(spark, folder):
    kinds = {"reference": V.reference, "input": V.inputs}
    parts = [
        R.load_metrics(view(spark, folder)).withColumn("kind", F.lit(n)) for n, view in kinds.items()
    ]
    return parts[0].unionByName(parts[1])


@query
def preview(spark, folder):
    """The first rows shown of a loaded reference table."""
    return R.preview(V.reference(spark, folder), 20)


# ------------------------------------------------------------------ quality


@query
def quality_report(spark, folder):
    return Q.quality_report(V.table(spark, folder, "customer"))


@query
def quality_numeric(spark, folder):
    """A table without text columns."""
    return Q.quality_report(V.table(spark, folder, "labels"))


@query
def data_summary(spark, folder):
    return Q.data_summary(V.table(spark, folder, "documents"))


@query
def duplicate_rows(spark, folder):
    return Q.duplicate_rows(V.table(spark, folder, "documents").select("text", "lang"))


@query
def top_values(spark, folder):
    return Q.top_values(V.table(spark, folder, "events"))


@query
def most_common(spark, folder):
    return Q.most_common(V.table(spark, folder, "orders"))


# ------------------------------------------------------------------ dictionaries


def _sized(spark, folder):
    """Part sizes in mixed units, with an attribute to go by."""
    return V.table(spark, folder, "part").selectExpr(
        "p_partkey AS row_id", "p_type AS category", "'all' AS sub_category",
        "CASE p_partkey % 3 WHEN 0 THEN 'Length' WHEN 1 THEN 'Operating temp' ELSE 'Capacitance or Width' END AS attribute_name",
        """CASE p_partkey % 6
             WHEN 0 THEN concat(p_size, ' mm') WHEN 3 THEN concat(p_size / 10, 'CM')
             WHEN 1 THEN concat(p_size, ' C max') WHEN 4 THEN concat(p_size * 2, '°F, typ w')
             WHEN 2 THEN concat(p_size, ' f') ELSE concat(p_size, ' kg x ', p_size, ' lb, w')
           END AS preset_value""",
    )


@query
def unit_normalize(spark, folder):
    quantities = F.posexplode(U.quantities("preset_value", "attribute_name")).alias("place", "q")
    found = _sized(spark, folder).select("row_id", "preset_value", quantities)
    return found.select(
        "row_id", "preset_value", "place", "q.unit", "q.dimension",
        rounded(U.round_significant(F.col("q.base"), 6)).alias("base"),
    )


@query
def unit_match(spark, folder):
    """Sizes in inches against reference sizes in millimetres of the same key."""
    inputs = V.table(spark, folder, "part").selectExpr(
        "p_partkey AS input_id", "p_type AS category", f"{V.BAND} AS sub_category",
        "'Size' AS attribute_name", "concat(round(p_size / 25.4D, 4), ' in') AS input_value",
    )
    found = U.unit_matches(inputs, V.reference(spark, folder), k=3)
    return found.select("input_id", "match_rank", "input_value", "preset_row_id", "preset_value")


@query
def synonym_expand(spark, folder):
    expanded = U.expand_synonyms("preset_value", "attribute_name").alias("expanded")
    return _sized(spark, folder).select("row_id", "preset_value", expanded)


@query
def abbrev_expand(spark, folder):
    expanded = U.expand_abbreviations("preset_value").alias("expanded")
    return _sized(spark, folder).select("row_id", "preset_value", expanded)


@query
def value_rules(spark, folder):
    rules = U.ValueRules(remove_punctuation=True, handle_abbreviations=True)
    form = rules.apply("preset_value", "attribute_name").alias("form")
    return _sized(spark, folder).select("row_id", "preset_value", form)


@query
def match_case_kept(spark, folder):
    """The cascade over values that keep their case."""
    rules = U.ValueRules(normalize_case=False)
    return _cascade(spark, folder, rules=rules, max_matches=3, digits=6)


@query
def match_rules(spark, folder):
    """The cascade with every spelling rule on."""
    rules = U.ValueRules(True, True, True, True, True)
    return _cascade(spark, folder, rules=rules, max_matches=3, digits=6)


# ------------------------------------------------------------------ sources and sinks


def _folder(spark):
    return f"{stage_folder(spark)}/files-{uuid.uuid4().hex}"


@query
def upsert_reference(spark, folder):
    """Edits keyed by row: sizes of every row replaced where odd, rows of the next id added."""
    reference = C.add_computed_columns(V.reference(spark, folder))
    edits = V.reference(spark, folder).selectExpr(
        "CASE WHEN row_id % 2 = 1 THEN row_id ELSE -1 - row_id END AS row_id", *KEYS,
        "concat(preset_value, ' new') AS preset_value",
    )
    gone = V.table(spark, folder, "supplier").selectExpr("2 * s_suppkey AS row_id")
    found = snapshot.upsert(reference, edits, gone)
    return found.select("row_id", "preset_value", "normalized", "has_units")


@query
def sample_data(spark, folder):
    return sample.draw(V.table(spark, folder, "orders"), "o_orderkey")


@query
def snapshot_roundtrip(spark, folder):
    path = _folder(spark)
    build = lambda: V.raw_reference(spark, folder)
    snapshot.load_or_build(spark, path, build)
    return snapshot.refresh(snapshot.load_or_build(spark, path, build), path)


@query
def distinct_over_versions(spark, folder):
    """Distinct values over two versions of the orders, from their sketches alone, beside the exact counts."""
    orders = V.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    path = _folder(spark)
    for version, rows in enumerate((orders.where("o_orderkey % 3 <> 0"), orders.where("o_orderkey % 2 = 0"))):
        Q.distinct_sketches(rows, orders.columns, f"v{version}").write.mode("append").parquet(path)
    estimates = Q.distinct_estimates(spark.read.parquet(path))
    seen = orders.where("o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
    exact = seen.agg(*(F.count_distinct(c).alias(c) for c in orders.columns)).unpivot([], orders.columns, "column", "exact")
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1), 0.03 * F.col("exact"))
    return estimates.join(exact, "column").select("column", "rows", "exact", near.alias("within_three_percent"))


@query
def snapshot_info(spark, folder):
    path = _folder(spark)
    snapshot.load_or_build(spark, path, lambda: V.raw_reference(spark, folder))
    info = snapshot.snapshot_info(spark, path)
    rows = snapshot.read_snapshot(spark, path).agg(F.count("*").alias("n_rows"))
    facts = info.select("exists", (F.col("bytes") > 0).alias("has_bytes"), F.lit(1).alias("one"))
    return facts.join(rows.withColumn("one", F.lit(1)), "one").drop("one")


@query
def csv_roundtrip(spark, folder):
    path = _folder(spark)
    sinks.write_csv(_results(spark, folder).select("input_id", "original_input", "comment"), path)
    return tables.read_table(spark, path, "csv")


_DISPLAYED = ["Category", "Sub-Category", "Attribute Name"]


@query
def report_parts(spark, folder):
    path = _folder(spark)
    parts = sinks.write_report(_results(spark, folder), path, "parquet", "2024-01-01 00:00:00")
    read = {part: spark.read.parquet(f"{path}/{part}") for part in parts}
    line = lambda name, *columns: F.concat_ws("|", *(F.col(f"`{c}`").cast("string") for c in columns)).alias(name)
    none = F.lit(None).cast("double").alias("score")
    shape = {
        "comparison_results": [line("name", "Preset Row ID"), line("detail", "Original Input", "Matched Preset Value", "Comment", "Suggested Value", "Status", *_DISPLAYED), rounded("`Similarity %`").alias("score")],
        "summary": [line("name", "metric"), line("detail", "value"), none],
        "status_breakdown": [line("name", "status"), line("detail", "count"), none],
        "category_analysis": [line("name", "category"), line("detail", *STATUSES), none],
    }
    found = [read[part].select(F.lit(part).alias("part"), *shape[part]) for part in parts]
    return reduce(DataFrame.unionByName, found)
