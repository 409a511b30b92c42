"""The match cascade: exact in key, fuzzy in key, fuzzy across keys, nearest vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import text as X
from ..operators import clean as C
from ..operators import matching as M
from ..operators.terms import ValueRules
from ..schema import EXACT, INPUT_VALUE, KEYS, NOT_FOUND, PRESET_VALUE, RESULT_SCHEMA, SIMILAR
from ..session import compute_partitions, stage
from .prepared import VALUE_KEY, PreparedReference, cut, normalized_reference, reduced_reference

RAW_KEY = [*KEYS, INPUT_VALUE]
ANSWER_KEY = VALUE_KEY
EXACT_COMMENT = "Exact match found"
CROSS_COMMENT = "Cross-category match: "
SEMANTIC_COMMENT = "Semantic similarity match"


def match_values(
    inputs: DataFrame,
    reference: DataFrame | PreparedReference,
    threshold: float = 75.0,
    max_matches: int = 5,
    profile: str = "observed",
    emit_unmatched: bool = False,
    encoder: Callable[[str], Column] | None = None,
    cross_key: bool = True,
    distinct_inputs: bool = False,
    rules: ValueRules | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Match every input row against the reference table; rows as in ``RESULT_SCHEMA``.

    ``inputs`` needs ``input_id`` and the input columns, ``reference`` needs ``row_id`` and the
    reference columns, or is what ``prepare_reference`` made of such a table. A stage sees only what the stages before it left unmatched:

    1. equal normalized value in the same key (first row only),
    2. best pair score in the same key,
    3. best pair score over the whole reference table (rows carry the reference row's key),
    4. dot product of encoded values, when an ``encoder`` column function is given.

    ``profile`` is ``observed``, ``full`` (both edit measures, guarded number rules) or
    ``profiled`` (per-key learned formats, see ``operators.profiles``). ``emit_unmatched`` adds a
    ``Not Found`` row for each input without a match. ``distinct_inputs`` drops repeated inputs.
    ``rules`` widens what counts as the same spelling (units, synonyms, abbreviations,
    punctuation); formats learned per key are those of plain values, so ``profiled`` takes none.

    ``digits`` rounds the scores shown, once per answer; which rows are found and their order stay as they are.

    Values are normalized once per distinct key and raw value, and the questions are asked once per distinct key and
    normalized value; the answers, bounded arrays, join back to the inputs by key and raw value at the end, which is
    the one shuffle of the input table.
    """
    prepared = reference if isinstance(reference, PreparedReference) else None
    values = None
    if prepared:
        reference = prepared.reference
        values = None if profile == "profiled" else cut(prepared, int(max_matches), rules)
    if profile == "profiled":
        from .profiled import match_profiled as first_stages
    elif profile in ("observed", "full"):
        first_stages = match_in_key
    else:
        raise ValueError(f"unknown profile: {profile}")
    if rules is not None and profile == "profiled":
        raise ValueError("rules change the formats that the profiled stages learn; use another profile")
    full, k = profile == "full", int(max_matches)
    inputs = C.prepare_inputs(inputs)
    if distinct_inputs:
        inputs = inputs.dropDuplicates([*KEYS, INPUT_VALUE])
    questions = M.distinct_queries(inputs, RAW_KEY)
    if rules is None:
        questions = questions.withColumn("normalized", X.normalize(INPUT_VALUE))
    else:  # few bytes, much work
        questions = questions.repartition(compute_partitions(inputs.sparkSession), *RAW_KEY)
        questions = questions.withColumn("normalized", rules.apply(INPUT_VALUE, "attribute_name"))
    questions = stage(questions, "questions")
    if not prepared:
        if profile != "profiled":
            values = stage(reduced_reference(reference, k, rules), "values")
        reference = normalized_reference(reference, rules)

    answers, ask, values = first_stages(questions, reference, float(threshold), k, full, values)
    open_ = answers.filter("size(matches) = 0")
    if cross_key:
        across = stage(match_across(open_, values, threshold, k, full), "across")
        answers = (
            answers.alias("a")
            .join(across.select("normalized", F.col("matches").alias("more")), "normalized", "left")
            .withColumn(
                "matches",
                F.when(F.size("matches") == 0, F.coalesce("more", "matches")).otherwise(
                    F.col("matches")
                ),
            )
            .select(answers.columns)
        )
        if encoder is not None:
            answers = stage(answers, "answers")
            open_ = answers.filter("size(matches) = 0")
    answers = with_rounded_scores(answers.select(*ask, "matches"), digits)
    if ask != RAW_KEY:
        answers = questions.join(answers, ask).select(*RAW_KEY, "matches")
    found = inputs.join(answers, RAW_KEY, "left" if emit_unmatched else "inner")
    if encoder is not None:
        asked = questions.join(open_.select(*ask), ask, "left_semi").select(INPUT_VALUE).distinct()
        near = stage(with_rounded_scores(match_vectors(asked, reference, encoder, threshold, k), digits), "vectors")
        found = (
            found.join(near.withColumnRenamed("matches", "near"), INPUT_VALUE, "left")
            .withColumn(
                "matches",
                F.when(F.size("matches") == 0, F.coalesce("near", "matches")).otherwise(
                    F.col("matches")
                ),
            )
            .drop("near")
        )
    return result_rows(found, emit_unmatched)


def match_in_key(inputs, reference, threshold, k, full, values):
    """Answers of the first two stages per distinct (key, normalized value); staged, with the
    question columns and the reduced reference table ``values``, which all later steps read."""
    ask = ANSWER_KEY
    asked = stage(M.exact_in_key(M.distinct_queries(inputs, ask), values), "exact")
    left = asked.filter("exact IS NULL").select(*ask)
    near = M.fuzzy(left, values, KEYS, threshold, k, full)
    fuzzy = F.transform(
        F.coalesce("matches", F.array()),
        lambda m: answer(
            m["row"]["row_id"],
            m["row"]["preset_value"],
            m["score"],
            M.kind_name(m["kind"], kernels.SCORES),
            M.similarity_comment(m["score"], M.kind_name(m["kind"], kernels.SCORES)),
        ),
    )
    exact = answer(
        F.col("exact.row_id"), F.col("exact.preset_value"), F.lit(100.0), F.lit("exact"),
        F.lit(EXACT_COMMENT),
    )
    answers = (
        asked.join(near, ask, "left")
        .withColumn("matches", F.when(F.col("exact").isNotNull(), F.array(exact)).otherwise(fuzzy))
        .select(*ask, "matches")
    )
    return stage(answers, "in-key"), ask, values


def match_across(open_, values, threshold, k, full=False):
    """Answers over all keys per distinct normalized value.

    The first ``k`` rows of a value over all keys are among its first ``k`` rows per key, so the
    reduced table is enough.
    """
    rows = values.select(*ANSWER_KEY, F.inline("rows"))
    values = M.first_rows(rows, ["normalized"], [PRESET_VALUE, *KEYS], k)
    asked = open_.select("normalized").distinct()
    asked, values = stage(asked, "open"), stage(values, "all-values")
    near = M.fuzzy(asked, values, [], threshold, k, full)
    return near.select(
        "normalized",
        F.transform(
            "matches",
            lambda m: answer(
                m["row"]["row_id"],
                m["row"]["preset_value"],
                m["score"],
                M.kind_name(m["kind"], kernels.SCORES),
                F.concat(F.lit(CROSS_COMMENT), M.kind_name(m["kind"], kernels.SCORES)),
                m["row"],
            ),
        ).alias("matches"),
    )


def match_vectors(values, reference, encoder, threshold, k):
    """Answers by encoded value: the ``k`` nearest rows, then those that reach the threshold."""
    rows = M.first_rows(reference, ["preset_value"], ["preset_value", *KEYS], k)
    presets = stage(rows.withColumn("vector", encoder("preset_value")), "preset-vectors")
    asked = stage(values.withColumn("vector", encoder(INPUT_VALUE)), "input-vectors")
    hits = M.nearest_vectors(asked, presets, INPUT_VALUE, "preset_value", k, threshold)
    near = M.merge_hits(hits, [INPUT_VALUE], k, presets.select("preset_value", "rows"), ["preset_value"])
    return near.select(
        INPUT_VALUE,
        F.transform(
            "matches",
            lambda m: answer(
                m["row"]["row_id"], m["row"]["preset_value"], m["score"], F.lit("semantic"),
                F.lit(SEMANTIC_COMMENT), m["row"],
            ),
        ).alias("matches"),
    )


def answer(row_id, value, score, match_type, comment, key=None) -> Column:
    """One match. ``key`` is the reference row whose key the result shows, else the input's."""
    fields = [
        row_id.cast("long").alias("row_id"),
        value.alias("value"),
        score.alias("score"),
        match_type.alias("match_type"),
        comment.alias("comment"),
    ]
    shown = [
        (key[c] if key is not None else F.lit(None).cast("string")).alias(c) for c in KEYS
    ]
    return F.struct(*fields, F.struct(*shown).alias("key"))


def with_rounded_scores(answers: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return answers
    shown = F.transform("matches", lambda m: m.withField("score", F.round(m["score"], digits)))
    return answers.withColumn("matches", shown)


def result_rows(found: DataFrame, emit_unmatched: bool) -> DataFrame:
    """One row per input and match, in the fixed schema."""
    spread = F.posexplode_outer if emit_unmatched else F.posexplode
    rows = found.select(
        "input_id", INPUT_VALUE, *KEYS, spread("matches").alias("place", "m")
    )
    m = F.col("m")
    columns = {
        "input_id": F.col("input_id"),
        "match_rank": F.col("place") + 1,
        "original_input": F.col(INPUT_VALUE),
        "matched_value": m["value"],
        "similarity": m["score"],
        "comment": m["comment"],
        "suggested_value": m["value"],
        "status": F.when(m.isNull(), NOT_FOUND)
        .when(m["match_type"] == "exact", EXACT)
        .otherwise(SIMILAR),
        **{c: F.coalesce(m["key"][c], F.col(c)) for c in KEYS},
        "preset_row_id": m["row_id"],
        "match_type": m["match_type"],
    }
    return rows.select(
        *(columns[f.name].cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields)
    )


def display_columns(results: DataFrame) -> DataFrame:
    """Results under the ten headers users know."""
    from ..schema import RESULT_HEADERS

    return results.select(*(F.col(n).alias(h) for n, h in RESULT_HEADERS.items()))
