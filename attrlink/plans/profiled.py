"""First stages of the cascade with per-key learned formats."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import matching as M
from ..operators import profiles as P
from ..operators.blocks import block_hits, merge_hits
from ..schema import INPUT_VALUE, KEYS
from ..session import stage
from .cascade import EXACT_COMMENT, answer

ASK = [*KEYS, INPUT_VALUE]
FORMATTED = 'Exact match found (formatted from "'


def match_profiled(inputs, reference, threshold, k, full, values=None):
    """Answers per distinct (key, input value): exact after smart normalization of both sides,
    exact after reformatting, then fuzzy with the profile's scores."""
    learned = P.profile_keys(reference).select(*KEYS, "typical_format", "case_sensitivity")
    learned = stage(learned, "profile")
    known = reference.select(*KEYS, "row_id", "preset_value").join(learned, KEYS)
    known = known.withColumn("smart", P.smart_normalize("preset_value", "case_sensitivity"))
    values = M.first_rows(known, [*KEYS, "smart"], ["preset_value"], k)
    exact = values.select(*KEYS, F.col("smart"), F.col("rows")[0].alias("exact"))

    asked = M.distinct_queries(inputs, [*ASK, "normalized"]).join(learned, KEYS, "left")
    asked = asked.withColumns(
        {
            "smart": P.smart_normalize(INPUT_VALUE, "case_sensitivity"),
            "formatted": P.format_to_pattern(INPUT_VALUE, "typical_format"),
        }
    )
    asked = asked.withColumn("reformed", P.smart_normalize("formatted", "case_sensitivity"))
    second = exact.withColumnsRenamed({"smart": "reformed", "exact": "second"})
    asked = asked.join(exact, [*KEYS, "smart"], "left").join(second, [*KEYS, "reformed"], "left")
    changed = F.col("formatted") != F.col(INPUT_VALUE)
    asked = asked.withColumn("second", F.when(changed & F.col("exact").isNull(), F.col("second")))
    asked = stage(asked, "exact")

    left = asked.filter("exact IS NULL AND second IS NULL AND case_sensitivity IS NOT NULL")
    presets = M.first_rows(
        known, [*KEYS, "preset_value", "smart"], ["preset_value"], k
    ).withColumnRenamed("preset_value", "value")
    presets = stage(presets, "presets")
    hits = block_hits(
        left.select(*ASK, "smart", "case_sensitivity"),
        presets.drop("rows"),
        KEYS,
        [INPUT_VALUE],
        ["value"],
        profiled_search(threshold, k),
        ["value", "rank"],
    )
    on = [*KEYS, "value"]
    near = merge_hits(hits, ASK, k, presets.select(*on, "rows"), on)

    fuzzy = F.transform(
        F.coalesce("matches", F.array()),
        lambda m: _fuzzy_answer(m, M.kind_name(m["kind"], kernels.PROFILED_SCORES)),
    )
    first = answer(
        F.col("exact.row_id"), F.col("exact.preset_value"), F.lit(100.0), F.lit("exact"),
        F.lit(EXACT_COMMENT),
    )
    note = F.concat(F.lit(FORMATTED), INPUT_VALUE, F.lit('" to "'), "formatted", F.lit('")'))
    then = answer(
        F.col("second.row_id"), F.col("second.preset_value"), F.lit(100.0), F.lit("exact"), note
    )
    matches = (
        F.when(F.col("exact").isNotNull(), F.array(first))
        .when(F.col("second").isNotNull(), F.array(then))
        .otherwise(fuzzy)
    )
    answers = asked.join(near, ASK, "left").withColumn("matches", matches)
    answers = stage(answers.select(*ASK, "normalized", "matches"), "in-key")
    return answers, ASK, M.first_rows(reference, [*KEYS, "normalized"], ["preset_value"], k)


def _fuzzy_answer(m, match_type):
    value = m["row"]["preset_value"]
    notes = P.profile_notes(F.col(INPUT_VALUE), value, F.col("case_sensitivity"))
    comment = M.similarity_comment(m["score"], match_type, notes)
    return answer(m["row"]["row_id"], value, m["score"], match_type, comment)


def profiled_search(threshold: float, k: int):
    def search(q: pa.Table, p: pa.Table):
        return kernels.best_profiled_in_block(
            q.column(INPUT_VALUE).to_pylist(),
            q.column("smart").to_pylist(),
            p.column("value").to_pylist(),
            p.column("smart").to_pylist(),
            p.column("rank").to_numpy(),
            bool(q.column("case_sensitivity")[0].as_py()),
            threshold,
            k,
        )

    return search
