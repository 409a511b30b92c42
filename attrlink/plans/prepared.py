"""A reference table that is reduced once and matched many times."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import matching as M
from ..operators.terms import ValueRules
from ..schema import KEYS, PRESET_VALUE
from ..session import compute_partitions, delete_folder, stage_folder

#: What a value is found by.
VALUE_KEY = [*KEYS, "normalized"]


def normalized_reference(reference: DataFrame, rules: ValueRules | None) -> DataFrame:
    """``reference`` with its ``normalized`` values, as ``rules`` spell them if given."""
    if rules is None:
        return C.add_computed_columns(reference)
    return reference.withColumn("normalized", rules.apply(PRESET_VALUE, "attribute_name"))


def reduced_reference(reference: DataFrame, k: int, rules: ValueRules | None) -> DataFrame:
    """Per key and normalized value the first ``k`` rows, as ``first_rows`` gives them.

    They are among the first ``k`` rows of their key and raw value, so the table is reduced by raw values before any
    value is normalized: rules cost much more than the reduction, and values repeat."""
    if rules is None and "normalized" in reference.columns:
        return M.first_rows(reference, VALUE_KEY, [PRESET_VALUE], k)
    raw = [*KEYS, PRESET_VALUE]
    rows = M.first_rows(reference.select("row_id", *raw), raw, [], k).select(*raw, F.col("rows.row_id").alias("ids"))
    if rules is not None:  # few bytes, much work
        rows = rows.repartition(compute_partitions(reference.sparkSession), *raw)
    spelled = normalized_reference(rows, rules).select(*raw, "normalized", F.explode("ids").alias("row_id"))
    return M.first_rows(spelled, VALUE_KEY, [PRESET_VALUE], k)


@dataclass(frozen=True)
class PreparedReference:
    """A reference with its reduced form: per key and value the first ``max_matches`` rows.

    ``values`` is a table bucketed by key and value, so the exact stage and every other join on them reads it where it
    lies, without a shuffle. Its files lie in the session's folder for intermediate tables. ``drop`` removes the table
    and them; the context manager does so at its end.
    """

    reference: DataFrame
    values: DataFrame
    max_matches: int
    rules: ValueRules | None
    table: str
    path: str

    def drop(self) -> None:
        spark = self.values.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete_folder(spark, self.path)

    def __enter__(self) -> PreparedReference:
        return self

    def __exit__(self, *error) -> None:
        self.drop()


def prepare_reference(
    reference: DataFrame, max_matches: int = 5, rules: ValueRules | None = None, table: str | None = None, buckets: int | None = None
) -> PreparedReference:
    """Reduce ``reference`` once; ``match_values`` and ``match_stream`` take the result in its place.

    A run may ask for up to ``max_matches`` matches, under the same ``rules``. ``buckets`` defaults to the number
    of partitions of compute-heavy steps. Null or repeated rows count as in a plain table; an empty table gives none.
    """
    spark = reference.sparkSession
    buckets = buckets or compute_partitions(spark)
    table = table or f"prepared_{uuid.uuid4().hex}"
    values = reduced_reference(reference, int(max_matches), rules)
    reference = normalized_reference(reference, rules)
    # rows come together by bucket before they are written, so a bucket is one file and stays sorted
    dealt = values.repartition(buckets, *VALUE_KEY)
    path = f"{stage_folder(spark)}/{table}"
    writer = dealt.write.format("parquet").option("path", path)
    writer.bucketBy(buckets, *VALUE_KEY).sortBy(*VALUE_KEY).saveAsTable(table)
    return PreparedReference(reference, spark.table(table), int(max_matches), rules, table, path)


def cut(prepared: PreparedReference, max_matches: int, rules: ValueRules | None) -> DataFrame:
    """The reduced values for a run of ``max_matches``, which may not ask for more than was kept."""
    if max_matches > prepared.max_matches:
        raise ValueError(f"prepared for {prepared.max_matches} matches at most, not {max_matches}")
    if rules != prepared.rules:
        raise ValueError("prepared under other rules")
    if max_matches == prepared.max_matches:
        return prepared.values
    return prepared.values.withColumn("rows", F.slice("rows", 1, max_matches))
