"""Values are spelled once per distinct raw value, scores are rounded once per answer."""

from pyspark.sql import functions as F

from attrlink.operators.terms import ValueRules
from attrlink.plans.cascade import match_values
from attrlink.plans.prepared import prepare_reference

KEY = ["a", "b", "c"]


def tables(spark, copies):
    values = ["10 mm bolt", "red ring", "blue gear", "old plate"]
    reference = [(i, *KEY, values[i % 4]) for i in range(copies)]
    inputs = [(i, *KEY, values[i % 4].upper() + " x") for i in range(copies)]
    key = "category string, sub_category string, attribute_name string"
    return spark.createDataFrame(inputs, f"input_id long, {key}, input_value string"), spark.createDataFrame(reference, f"row_id long, {key}, preset_value string")


def test_rules_run_once_per_distinct_value(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counted(ValueRules):
        def apply(self, value, attribute):
            def lower(text):
                seen.add(1)
                return text.lower()

            return F.udf(lower)(F.col(value))

    inputs, reference = tables(spark, 400)
    found = match_values(inputs, reference, max_matches=2, rules=Counted()).collect()
    assert len(found) == 800
    assert {(r.matched_value, r.preset_row_id) for r in found} >= {("10 mm bolt", 0), ("10 mm bolt", 4)}
    assert seen.value <= 40  # before: 1,200 and more, once per row and pass


def test_rounded_scores(spark):
    inputs, reference = tables(spark, 8)
    inputs = inputs.withColumn("input_value", F.regexp_replace("input_value", ". X$|. x$", "z"))
    exact = match_values(inputs, reference, max_matches=2).collect()
    rounded = match_values(inputs, reference, max_matches=2, digits=1).collect()
    want = sorted((r.input_id, r.match_rank, round(r.similarity, 1), r.preset_row_id) for r in exact)
    assert sorted((r.input_id, r.match_rank, r.similarity, r.preset_row_id) for r in rounded) == want
    assert any(r.similarity != round(r.similarity, 1) for r in exact)


def test_rows_matched_against_a_dropped_table(spark):
    inputs, reference = tables(spark, 8)
    with prepare_reference(reference, max_matches=2) as prepared:
        found = match_values(inputs, prepared, max_matches=2)
    assert prepared.table not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 16
