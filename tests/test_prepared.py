"""A reference that is reduced once, and staged tables that go away."""

import os

import fixtures as X
import pytest
from pyspark.sql import functions as F

from attrlink import match_values, prepare_reference
from attrlink.operators import matching as M
from attrlink.operators.terms import ValueRules
from attrlink.plans import prepared as R
from attrlink.session import stage, stage_folder, staged_tables_removed
from attrlink.streaming.files import match_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("profile", ["observed", "full", "profiled"])
def test_same_as_a_plain_table(spark, profile):
    want = rows(match_values(X.inputs(spark), X.presets(spark), max_matches=3, profile=profile))
    with prepare_reference(X.presets(spark), 5) as prepared:
        assert rows(match_values(X.inputs(spark), prepared, max_matches=3, profile=profile)) == want


def test_reduced_once_and_read_without_a_shuffle(spark, monkeypatch):
    reduced = []
    first = M.first_rows
    monkeypatch.setattr(R.M, "first_rows", lambda *a: reduced.append(a[1]) or first(*a))
    monkeypatch.setattr(M, "block_hits", M.block_hits)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with prepare_reference(X.presets(spark), 3, buckets=4) as prepared:
            for _ in range(2):
                match_values(X.inputs(spark), prepared, max_matches=3, cross_key=False).collect()
            assert reduced.count(R.VALUE_KEY) == 1
            asked = stage(X.inputs(spark).select(*R.KEYS, F.lower("input_value").alias("normalized")), "asked")
            joined = M.exact_in_key(asked, prepared.values)
            joined.collect()
            plan = joined._jdf.queryExecution().executedPlan().toString()
            final = plan.split("== Initial Plan ==")[0]
            assert final.count("Exchange hashpartitioning") == 1  # the inputs' side only
            assert "Bucketed: true" in final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_dropped_at_the_end(spark):
    with prepare_reference(X.presets(spark)) as prepared:
        assert spark.catalog.tableExists(prepared.table) and os.path.isdir(prepared.path)
    assert not spark.catalog.tableExists(prepared.table) and not os.path.exists(prepared.path)


def test_limits_of_a_prepared_table(spark):
    with prepare_reference(X.presets(spark), 2) as prepared:
        with pytest.raises(ValueError, match="2 matches"):
            match_values(X.inputs(spark), prepared, max_matches=3)
        with pytest.raises(ValueError, match="rules"):
            match_values(X.inputs(spark), prepared, max_matches=2, rules=ValueRules())
    none = X.presets(spark).limit(0)
    with prepare_reference(none) as prepared:
        assert match_values(X.inputs(spark), prepared).collect() == []


def test_staged_tables_go_away_after_a_failure_too(spark):
    before = set(os.listdir(stage_folder(spark)))
    with pytest.raises(RuntimeError), staged_tables_removed(spark) as made:
        assert stage(spark.range(3), "gone").count() == 3
        assert len(made) == 1
        raise RuntimeError
    assert set(os.listdir(stage_folder(spark))) == before


def test_stream_leaves_nothing_behind(spark, tmp_path):
    X.inputs(spark).repartition(2).write.parquet(f"{tmp_path}/in")
    with prepare_reference(X.presets(spark), 3) as prepared:
        before = set(os.listdir(stage_folder(spark)))
        stream = spark.readStream.schema(X.inputs(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run = match_stream(stream, prepared, f"{tmp_path}/out", f"{tmp_path}/state", max_matches=3)
        run.awaitTermination(180)
        assert run.exception() is None
        assert spark.read.parquet(f"{tmp_path}/out").count() == 13
        assert set(os.listdir(stage_folder(spark))) == before
