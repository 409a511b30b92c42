import re

import fixtures as X
import pytest
from attrlink.functions import text as T
from attrlink.operators import clean as C
from attrlink.schema import MissingColumns
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from naive import normalize
from pyspark.sql import functions as F

NBSP = " "
CASES = {
    "±5%": "5",
    "-40°C to +85°C": "-40c to 85c",
    "10kΩ": "10kω",
    "100µF": "100µf",
    "x²½": "x²½",
    "a % b": "a  b",
    "é": "e",
    f"{NBSP}hi{NBSP}": "hi",
    "5/8": "58",
    "": "",
    "% 5": " 5",
}


def test_normalize_examples(spark):
    df = spark.createDataFrame([(v,) for v in CASES] + [(None,)], "v string")
    got = {r.v: r.n for r in df.select("v", T.normalize("v").alias("n")).collect()}
    assert got == {**CASES, None: ""}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aZ5 \t  \u0085\x1c_-.,()%°±ΩÉñ²½/́漢", max_size=14), min_size=30, max_size=60))
def test_normalize_and_flags_follow_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    rows = df.select(
        "v", T.normalize("v").alias("n"), T.has_units("v").alias("u"), T.has_numbers("v").alias("d"),
        T.has_commas("v").alias("c"), T.strip("v").alias("s"),
    ).collect()
    units = [r"\d+\s*(mm|cm|m|in|inch|ft|kg|g|lb|oz|v|a|w|hz|°c|°f)", r"\d+\s*[a-z]{1,3}(?=\s|$|,|\))"]
    for r in rows:
        assert r.n == normalize(r.v)
        assert r.s == r.v.strip()
        assert r.u == any(re.search(p, r.v.lower()) for p in units)
        assert r.d == bool(re.search(r"\d", r.v)) and r.c == ("," in r.v)


def test_clean_order(spark):
    rows = [
        (0, None, None, None, None),
        (1, "", None, "", "orphan"),
        (2, " ", "", "", "kept once"),
        (3, " A ", None, "x", None),
    ]
    df = spark.createDataFrame(rows, X.PRESET_DDL)
    once = C.clean_reference(df)
    assert {tuple(r) for r in once.collect()} == {(2, "", "", "", "kept once"), (3, "A", "", "x", "")}
    assert [r.row_id for r in C.clean_reference(once).collect()] == [3]


def test_headers_and_missing(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], ["Category", "Sub-Category", "Attribute Name", "Preset values"])
    assert C.clean_reference(df).columns == ["category", "sub_category", "attribute_name", "preset_value"]
    with pytest.raises(MissingColumns) as error:
        C.clean_reference(df.drop("Sub-Category"))
    assert error.value.missing == ["sub_category"]
    assert C.has_structure(X.presets(spark)) and not C.has_structure(X.presets(spark), "input")


def test_input_aliases_and_positions(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], ["Structure", "Full Structure", "Attribute Name", "Attribute value"])
    want = ("a", "b", "c", "d")
    assert tuple(C.clean_inputs(df).first()) == want
    assert tuple(C.clean_inputs(df.toDF("w", "x", "y", "z")).first()) == want
    three = df.toDF("w", "x", "y", "z").drop("z")
    assert tuple(C.clean_inputs(three).first()) == ("a", "b", "c", "")
    assert tuple(C.clean_inputs(three, compat_positional=True).first()) == ("a", "b", "c", "a")
    with pytest.raises(MissingColumns):
        C.clean_inputs(df.toDF("w", "x", "y", "z").select("w", "x"))


def test_validation(spark):
    ok = C.validate_inputs(X.inputs(spark)).first()
    assert tuple(ok) == (True, "Data validation passed")
    holes = X.inputs(spark, [(1, None, "b", "", "v"), (2, "a", "b", "c", None)])
    assert tuple(C.validate_inputs(holes).first()) == (False, "Found 1 rows with empty values in key columns")
    lost = C.validate_inputs(X.inputs(spark).drop("category")).first()
    assert tuple(lost) == (False, "Missing required columns: ['category']")


def test_computed_columns_are_kept(spark):
    df = X.presets(spark).withColumn("normalized", F.lit("mine"))
    done = C.add_computed_columns(df)
    assert {r.normalized for r in done.collect()} == {"mine"}
    assert done.filter("row_id = 0").first().composite_key == "Switches|Push Button|Brand"


def test_display(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "v string")
    assert [r.v for r in C.clean_for_display(df, 3).collect()] == ["abc...", "abc", None]
    shown = spark.range(1).select(T.percent(F.lit(85.714)).alias("a"), T.percent(F.lit(62.25)).alias("b")).first()
    assert tuple(shown) == ("85.7%", "62.2%")
