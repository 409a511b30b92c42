import fixtures as X
import pytest
from attrlink.operators import terms as U
from pyspark.sql import functions as F


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "value,attribute,want",
    [
        ("20 kg", "Weight", "weight=20000.0"),
        ("44.09 lb", "Weight", "weight=20000.0"),
        ("1.5GHz", "Speed", "frequency=1.5E9"),
        ("1500 MHz", "Speed", "frequency=1.5E9"),
        ("25 C", "Temperature", "temperature=25.0"),
        ("77°F", "Range", "temperature=25.0"),
        ("5 f", "Capacitance", ""),
        ("5µA", "Current", "current=5.0E-6"),
        ("2 cm x 1 in", "Size", "length=20.0 length=25.4"),
        ("plain", "Size", ""),
    ],
)
def test_units(spark, value, attribute, want):
    assert one(spark, U.unit_normalize(F.lit(value), F.lit(attribute))) == want


def test_synonyms_and_abbreviations(spark):
    assert one(spark, U.expand_synonyms(F.lit("24 Volts w"), F.lit("Max Power"))) == "24 voltage power"
    assert one(spark, U.expand_synonyms(F.lit("24 w"), F.lit("Panel Width"))) == "24 width"
    assert one(spark, U.expand_synonyms(F.lit("24 w"), F.lit("Other"))) == "24 w"
    assert one(spark, U.expand_abbreviations(F.lit("Max  PWR rating"))) == "maximum power rating"


def test_unit_matches(spark):
    key = ("a", "b", "Weight")
    inputs = X.inputs(spark, [(1, *key, "20 kg"), (2, *key, "0 kg"), (3, *key, "3 kg"), (4, "a", "b", "Temp", "-40 C")])
    presets = X.presets(spark, [(1, *key, "44.09 lb"), (2, *key, "20000 g"), (3, *key, "21 kg"), (4, *key, "0 lb"), (5, "a", "b", "Temp", "-40 F")])
    got = {(r.input_id, r.match_rank, r.preset_row_id) for r in U.unit_matches(inputs, presets).collect()}
    assert got == {(1, 1, 2), (1, 2, 1), (2, 1, 4), (4, 1, 5)}


def test_unit_bands_lose_nothing(spark):
    key = ("a", "b", "Length")
    values = [round(10 * 1.0004**i, 4) for i in range(150)]
    inputs = X.inputs(spark, [(i, *key, f"{v} mm") for i, v in enumerate(values)])
    presets = X.presets(spark, [(i, *key, f"{v / 10} cm") for i, v in enumerate(values)])
    got = {(r.input_id, r.preset_row_id) for r in U.unit_matches(inputs, presets, 0.001, k=20).collect()}
    parsed = [float(str(v / 10)) * 10.0 for v in values]
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(parsed) if abs(a - b) <= 0.001 * max(a, b)}
    assert got == want
