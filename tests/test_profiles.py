import re

import fixtures as X
import numpy as np
import pytest
from attrlink import match_values
from attrlink.functions import kernels as K
from attrlink.operators import clean as C
from attrlink.operators import profiles as P
from pyspark.sql import functions as F

KEY = ("a", "b", "c")


def profile_of(spark, values):
    rows = X.presets(spark, [(i, *KEY, v) for i, v in enumerate(values)])
    return P.profile_keys(rows).first()


def test_profile(spark):
    p = profile_of(spark, ["5 mm", "2.50kV", "3. x", "Red, Blue; 7", "a - b to c"])
    assert p.common_units == ["kV", "mm"]
    assert p.unit_combinations == ["kV", "mm"]
    assert p.decimal_places == [0, 2]
    assert p.separators == [",", ";", " - ", " to "]
    assert (p.min_value, p.max_value) == (2.5, 7.0)
    assert p.typical_format == "mixed" and p.case_sensitivity is True
    assert p.multipliers["m"] == 1 and p.multipliers["k"] == 1 and p.multipliers["t"] == 1
    none = profile_of(spark, ["-", "+"])
    assert none.min_value is None and none.case_sensitivity is False and none.common_units == []


def test_case_patterns_follow_python(spark):
    values = ["ABC", "abc", "Abc Def", "aBc", "A1b", "Don't", "123", "É", "éa Ba", "X-Ray", "iPhone 7"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", P.case_pattern("v").alias("c")).collect():
        tests = [(r.v.isupper(), "all_uppercase"), (r.v.islower(), "all_lowercase"), (r.v.istitle(), "title_case")]
        assert r.c == next((n for ok, n in tests if ok), "mixed_case"), r


@pytest.mark.parametrize(
    "values,want",
    [
        (["5V", "7 or 8mm"], "number_unit"),
        (["EAO, 02", "IDEC, 6"], "text_number"),
        (["5", "6.5"], "number_only"),
        (["red", "blue"], "text_only"),
        (["red", "5"], "mixed"),
        (["5V"] * 10 + ["red"], "mixed"),
    ],
)
def test_typical_format(spark, values, want):
    assert profile_of(spark, values).typical_format == want


def test_case_sensitivity_is_closure(spark):
    assert profile_of(spark, ["a", "A"]).case_sensitivity is False
    assert profile_of(spark, ["ab", "AB", "aB"]).case_sensitivity is False
    assert profile_of(spark, ["Ab"]).case_sensitivity is True


def test_multiplier_joining_equals_letter_by_letter(spark):
    values = ["5 k  ohm", "5 m V6 k", "1 u", "2.5 M  °C", "7 x k m", "3 m m m", "k 5", "5 g t"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", P.normalize_multipliers("v").alias("n")).collect():
        want = r.v
        for m in P.MULTIPLIERS:
            want = re.sub(rf"(\d+\.?\d*)\s*{m}\s*([a-zA-Z°]+)", rf"\g<1>{m}\g<2>", want)
            want = re.sub(rf"(\d+\.?\d*)\s*{m}(?![a-zA-Z°])", rf"\g<1>{m}", want)
        assert r.n == want


def test_value_parts_and_equivalence(spark):
    row = spark.range(1).select(
        P.value_parts(F.lit("5 metal x 2.5kV")).alias("p"),
        P.numbers_equivalent(F.array(F.lit(1.0)), F.array(F.lit(1.0005))).alias("near"),
        P.numbers_equivalent(F.array(F.lit(1.0)), F.array(F.lit(1.1))).alias("far"),
        P.numbers_equivalent(F.array(F.lit(1.0)), F.array().cast("array<double>")).alias("short"),
    ).first()
    assert row.p.numbers == [5.0, 2.5] and row.p.multipliers == ["m", "k"] and row.p.units == ["etal", "V"]
    assert (row.near, row.far, row.short) == (True, False, False)


def test_format_to_pattern(spark):
    cases = [
        ("24 v", "number_unit", "24V"), ("24", "number_unit", "24"), ("EAO 02", "text_number", "EAO, 02"),
        ("02", "text_number", "02"), ("5 kg", "number_only", "5"), ("red", "number_only", "red"),
        ("5 kg", "text_only", "5 kg"),
    ]
    df = spark.createDataFrame(cases, "v string, f string, want string")
    for r in df.withColumn("got", P.format_to_pattern("v", "f")).collect():
        assert r.got == r.want, r


def naive_profiled(a, b, sensitive):
    """Format scores by their definitions, with at least one number on both sides for the second."""
    same = a == b if sensitive else a.lower() == b.lower()
    runs = [set(re.findall(r"[a-zA-Z°]+", v)) for v in (a, b)]
    scaled = [len(re.findall(r"(\d+\.?\d*)\s*([mknupfMKNUPFGTgt])", v)) for v in (a, b)]
    parts = [re.findall(r"(\d+\.?\d*)\s*([mknupfMKNUPFGTgt]?)\s*([a-zA-Z°]*)", v) for v in (a, b)]
    nums = [[float(p[0]) for p in x] for x in parts]
    pattern = 30 * same + 25 * (runs[0] == runs[1]) + 20 * (scaled[0] == scaled[1]) + 15 * (len(nums[0]) == len(nums[1]))
    if not nums[0] or not nums[1]:
        return pattern, 0
    close = len(nums[0]) == len(nums[1]) and all(abs(x - y) <= 0.001 for x, y in zip(*nums))
    unit = 40 * ([p[1] for p in parts[0]] == [p[1] for p in parts[1]])
    unit += 30 * ([p[2] for p in parts[0]] == [p[2] for p in parts[1]]) + 30 * close
    return pattern, unit


@pytest.mark.parametrize("sensitive", [True, False])
def test_format_scores(sensitive):
    values = ["5 mm", "5mm", "5.0004 mm", "7 MM", "red", "Red", "2k x 3m", "2k x 4m", "10 °C", "", "5", "5 mm " * 20, "5.0002 mm " * 20]
    parts = K.Parts(values, sensitive)
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            at = np.array([i]), np.array([j])
            assert (parts.pattern(*at)[0], parts.multiplier_unit(*at)[0]) == naive_profiled(a, b, sensitive), (a, b)


def test_profiled_cascade(spark):
    rows = match_values(X.inputs(spark), X.presets(spark), 75.0, 3, profile="profiled").orderBy("input_id").collect()
    by_input = {r.original_input: r for r in rows}
    assert by_input["24 V"].comment == 'Exact match found (formatted from "24 V" to "24V")'
    assert by_input["1 a"].preset_row_id == 2 and by_input["1 a"].match_type == "exact"
    assert by_input["EAO, 02"].comment == "Exact match found"
    assert by_input["plastic"].comment.startswith("similar 92% | case difference")


def test_profiled_search_is_exact():
    rng = np.random.default_rng(4)
    pool = ["5 mm", "7mm", "12 kV", "12 V", "red bolt", "Red Bolt", "2.5k", "2.5 k", "M8 x 20", "M8x25", "°C 5"]
    queries = [str(v) for v in rng.choice(pool, 6)]
    presets = [str(v) + s for v in pool for s in ("", " a")]
    smart = lambda vs: [re.sub(r"\s+", " ", v) for v in vs]
    rank = np.arange(len(presets))
    for threshold in (60.0, 80.0, 95.0):
        got = K.best_profiled_in_block(queries, smart(queries), presets, smart(presets), rank, True, threshold, 3, tile=16)
        got = {(q, p): (round(s, 9), int(kind)) for q, p, s, kind in zip(*(c.tolist() for c in got))}
        f = K.Features(smart(queries) + smart(presets))
        for q, raw in enumerate(queries):
            best = []
            for p, value in enumerate(presets):
                base = K.score_pairs(f, np.array([q]), np.array([len(queries) + p]))[:4, 0]
                all_ = [*base, *naive_profiled(raw, value, True)]
                best.append((-max(all_), p, int(np.argmax(all_))))
            want = sorted(b for b in best if -b[0] >= threshold)[:3]
            assert {k: v for k, v in got.items() if k[0] == q} == {(q, p): (round(-s, 9), kind) for s, p, kind in want}


def test_items_of_a_key_are_counted_and_bounded(spark):
    """A child table of all units, the most used first; the profile lists as many as asked for."""
    rows = [(i, "a", "b", "c", f"{i} u{'x' * (i % 7)}") for i in range(1, 50)] + [(99, "a", "b", "d", "no number")]
    df = spark.createDataFrame(rows, "row_id long, category string, sub_category string, attribute_name string, preset_value string")
    items = [(r["item"], r.uses, r.place) for r in P.key_items(df).where("kind = 'unit'").orderBy("place").collect()]
    want = sorted((("u" + "x" * k, 7) for k in range(7)), key=lambda x: (-x[1], x[0]))
    assert items == [(u, n, p + 1) for p, (u, n) in enumerate(want)]
    few = {r.attribute_name: r.common_units for r in P.profile_keys(df, most=2).collect()}
    assert few == {"c": ["u", "ux"], "d": []}


def test_key_index_numbers_rows_across_partitions(spark):
    rows = [(i, "a", None if i % 3 else "b", "c", f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, category string, sub_category string, attribute_name string, preset_value string")
    got = P.key_index(C.add_computed_columns(df)).collect()
    for sub in (None, "b"):
        ids = [r.row_id for r in sorted((r for r in got if r.sub_category == sub), key=lambda r: r.place)]
        assert ids == [r[0] for r in rows if r[2] == sub]
        assert sorted(r.place for r in got if r.sub_category == sub) == list(range(1, len(ids) + 1))
