import random

import fixtures as X
import naive
import numpy as np
import pytest
from attrlink import ValueRules, display_columns, hashed_trigrams, match_values
from attrlink.functions import kernels
from attrlink.operators import blocks
from attrlink.schema import RESULT_HEADERS, RESULT_SCHEMA


def found(df):
    rows = df.orderBy("input_id", "match_rank").collect()
    return [(r.input_id, r.match_rank, r.preset_row_id, r.similarity, r.match_type) for r in rows]


def shape(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def assert_same(got, want):
    want = sorted(want, key=lambda r: r[:2])
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_demonstration(spark):
    df = match_values(X.inputs(spark), X.presets(spark), 75.0, 3)
    assert shape(df.schema) == shape(RESULT_SCHEMA)
    rows = df.orderBy("input_id").collect()
    assert len(rows) == 13
    assert [r.status for r in rows].count("Exact Match") == 9
    similar = {r.original_input: (r.matched_value, round(r.similarity, 3), r.match_type, r.comment) for r in rows if r.status == "Similar Match"}
    assert similar == {
        "1 a": ("1A", 80.0, "ratio", "similar 80% | overall similarity"),
        "24 V": ("24V", 85.714, "ratio", "similar 86% | overall similarity"),
        "10 A": ("10A", 85.714, "ratio", "similar 86% | overall similarity"),
        "10k ohm": ("10kΩ", 85.714, "partial_ratio", "similar 86% | partial match"),
    }
    assert sum(r.similarity for r in rows) / 13 == pytest.approx(95.165, abs=0.001)
    assert_same(found(df), naive.cascade(X.INPUTS, X.PRESETS, 75.0, 3))
    assert display_columns(df).columns == list(RESULT_HEADERS.values())


def test_empty_and_blank(spark):
    df = match_values(X.inputs(spark, []), X.presets(spark))
    assert shape(df.schema) == shape(RESULT_SCHEMA) and df.count() == 0
    blank = X.inputs(spark, [(1, "a", "b", "c", "   "), (2, "a", "b", "c", None)])
    assert match_values(blank, X.presets(spark), emit_unmatched=True).count() == 0


def test_exact_takes_first_row_and_ignores_symbols(spark):
    key = ("a", "b", "c")
    presets = X.presets(spark, [(9, *key, "±5%"), (4, *key, "5"), (7, *key, " 5 ")])
    rows = match_values(X.inputs(spark, [(1, *key, "5!")]), presets).collect()
    assert [(r.preset_row_id, r.comment) for r in rows] == [(4, "Exact match found")]


def test_cross_key_shows_the_reference_key(spark):
    presets = X.presets(spark, [(1, "A", "B", "C", "small ring")])
    inputs = X.inputs(spark, [(5, "x", "y", "z", "ring small"), (6, "x", "y", "z", "qqqq")])
    rows = match_values(inputs, presets, emit_unmatched=True).orderBy("input_id").collect()
    assert (rows[0].category, rows[0].sub_category, rows[0].attribute_name) == ("A", "B", "C")
    assert rows[0].comment == "Cross-category match: token_sort_ratio"
    assert (rows[1].status, rows[1].category, rows[1].similarity) == ("Not Found", "x", None)


def test_text_matches_text_at_55(spark):
    key = ("a", "b", "c")
    rows = match_values(X.inputs(spark, [(1, *key, "zzz")]), X.presets(spark, [(1, *key, "plastic")]), 55.0).collect()
    assert [(r.similarity, r.match_type, r.comment) for r in rows] == [(55.0, "pattern", "similar 55% | pattern match")]


def random_tables(seed, n_in, n_ref, hot=0.4):
    rng = random.Random(seed)
    words = ["red", "Ring", "small", "24V", "12 V", "kg", "1.5", "bolt", "steel", "M8"]
    keys = [("k%d" % rng.randrange(4), "s", "a") for _ in range(12)]

    def row(i):
        key = ("hot", "s", "a") if rng.random() < hot else rng.choice(keys)
        value = rng.choice([" ", ", ", "-"]).join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        return (i, *key, value)

    return [row(i) for i in range(n_in)], [row(i) for i in range(n_ref)]


@pytest.mark.parametrize("threshold,k", [(75.0, 5), (55.0, 2), (90.0, 1)])
def test_cascade_equals_plain_code(spark, threshold, k):
    inputs, presets = random_tables(1, 60, 150)
    df = match_values(X.inputs(spark, inputs), X.presets(spark, presets), threshold, k)
    assert_same(found(df), naive.cascade(inputs, presets, threshold, k))


def test_small_blocks_change_nothing(spark, monkeypatch):
    """A key far larger than a block is cut on both sides; results stay whole."""
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 5)
    monkeypatch.setattr(blocks, "PRESET_BLOCK", 7)
    inputs, presets = random_tables(2, 80, 160, hot=0.7)
    df = match_values(X.inputs(spark, inputs), X.presets(spark, presets), 75.0, 3)
    assert_same(found(df), naive.cascade(inputs, presets, 75.0, 3))


def test_partitions_change_nothing(spark):
    inputs, presets = random_tables(3, 40, 80)
    one = found(match_values(X.inputs(spark, inputs).repartition(1), X.presets(spark, presets).repartition(1)))
    many = found(match_values(X.inputs(spark, inputs).repartition(7), X.presets(spark, presets).repartition(5)))
    assert one == many


def test_one_value_with_a_third_of_all_rows(spark):
    key = ("a", "b", "c")
    presets = [(i, *key, "small ring" if i % 3 == 0 else f"bolt {i}") for i in range(300)]
    inputs = [(i, *key, "small rings" if i % 3 == 0 else f"nut {i}") for i in range(90)]
    df = match_values(X.inputs(spark, inputs), X.presets(spark, presets), 75.0, 4)
    assert_same(found(df), naive.cascade(inputs, presets, 75.0, 4))


def test_values_longer_than_a_word(spark):
    key = ("a", "b", "c")
    text = "stainless steel hexagon head bolt with washer and nut, grade eight, zinc plated"
    presets = [(0, *key, text), (1, *key, "bolt"), (2, *key, text[:64])]
    inputs = [(0, *key, text.replace("zinc", "tin")), (1, *key, text[3:67]), (2, *key, "bolts")]
    df = match_values(X.inputs(spark, inputs), X.presets(spark, presets), 75.0, 3)
    assert_same(found(df), naive.cascade(inputs, presets, 75.0, 3))


def test_full_profile_adds_edit_measures(spark):
    key = ("a", "b", "c")
    rows = match_values(X.inputs(spark, [(1, *key, "24 V")]), X.presets(spark, [(1, *key, "24V")]), profile="full").collect()
    assert (rows[0].match_type, rows[0].comment) == ("jaro_winkler", "similar 93%")
    low = match_values(X.inputs(spark, [(1, *key, "zzz")]), X.presets(spark, [(1, *key, "plastic")]), 50.0, profile="full")
    assert low.count() == 0


def test_semantic_stage(spark):
    presets = X.presets(spark, [(1, "A", "B", "C", "thermocouple probe sensor"), (2, "A", "B", "C", "bolt")])
    inputs = X.inputs(spark, [(5, "x", "y", "z", "probes thermocouples")])
    kept = match_values(inputs, presets, 90.0, cross_key=False)
    assert kept.count() == 0
    rows = match_values(inputs, presets, 60.0, cross_key=False, encoder=hashed_trigrams).collect()
    assert [(r.preset_row_id, r.match_type, r.comment, r.category) for r in rows] == [
        (1, "semantic", "Semantic similarity match", "A")
    ]


def test_distinct_inputs(spark):
    key = ("a", "b", "c")
    inputs = X.inputs(spark, [(1, *key, "5"), (2, *key, "5")])
    presets = X.presets(spark, [(1, *key, "5")])
    assert match_values(inputs, presets).count() == 2
    assert match_values(inputs, presets, distinct_inputs=True).count() == 1


def test_rules(spark):
    key = ("a", "b", "Weight")
    presets = X.presets(spark, [(1, *key, "44.09 lb"), (2, *key, "max power"), (3, "a", "b", "Speed", "1500 MHz")])
    inputs = X.inputs(spark, [(1, *key, "20 kg"), (2, *key, "Maximum watts"), (3, "a", "b", "Speed", "1.5GHz")])
    plain = match_values(inputs, presets, cross_key=False)
    assert plain.filter("status = 'Exact Match'").count() == 0
    rules = ValueRules(handle_units=True, handle_synonyms=True, handle_abbreviations=True)
    rows = match_values(inputs, presets, cross_key=False, rules=rules).orderBy("input_id").collect()
    assert [(r.input_id, r.preset_row_id, r.match_type) for r in rows] == [(i, i, "exact") for i in (1, 2, 3)]
    loose = ValueRules(remove_punctuation=True)
    one = match_values(X.inputs(spark, [(1, *key, "a, b")]), X.presets(spark, [(1, *key, "A B.")]), rules=loose)
    assert one.first().status == "Exact Match"
    strict = ValueRules(normalize_case=False)
    two = match_values(X.inputs(spark, [(1, *key, "ab")]), X.presets(spark, [(1, *key, "AB")]), rules=strict)
    assert [(r.similarity, r.match_type) for r in two.collect()] == [(90.0, "pattern")]
    with pytest.raises(ValueError):
        match_values(X.inputs(spark), X.presets(spark), profile="profiled", rules=strict)


@pytest.mark.parametrize("threshold", [40, 55, 75, 90, 95])
@pytest.mark.parametrize("full", [False, True])
def test_block_search_loses_nothing(threshold, full):
    """Mixed case, punctuation and numbers: the block search against all pairs."""
    rng = random.Random(threshold)
    make = lambda: "".join(rng.choice(["ab", "AB", "a b", "1.5", "15", "2", ".", "-", "V", "mm", " "]) for _ in range(rng.randrange(1, 5)))
    queries, presets = sorted({make() for _ in range(60)}), sorted({make() for _ in range(80)})
    rank = np.arange(len(presets))
    q, p, score, kind = kernels.best_in_block(queries, presets, rank, float(threshold), len(presets), full)
    f = kernels.Features(queries + presets)
    i, j = np.repeat(np.arange(len(queries)), len(presets)), np.tile(np.arange(len(presets)), len(queries))
    best = np.max(kernels.score_pairs(f, i, len(queries) + j, full), axis=0)
    want = {(int(a), int(b)) for a, b, s in zip(i, j, best) if s >= threshold}
    assert set(zip(map(int, q), map(int, p))) == want


def test_unknown_profile(spark):
    with pytest.raises(ValueError):
        match_values(X.inputs(spark), X.presets(spark), profile="other")
