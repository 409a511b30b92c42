import random

import naive
import numpy as np
import pytest
from attrlink.functions import kernels as K
from attrlink.functions import similarity as S
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

# Pairs with ratio, partial, token sort, token set, Jaro-Winkler, Levenshtein.
KNOWN = [
    ("eao 02", "eao, 02", 92.3, 83.3, 92.3, 92.3, 96.7, 85.7),
    ("24 v", "24v", 85.7, 80.0, 85.7, 85.7, 93.3, 75.0),
    ("24 volts", "24v", 54.5, 80.0, 54.5, 54.5, 83.3, 37.5),
    ("1 a", "2a", 40.0, 66.7, 40.0, 40.0, 0.0, 33.3),
    ("10k ohm", "1kω", 40.0, 66.7, 40.0, 40.0, 65.1, 28.6),
    ("orange, red", "red, orange", 54.5, 70.6, 90.9, 90.9, 69.7, 9.1),
    ("172.72mm", "6.80 (172.72mm)", 69.6, 100.0, 69.6, 69.6, 76.1, 53.3),
    ("20 kg", "44.09 lb", 30.8, 40.0, 30.8, 30.8, 55.0, 25.0),
    ("1.5ghz", "1500 mhz", 57.1, 50.0, 57.1, 57.1, 75.0, 37.5),
    ("24v", "12v", 66.7, 80.0, 66.7, 66.7, 55.6, 33.3),
]
WORDS = ["red", "ring", "24v", "12", "kg", "1.5", "a", "x,y", "(b)", "-40c", "ω"]
TEXTS = st.one_of(
    st.lists(st.sampled_from(WORDS), max_size=4).map(" ".join),
    st.text("ab1. ", max_size=12),
    st.text("abcω 12.", min_size=58, max_size=70),
)


def all_scores(a, b, full=False):
    f = K.Features([a, b])
    return K.score_pairs(f, np.array([0]), np.array([1]), full)[:, 0]


@pytest.mark.parametrize("a,b,m1,m2,m3,m4,m5,m6", KNOWN)
def test_known_pairs(a, b, m1, m2, m3, m4, m5, m6):
    assert np.round(all_scores(a, b, True)[:6], 1) == pytest.approx([m1, m2, m3, m4, m5, m6], abs=0.051)


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_scores_follow_definitions(a, b):
    got = dict(zip(K.SCORES, all_scores(a, b)))
    for name, value in naive.scores(a, b).items():
        assert got[name] == pytest.approx(value, abs=1e-9), (name, a, b)


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS)
def test_symmetry_and_bounds(a, b):
    one, two = all_scores(a, b, True), all_scores(b, a, True)
    assert one[[0, 1, 2, 3]] == pytest.approx(two[[0, 1, 2, 3]])
    assert (one >= 0).all() and (one <= 100 + 1e-9).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=2, max_size=12), st.sampled_from([50.0, 70.0, 72.0, 75.0, 90.0]), st.booleans())
def test_bounds_lose_no_pair(values, threshold, full):
    f = K.Features(values)
    i, j = (x.ravel() for x in np.meshgrid(*[np.arange(len(values))] * 2))
    best = K.score_pairs(f, i, j, full).max(axis=0)
    kept = K.candidates(f, i, j, threshold, full)
    differ = f.same[i] != f.same[j]
    assert not (differ & (best >= threshold) & ~kept).any()


@settings(max_examples=60, deadline=None)
@given(
    st.lists(TEXTS, min_size=1, max_size=8, unique=True),
    st.lists(TEXTS, min_size=1, max_size=25, unique=True),
    st.sampled_from([55.0, 75.0, 85.0]), st.integers(1, 4), st.booleans(), st.sampled_from([4, 64]),
)
def test_block_search_is_exact(queries, presets, threshold, k, full, tile):
    rank = np.arange(len(presets))[::-1].copy()
    got = {tuple(x) for x in zip(*(c.tolist() for c in K.best_in_block(queries, presets, rank, threshold, k, full, tile)))}
    f = K.Features(queries + presets)
    want = set()
    for q in range(len(queries)):
        i, j = np.full(len(presets), q), len(queries) + np.arange(len(presets))
        scores = K.score_pairs(f, i, j, full)
        best, kind = scores.max(axis=0), scores.argmax(axis=0)
        hits = sorted((-best[p], rank[p], p) for p in range(len(presets)) if best[p] >= threshold)
        want |= {(q, p, -s, int(kind[p])) for s, _, p in hits[:k]}
    assert got == want


def test_long_values_beside_short_ones():
    rng = random.Random(5)
    values = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 3, 18, 19, 30, 40, 2)]
    f = K.Features(values)
    assert f.token_id.shape[1] <= K.WORD // 2
    for i in range(len(values)):
        for j in range(len(values)):
            got = dict(zip(K.SCORES, K.score_pairs(f, np.array([i]), np.array([j]))[:, 0]))
            for name, value in naive.scores(values[i], values[j]).items():
                assert got[name] == pytest.approx(value, abs=1e-9), (name, values[i], values[j])


def test_pair_columns(spark):
    rng = random.Random(3)
    rows = [(rng.choice(WORDS) + " " + rng.choice(WORDS), rng.choice(WORDS)) for _ in range(60)]
    rows += [("", ""), ("", "a"), ("a" * 80, "a" * 70 + "b")]
    df = spark.createDataFrame(rows, "a string, b string")
    native = df.select("a", "b", S.pattern_score("a", "b").alias("p"), S.levenshtein_score("a", "b").alias("l"))
    native = {(r.a, r.b): (r.p, r.l) for r in native.collect()}
    full = S.score_pairs(df, "a", "b", full=True).collect()
    plain = S.score_pairs(df, "a", "b").collect()
    assert len(full) == len(plain) == len(rows)
    for r in full:
        assert r.scores.levenshtein == pytest.approx(native[r.a, r.b][1])
    for r in plain:
        want = naive.scores(r.a, r.b)
        assert r.score == pytest.approx(max(want.values())), r
        assert r.match_type == max(want, key=want.get), r
        assert r.scores.pattern == native[r.a, r.b][0]
        assert r.scores.jaro_winkler == 0 and r.scores.levenshtein == 0


def test_weighted_score(spark):
    df = spark.createDataFrame([("24 v", "24v")], "a string, b string")
    scored = S.score_pairs(df, "a", "b", full=True)
    only = scored.select(S.weighted_score(F.col("scores"), {"ratio": 2.0, "partial_ratio": 1.0})).first()[0]
    assert only == pytest.approx((2 * 600 / 7 + 80.0) / 3)


def test_long_turns_against_plain_code(spark):
    import naive as N
    from attrlink.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn): r.text.lower() for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    rows = QUERIES["score_conversation_turns"](spark, folder).collect()
    assert len(rows) > 20
    for r in rows[:6]:
        a, b = turns[r.conv_id, r.turn], turns[r.conv_id, r.turn + 1]
        assert r.pattern == N.pattern(a, b)
        assert r.levenshtein == pytest.approx((1 - K.long_levenshtein(a, b) / max(len(a), len(b))) * 100, abs=1e-5)
