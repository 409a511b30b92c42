"""Native pair scores against the kernels and against plain code, values of any length."""

import random

import numpy as np
import pytest

from attrlink.functions import kernels
from attrlink.functions import native_scores as N


def pairs(seed):
    rng = random.Random(seed)
    text = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    rows = [("", ""), ("", "a"), ("a", "a"), ("  ", "b"), ("orange red", "red orange"), ("24 v", "24v"), ("a b c", "a b c d"),
            ("x" * 62, "x" * 63), ("ab" * 70, "ba" * 66), ("𝔘 ü", "𝔘ü"), ("a a a", "a"), ("martha", "marhta"), ("abcd", "abcde")]
    for _ in range(140):
        alphabet = rng.choice(["ab ", "abc 12", "abcdefgh  "])
        rows.append((text(rng.randrange(0, 14), alphabet), text(rng.randrange(0, 14), alphabet)))
    for _ in range(12):
        rows.append((text(rng.randrange(55, 150), "abcd "), text(rng.randrange(55, 150), "abcd ")))
    return rows


@pytest.mark.parametrize("name", sorted(N.NATIVE))
def test_same_as_the_kernels(spark, name):
    rows = pairs(5)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    scored = df.select("i", N.NATIVE[name]("a", "b").alias("score"))
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    got = [r.score for r in scored.orderBy("i").collect()]
    f = kernels.Features([v for r in rows for v in r])
    at = np.arange(len(rows)) * 2
    want = kernels.score_pairs(f, at, at + 1, True)[kernels.SCORES.index(name)]
    assert got == pytest.approx(want.tolist(), abs=1e-9)


def test_nulls_score_nothing(spark):
    row = spark.createDataFrame([(None, "a")], "a string, b string").select(*(f("a", "b").alias(n) for n, f in N.NATIVE.items())).first()
    assert all(v is None or v == 0.0 for v in row)


def test_subsequences_of_many_words(spark):
    a, b = "ab" * 100 + "c", "ba" * 90 + "cc"
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    got = rows.select(N.common_characters(N.characters(rows.a), N.characters(rows.b)).alias("n")).first().n
    table = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, table[j] = table[j], before + 1 if x == y else max(table[j], table[j - 1])
    assert got == table[-1]
