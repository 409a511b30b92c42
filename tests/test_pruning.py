"""Ordered blocks met best first give what all blocks give, and meet fewer."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attrlink.functions import envelopes, kernels
from attrlink.operators import matching as M
from attrlink.operators import pruning as P

TEXT = st.text(alphabet="ab 1.2Ωü-", max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.lists(TEXT, min_size=1, max_size=5), st.booleans())
def test_text_bounds_hold_for_every_pair(left, right, full):
    bound = envelopes.text_bounds([envelopes.of_texts(left)], [envelopes.of_texts(right)], full)[0, 0]
    f = kernels.Features(left + right)
    i, j = np.meshgrid(np.arange(len(left)), len(left) + np.arange(len(right)), indexing="ij")
    assert kernels.score_pairs(f, i.ravel(), j.ravel(), full).max() <= bound


def test_vector_bounds_hold_for_every_pair():
    rng = np.random.default_rng(2)
    for scale in (0.01, 1.0, 100.0):
        a, b = rng.normal(size=(7, 5)) * scale, rng.normal(size=(9, 5)) + 3
        bound = envelopes.vector_bounds([envelopes.of_vectors(a)], [envelopes.of_vectors(b)])[0, 0]
        assert (a @ b.T).max() * 100 <= bound


def words(seed, n, alphabet):
    rng = np.random.default_rng(seed)
    return sorted({"".join(rng.choice(list(alphabet), size=rng.integers(3, 14))) for _ in range(n)})


def best(found, k):
    """Per query the k best (score, rank)."""
    out = {}
    for query, rank, score in found:
        out.setdefault(query, []).append((-round(score, 9), rank))
    return {q: sorted(hits)[:k] for q, hits in out.items()}


@pytest.mark.parametrize("threshold, k, full", [(75.0, 3, False), (60.0, 2, False), (85.0, 1, True)])
def test_texts_against_one_block(spark, threshold, k, full):
    ours = words(1, 120, "abcdefg ") + words(2, 60, "0123456789.") + ["", "x" * 70]
    theirs = words(3, 150, "abcdefg ") + words(4, 60, "0123456789.") + words(5, 100, "qrstuvwxyz") + ["x" * 71, "a"]
    queries = spark.createDataFrame([(w,) for w in sorted(set(ours))], "normalized string")
    presets = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(set(theirs)))], "value string, rank long")
    search = M.fuzzy_search(threshold, k, full)
    found = P.pruned_hits(queries, presets, "normalized", "value", ["value", "rank"], search, P.text_arrangement(full), k, threshold, size=16)
    got = best([(r.normalized, r["rank"], r.score) for r in found.hits.collect()], k)
    q, p = sorted(set(ours)), sorted(set(theirs))
    qi, pi, score, _ = kernels.best_in_block(q, p, np.arange(len(p)), threshold, k, full)
    assert got == best([(q[a], b, s) for a, b, s in zip(qi, pi, score, strict=True)], k)
    met = found.met.collect()
    assert len(set(met)) == len(met) < found.pairs


def test_clustered_vectors_meet_few_blocks(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(12, 16))
    x = np.repeat(centers, 80, axis=0) + 0.02 * rng.normal(size=(960, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[900:] = x[5]  # a hot vector
    rows = spark.createDataFrame([(i, i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, rank long, vector array<double>")
    queries = rows.selectExpr("id AS asked", "vector")
    k = 4
    found = P.pruned_hits(queries, rows, "asked", "id", ["id", "rank"], M.vector_search(k, float("-inf")), P.vector_arrangement(rows, 20), k, float("-inf"), size=40)
    got = best([(r.asked, r["rank"], r.score) for r in found.hits.collect()], k)
    score = np.round(x @ x.T * 100.0, 6)
    order = np.lexsort((np.broadcast_to(np.arange(960), score.shape), -score), axis=1)[:, :k]
    assert {q: [r for _, r in hits] for q, hits in got.items()} == {i: order[i].tolist() for i in range(960)}
    assert found.met.count() < found.pairs / 2


def test_nothing_on_one_side(spark):
    none = spark.createDataFrame([], "value string, rank long")
    queries = spark.createDataFrame([("a",)], "normalized string")
    for q, p in ((queries, none), (queries.limit(0), none)):
        found = P.pruned_hits(q, p, "normalized", "value", ["value", "rank"], M.fuzzy_search(75.0, 1, False), P.text_arrangement(), 1, 75.0)
        assert found.hits.collect() == [] and found.pairs == 0
