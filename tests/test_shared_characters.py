"""Bounds from shared characters: never below a score, and tight where all values look alike."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attrlink.functions import kernels as K

WORDS = st.text(alphabet="ab1 .\t", max_size=9)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=6), st.lists(WORDS, min_size=1, max_size=6), st.sampled_from([0.0, 55.0, 75.0, 90.0]))
def test_no_window_beats_its_bound(queries, presets, low):
    f, shared = K.Features(queries + presets), K.SharedCharacters(queries, presets)
    q, p = np.arange(len(queries)), np.arange(len(presets))
    common = shared.common(q, p)
    best, narrow = shared.windows(q, p, common, np.full(len(q), low))
    i, j = (x.ravel() for x in np.meshgrid(q, p, indexing="ij"))
    ratio, partial = K.score_pairs(f, i, len(q) + j)[:2]
    wanted = (np.maximum(ratio, partial) >= low) & (f.size[i] > 0) & (f.size[len(q) + j] > 0)
    assert (np.maximum(ratio, partial)[wanted] <= best[i, j][wanted]).all()
    assert (common[i, j] >= np.rint(ratio * (f.size[i] + f.size[len(q) + j]) / 200) - 1e-6)[wanted].all()
    assert (narrow <= best).all()


def test_few_account_numbers_are_scored(monkeypatch):
    """Numbers of one length under one name differ in digits only: most pairs have to go without a score."""
    numbers = np.random.default_rng(3).choice(900_000, 1_500, replace=False)
    presets = [f"customer#{x:09d}" for x in numbers]
    queries = [f"cust. {x:09d}" for x in numbers[:60]] + [f"customer {x:09d}" for x in numbers[60:120]]
    scored, plain = [], K.score_pairs
    monkeypatch.setattr(K, "score_pairs", lambda f, i, *rest: scored.append(len(i)) or plain(f, i, *rest))
    rank = np.arange(len(presets))
    found = {tuple(x) for x in zip(*(c.tolist() for c in K.best_in_block(queries, presets, rank, 75.0, 3)), strict=True)}
    assert sum(scored) < 0.25 * len(queries) * len(presets)  # without these bounds: 0.79
    f = K.Features(queries + presets)
    i, j = (x.ravel() for x in np.indices((len(queries), len(presets))))
    scores = plain(f, i, len(queries) + j)
    best, kind = scores.max(axis=0), scores.argmax(axis=0)
    kept = np.flatnonzero(best >= 75)
    kept = kept[K.keep_best(i[kept], j[kept], best[kept], kind[kept], rank, 3)]
    assert found == set(zip(i[kept].tolist(), j[kept].tolist(), best[kept].tolist(), kind[kept].tolist(), strict=True))
