"""Blocks searched by prefix trees give what looking at all pairs gives, and look at few."""

import random

import numpy as np
import pytest

from attrlink.functions import kernels as K
from attrlink.functions import trees


def accounts(n_presets, n_queries, seed=1):
    rng = random.Random(seed)
    ids = rng.sample(range(50 * n_presets), n_presets)
    presets = [f"customer{i:09d}" for i in ids]
    queries = [rng.choice(["customer {:09d}", "cust. {:09d}"]).format(i) for i in rng.choices(ids, k=n_queries)]
    return queries, presets, np.array(ids)


def mixed(seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab ", "0123456789", "ab-.,01 ", "thein orsab12", "aAéß 中1."])
    text = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(rng.choice([5, 12, 20, 70]))))
    presets = sorted({f"{rng.choice(['', 'item ', 'x'])}{rng.randrange(10 ** rng.randrange(1, 6))}{text()}" for _ in range(150)} | {"", " ", text()})
    changed = ["".join(c for c in rng.choice(presets) if rng.random() > 0.1) for _ in range(30)]
    queries = sorted({*changed, *(p[rng.randrange(4) :] for p in rng.choices(presets, k=20)), text(), "", "  "})
    return queries, presets, np.array(rng.sample(range(10**6), len(presets)))


def plain(queries, presets, rank, threshold, k):
    found = K._best_by_bounds(queries, presets, rank, np.full(len(queries), threshold), k, False, 1 << 17)
    return {tuple(x) for x in zip(*(c.tolist() for c in found), strict=True)}


def by_trees(queries, presets, rank, threshold, k):
    return {tuple(x) for x in zip(*(c.tolist() for c in K.best_in_block(queries, presets, rank, threshold, k)), strict=True)}


@pytest.mark.parametrize("seed", range(12))
def test_trees_lose_no_hit(monkeypatch, seed):
    monkeypatch.setattr(K, "TREES_FROM", 10)
    monkeypatch.setattr(K, "TREE_SHARE", 1e6)  # never give up
    tables = mixed(seed) if seed % 4 else accounts(300, 60, seed)
    for threshold, k in ((75.0, 3), (58.0, 1), (88.0, 5)):
        assert by_trees(*tables, threshold, k) == plain(*tables, threshold, k)


@pytest.mark.parametrize("share", [1e-9, 0.05])
def test_queries_that_trees_give_up_are_compared_pair_by_pair(monkeypatch, share):
    monkeypatch.setattr(K, "TREES_FROM", 10)
    monkeypatch.setattr(K, "TREE_SHARE", share)
    monkeypatch.setattr(K, "PART", (16, 64))
    monkeypatch.setattr(trees, "QUERIES", 8)
    for seed in range(4):
        tables = accounts(200, 40, seed) if seed % 2 else mixed(seed)
        assert by_trees(*tables, 75.0, 3) == plain(*tables, 75.0, 3)


def test_few_pairs_of_a_large_key_are_looked_at(monkeypatch):
    """What is bounded or scored grows far less than the pairs; before, every pair was bounded."""
    looked = []

    def counted(name):
        of = getattr(K, name)

        def count(f, i, j, *rest, **named):
            looked.append(np.broadcast(i, j).size)
            return of(f, i, j, *rest, **named)

        monkeypatch.setattr(K, name, count)

    counted("ceilings")
    counted("score_pairs")
    shares = []
    for n in (2_000, 8_000):
        looked.clear()
        queries, presets, rank = accounts(n, 200)
        found = K.best_in_block(queries, presets, rank, 75.0, 3)
        assert set(range(200)) == set(found[0].tolist())
        shares.append(sum(looked) / (200 * n))
    assert shares[1] < 0.02 and shares[1] < shares[0]
