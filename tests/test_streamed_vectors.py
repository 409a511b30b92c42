"""Packed blocks read where they lie give the nearest vectors, and no vector is shuffled for a meeting."""

import numpy as np
import pytest

from attrlink.operators import matching as M
from attrlink.operators import pruning as P


@pytest.mark.parametrize("threshold", [float("-inf"), 40.0])
def test_streamed_vectors_against_numpy(spark, monkeypatch, threshold):
    monkeypatch.setattr(P, "PACKED", (70, 30))
    monkeypatch.setattr(P, "FEW_PAIRS", 0)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[400:] = x[5]  # a hot vector
    rows = spark.createDataFrame([(f"v{i}", i, [float(c) for c in v]) for i, v in enumerate(x)], "id string, rank long, vector array<double>")
    hits = M.nearest_vectors(rows.selectExpr("id AS asked", "vector"), rows, "asked", "id", 4, threshold)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    got = {}
    for r in hits.collect():
        assert r.id == f"v{r['rank']}"
        got.setdefault(r.asked, []).append((-r.score, r["rank"]))
    score = np.round(x @ x.T * 100.0, 6)
    for i in range(500):
        best = np.lexsort((np.arange(500), -score[i]))[:4]
        assert [r for _, r in sorted(got.get(f"v{i}", []))[:4]] == [j for j in best if score[i, j] >= threshold]
