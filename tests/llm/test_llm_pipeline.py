"""The pipeline's stages against what they must keep and drop."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

import corpus_pipeline  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    secret = "password=abcdef123456"
    phrase = " ".join(f"q{i}" for i in range(30))
    rows = [*cases.noisy(8, 60), (500, "good words " + secret), (501, phrase), (502, phrase + " more"), (503, None), (504, ""), (505, "same same same same same same"), (505, "same same same same same same")]
    docs = cases.documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, phrase)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "decontamination", "secret_scan", "sentencepiece"]
    at = {}
    now = docs
    for name, function in corpus_pipeline.STAGES:
        now = function(spark, now, str(tmp_path))
        at[name] = now = spark.createDataFrame(now.collect(), now.schema)
        if name != "sentencepiece":
            assert now.columns == docs.columns
    assert at["toxicity"].count() == len(rows)  # no toxic label, nothing is known to be toxic
    parts = cases.components(rows)
    kept = sorted(r.doc_id for r in at["jaccard_join"].collect())
    want = sorted({c for n, c in parts if n} | {rows[i][0] for i, (n, _) in enumerate(parts) if not n})
    assert kept == want
    assert sorted(r.doc_id for r in at["decontamination"].collect()) == [i for i in want if i not in (501, 502)]
    masked = {r.doc_id: r.text for r in at["secret_scan"].collect()}
    assert secret not in masked[500] and masked[500].startswith("good words [secret]")
    last = at["sentencepiece"].collect()
    assert all(r.exact for r in last) and len(last) == len(masked)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    total = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert 0 < out.count() <= total and out.where("not exact").count() == 0
