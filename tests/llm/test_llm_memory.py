"""Workers hold few texts at once and give memory back."""

import numpy as np
import pandas as pd
import pyarrow as pa

import corpus_pipeline
from attrlink.llm import jaccard, sentencepiece_fst
from attrlink.llm.common import pack, pack32


class _Session:
    """Stands in for the frame that ``encode`` reads: keeps the function that a task would run."""

    def __init__(self, spark):
        self.sparkSession, self.schema = spark, spark.range(0).withColumnRenamed("id", "doc_id").schema

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_ids_leave_in_small_batches(spark):
    with open(sentencepiece_fst.default_model(), "rb") as file:
        data = file.read()
    texts = [f"the text {i}" for i in range(1_300)]
    run = sentencepiece_fst.encode(_Session(spark), data, ["doc_id"]).run
    out = list(run([pa.RecordBatch.from_pydict({"doc_id": range(1_300), "__text": texts})]))
    assert max(b.num_rows for b in out) <= 512 and len(out) == 3  # before: one batch with the ids of all texts
    model = sentencepiece_fst.Model(data)
    assert [x for b in out for x in b.column("ids").to_pylist()] == [model.encode(t) for t in texts]


def test_pipeline_leaves_no_solved_chunks_in_its_workers(spark):
    run_of = _Session(spark)
    corpus_pipeline.encode(spark, run_of, "")
    with open(sentencepiece_fst.default_model(), "rb") as file:
        data = file.read()
    texts = [f"word{i * 7919} of{i}" for i in range(3_000)]
    out = list(run_of.run([pa.RecordBatch.from_pydict({"doc_id": range(3_000), "__text": texts})]))
    model = sentencepiece_fst.compile_model(data)
    assert not model.solved and not model.older and not model.fits.cache_info().currsize  # before: all of them stayed
    plain = sentencepiece_fst.Model(data)
    assert [x for b in out for x in b.column("ids").to_pylist()] == [plain.encode(t) for t in texts]
    assert plain.solved and plain.fits.cache_info().currsize


def test_answers_name_the_smallest_set_of_each_shingle():
    def row(batch, grams, points, sizes, rest, members):
        grams = np.array(grams, dtype=np.uint64)
        at = pack32(np.arange(len(grams)))
        return (batch, 0, pack(grams), np.array(points, np.int64).tobytes(), pack32(np.array(sizes)), at, pack32(np.array(rest)), pack32(np.array(members)))

    rows = [row("a", [1, 5, 9], [70, 71, 72], [4, 9, 3], [2, 8, 1], [1, 2, 1]), row("b", [5, 9], [60, 72], [9, 3], [3, 2], [1, 1])]
    frame = pd.DataFrame(rows, columns=["batch", "part", "grams", "points", "sizes", "at", "places", "members"])
    found = jaccard._answers(frame)
    # 1 is alone, 5 is in two sets (equal sizes: the smaller digest), 9 is in one set that both batches hold
    assert [np.unpackbits(np.frombuffer(x, np.uint8), count=n).tolist() for x, n in zip(found["shared"], found["count"], strict=True)] == [[0, 1, 0], [1, 0]]
    assert [np.frombuffer(x, np.int64).tolist() for x in found["pivots"]] == [[60], [60]]
    assert [jaccard.unpack32(x).tolist() for x in found["most"]] == [[8], [8]]
