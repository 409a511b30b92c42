"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

toxicity        documents with a score of TOXIC_FROM or more go
jaccard_join    of each group of near copies (connected by links) the smallest doc_id stays
decontamination documents with benchmark phrases in at least a twentieth of their words go
secret_scan     secrets inside texts are replaced by a mark; all documents stay
sentencepiece   doc_id and the token ids of what is left
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attrlink.llm import decontam, jaccard, secret_scan, sentencepiece_fst, toxicity  # noqa: E402
from attrlink.llm.common import small, table  # noqa: E402
from attrlink.llm.queries import TOXIC_FROM, learns_toxicity  # noqa: E402
from attrlink.session import stage  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), learns_toxicity())
    return toxicity.keep_below(docs, toxicity.fit(rows), TOXIC_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words are linked with nothing, so all of them stay."""
    classes = stage(jaccard.classify(docs), "pipeline-classes")
    wordy = classes.where("n_shingles > 0")
    # ids sort before missing ids
    first = wordy.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "rid")).alias("first"))
    stay = first.select(F.col("first.rid").alias("__rid")).union(classes.where("n_shingles = 0").select("rid").distinct())
    kept = docs.withColumn("__rid", jaccard.row_id()).join(small(stage(stay, "pipeline-kept")), "__rid", "left_semi")
    if not wordy.groupBy("rid").count().where("count > 1").isEmpty():  # rows repeated as a whole: one of them
        empty = classes.where("n_shingles = 0").select(F.col("rid").alias("__rid"), F.lit(True).alias("__empty")).distinct()
        marked = kept.join(small(empty), "__rid", "left")
        kept = marked.where("__empty is null").dropDuplicates(["__rid"]).unionByName(marked.where("__empty"))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontam.judge(docs, table(spark, sf_dir, "benchmark"))
    bad = stage(judged.where("contaminated").select(F.col("row").alias("__row")).distinct(), "pipeline-contaminated")
    return docs.withColumn("__row", decontam.row_id()).join(small(bad), "__row", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(sentencepiece_fst.default_model(), "rb") as file:
        return sentencepiece_fst.encode(docs, file.read(), ["doc_id"], forget=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]
#: Learnt scores, components and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
