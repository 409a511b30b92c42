"""Ids beyond 2**53 beside nulls, empty and tiny tables, texts with thousands of matches."""

import hashlib

import pytest
from llm_cases import documents

from attrlink.llm import chat, secret_scan, sentencepiece_fst, toxicity, urlrules

BIG = 2**53 + 1


@pytest.mark.parametrize("rows", [0, 1, 2, 3])
def test_urls_where_ranges_have_rules_only(spark, rows):
    urls = [(BIG, "http://a.net/x"), (None, None), (BIG + 1, "https://Example.com/de/1")][:rows]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rules = spark.createDataFrame(urlrules.RULES, "verdict string, host string, path string")
    got = [tuple(r) for r in urlrules.judge(pages, rules).collect()]
    want = [
        (BIG, "a.net", "/x", "net/", "block"), (None, "", "", None, "allow"),
        (BIG + 1, "example.com", "/de/1", "example.com/de/", "block"),
    ][:rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_large_ids_in_one_partition(spark):
    rows = [(BIG - 1, 0, "user", "a"), (BIG, 0, "user", "b"), (None, 0, "user", "c"), (BIG, 1, "assistant", "d")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: r.n_turns for r in chat.digests(talks).collect()}
    assert got == {BIG - 1: 1, BIG: 2, None: 1}
    assert {r.conv_id for r in chat.render(talks).collect()} == {BIG - 1, BIG, None}
    docs = documents(spark, [(BIG, "x y"), (None, "z"), (BIG - 1, None)]).coalesce(1)
    scored = toxicity.score(docs, toxicity.ToxicModel(), ["doc_id", "lang"]).collect()
    assert [(r.doc_id, r.lang, r.n_words) for r in scored] == [(BIG, "en", 2), (None, "en", 1), (BIG - 1, "en", 0)]


def test_words_of_a_repeated_passage_prove_nothing(spark):
    """Entries between the same neighbours count about once, those between many as often as there are texts."""
    rows = [(f"w{i} bad{i % 2} v{i}", 1) for i in range(30)] + [(f"u{i} same passage here", 1) for i in range(30)]
    rows += [(f"clean{i} text", 0) for i in range(60)]
    got = {bytes(r["word"]): r for r in toxicity._counts(spark.createDataFrame(rows, "text string, toxic int")).select(
        "word", "toxic", toxicity._places("toxic_bits").alias("places")).collect()}
    assert got[b"bad0"]["toxic"] == 15 and got[b"bad0"]["places"] >= 11
    assert got[b"passage"]["toxic"] == 30 and got[b"passage"]["places"] == 1
    assert got[b"\0bad0"]["places"] >= 11


def test_counts_follow_the_words_of_each_batch(spark):
    """One row for each distinct word and stem, however many texts hold it."""
    rows = [(" ".join(f"k{(i * j) % 7}" for j in range(20)), i % 2) for i in range(1, 400)]
    counts = toxicity._counts(spark.createDataFrame(rows, "text string, toxic int").coalesce(1))
    assert counts.count() == 14


def test_one_text_with_thousands_of_secrets(spark):
    keys = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(20_000)]
    docs = documents(spark, [(1, " é ".join(keys)), (2, None), (3, keys[0] + keys[1])])
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert [(s.start, s.end) for s in got[1].secrets] == [(i * 67, i * 67 + 64) for i in range(20_000)]
    assert got[2].secrets == [] and [(s.start, s.end) for s in got[3].secrets] == [(0, 128)]
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean == {1: " é ".join(["[secret]"] * 20_000), 2: None, 3: "[secret]"}


def test_texts_with_the_meta_symbol_are_not_exact():
    with open(sentencepiece_fst.default_model(), "rb") as file:
        model = sentencepiece_fst.compile_model(file.read())
    for text, exact in (("a b", True), ("a▁b", False), ("", True), (None, True)):
        ids, same = model.encode_exact(text)
        assert same == exact and (model.decode(ids) == (text or "")) == exact
