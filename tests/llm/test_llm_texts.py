"""Scoring, decontamination, near copies, secrets, sharding: brute force on small tables."""

import collections
import math
import os
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

from attrlink.llm import decontam, jaccard, lm, secret_scan, sharding  # noqa: E402


def empty(spark):
    return cases.documents(spark, [(1, "x")]).where("doc_id = 0")


def ngram_counts(rows, order=3):
    counts = collections.Counter()
    for text in rows:
        seq = [*cases.white_words(text), ()]
        for k in range(1, order + 1):
            counts.update(tuple(seq[i : i + k]) for i in range(len(seq) - k + 1))
    return counts


def test_language_model(spark):
    rows = cases.hard_rows() + [(100 + i, t) for i, t in cases.noisy(1, 30)]
    held = {r[0]: r[0] is None or r[0] % 3 == 0 for r in rows}
    got = lm.score(cases.documents(spark, rows), F.col("doc_id") % 3 == 0).collect()
    counts = ngram_counts([t for i, t in rows if not held[i]])
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(1 for g in counts if len(g) == 1)
    want = []
    for i, t in rows:
        state, score, base, known = (), 0.0, 0.0, 0
        seq = [*cases.white_words(t), ()]
        for w in seq:
            state, weight = lm.step(state, w, counts, n, v, 3)
            score += weight
            c = counts.get((w,), 0)
            base += math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            known += c > 0
        want.append((i, held[i], len(seq), known, n, round(base, 6), round(score, 6)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    assert sorted(want, key=key) == sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=key)


def test_automaton_arcs_sum_to_one():
    counts = ngram_counts(["a b a b c", "a b d"])
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(1 for g in counts if len(g) == 1)
    words = [g[0] for g in counts if len(g) == 1] + ["unseen"]
    for state in [(), ("a",), ("a", "b"), ("b", "a")]:
        assert sum(10 ** lm.step(state, w, counts, n, v, 3)[1] for w in words) == pytest.approx(1)


def test_language_model_on_nothing(spark):
    assert lm.score(empty(spark), F.lit(False)).count() == 0
    alone = lm.score(cases.documents(spark, [(1, "a b")]), F.lit(True)).first()
    assert alone.train_tokens == 0 and alone.score == alone.base_score


@pytest.mark.parametrize("seed", [2, 3])
def test_near_copies(spark, seed):
    rows = cases.noisy(seed, 120) + ([(900 + (r[0] or 0) if r[0] is not None else None, r[1]) for r in cases.hard_rows()] if seed == 2 else [])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classify(cases.documents(spark, rows)).collect()]
    want = [(rows[i][0], n, c) for i, (n, c) in enumerate(cases.components(rows))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_near_copies_in_large_regions(spark):
    text = [f"x{i}" for i in range(80)]
    rows = [(i, " ".join([*text[: 70 - i % 9], f"y{i}", f"z{i}"] + ["tail"] * (i % 4))) for i in range(60)]
    docs = cases.documents(spark, rows)
    found, _ = jaccard.describe(docs)
    frame = [(r.point, r.n) for r in found.select("point", "n").distinct().collect()]
    pivot = min(frame, key=lambda x: (x[1], x[0]))[0]
    region = spark.createDataFrame([(pivot, p, n, n, 1) for p, n in frame], "pivot long, point long, n long, pivot_n long, shared long")
    small = jaccard.inner_regions(docs, found, region, limit=10**9).collect()
    large = jaccard.inner_regions(docs, found, region, limit=700).collect()
    assert groups(small) == groups(large)
    whole = jaccard.nearest_pivots(docs, found, region.where(f"point != {pivot}"), limit=10**9).collect()
    parts = jaccard.nearest_pivots(docs, found, region.where(f"point != {pivot}"), limit=700).collect()
    assert sorted(whole) == sorted(parts) and whole


def groups(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in links:
        parent[root(r.a)] = root(r.b)
    out = collections.defaultdict(set)
    for x in list(parent):
        out[root(x)].add(x)
    return sorted(map(sorted, out.values()))


def test_near_copies_of_nothing(spark):
    assert jaccard.classify(empty(spark)).count() == 0


def test_decontamination(spark):
    phrase = " ".join(f"q{i}" for i in range(20))
    items = [(1, phrase), (2, "Short phrase here"), (3, None), (4, ""), (5, "solo"), (6, phrase.upper()), (2, "Short phrase here")]
    rows = [
        (1, "intro " + phrase + " outro"), (2, " ".join(phrase.split()[:13])), (3, " ".join(phrase.split()[:12])), (4, None), (5, ""),
        (6, "a short, phrase: HERE and solo " * 3), (7, phrase + " " + phrase), (8, "clean words only"), (9, cases.LONG + " " + phrase),
        (1, "intro " + phrase + " outro"), (None, "solo"), (10, phrase.replace("q7", "q8")),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.judge(cases.documents(spark, rows), bench).collect()]
    want = []
    for i, t in rows:
        n, hit, found = cases.occurrences(t, items)
        want.append((i, n, hit, found, hit > 0 and 20 * hit >= n))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert decontam.judge(cases.documents(spark, rows), bench.where("item_id = 0")).where("contaminated").count() == 0
    assert decontam.judge(empty(spark), bench).count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = cases.documents(spark, [(1, "blue x red y green"), (2, "red a b c d e f green blue"), (3, "green red"), (4, None)])
    got = {(r.item, r.doc_id, r.start) for r in decontam.near(docs, bench, slop=2).collect()}
    assert got == {("1", 1, 0)}


def spans(text, rules=secret_scan.RULES):
    found = []
    for k, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.A):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


SECRETS = [
    (1, 'password = "abcdef123" and AKIA' + "A" * 16), (2, None), (3, ""), (4, "é🙂 TOKEN: zzzzzz " + "0123456789abcdef" * 2),
    (5, "secret=token: abcdefgh"), (6, "api-key=1234567 apikey=1234567 Api_Key:12345"), (7, "x" * 200_000 + " passwd=hunter22"),
    (8, "-----BEGIN RSA PRIVATE KEY----- eyJabcdefgh1.abcdefgh2.abcdefgh3"), (1, 'password = "abcdef123" and AKIA' + "A" * 16),
    (9, "AKIA" + "B" * 15), (None, "token=abcdef"), (10, "deadbeef" * 3), (11, "password=token=abcdef0123456789abcdef01234567"),
]


def test_secrets(spark):
    docs = cases.documents(spark, SECRETS).withColumn("mask", F.lit(7)).withColumn("rid", F.lit(8))
    got = [(r.doc_id, r.mask, r.rid, sorted((s["start"], s["kind"], s["end"]) for s in r.secrets)) for r in secret_scan.scan(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, 7, 8, spans(t))) for i, t in SECRETS)
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[1] == "[secret] and [secret]".replace("[secret] and", '[secret]" and')
    assert clean[2] is None and clean[3] == "" and clean[9] == "AKIA" + "B" * 15
    assert secret_scan.scan(empty(spark)).count() == 0


def test_trigram_queries_hold_for_matches():
    def true(query, text):
        if query == ("true",):
            return True
        if query[0] == "has":
            return query[1] in text
        return (all if query[0] == "all" else any)(true(x, text) for x in query[1:])

    for rule in secret_scan.RULES:
        query = secret_scan.trigram_query(rule.pattern)
        assert (query == ("true",)) == (rule.kind == "hex")
        for _, t in SECRETS:
            for m in re.finditer(rule.pattern, t or "", re.A):
                assert true(query, m.group(0).lower())


def test_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(800)] + [(5000, "same")] * 300 + [(None, None), (9000, "é" * 2000)]
    docs = cases.documents(spark, rows).withColumn("keys", F.lit(1)).withColumn("node", F.lit(2))
    got = sharding.shard(docs, leaves=6).collect()
    assert len(got) == len(rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) < 4100
    texts = {i: t for i, t in rows}
    assert all(r.text_crc32 == (zlib.crc32(texts[r.doc_id].encode()) if texts[r.doc_id] is not None else None) for r in got)
    assert sharding.shard(empty(spark), leaves=4).count() == 0
    assert sharding.shard(docs, target_bytes=10**9).select("shard").distinct().count() == 1
