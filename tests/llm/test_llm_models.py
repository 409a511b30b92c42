"""Toxicity, SentencePiece, chat templates, URL rules, nearest neighbours and the pipeline."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

from attrlink.llm import ann, chat, sentencepiece_fst, toxicity, urlrules  # noqa: E402

CLASH = {"score": 1, "ids": 2, "part": 3, "key": 4}


def extra(df):
    """Columns that clash with names that operators use themselves."""
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


# toxicity ---------------------------------------------------------------------------------------


def plain_segments(scores):
    """All maximal segments by recursion: the best one, then what is left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    left = plain_segments(scores[:a])
    right = [(s + b, e + b, v) for s, e, v in plain_segments(scores[b:])]
    return [*left, (a, b, best[0]), *right]


def test_segments_match_recursion():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 14)
        scores = [rng.choice([-1, -2, 3, 1, 5, -4]) for _ in range(n)]
        got = toxicity.segments(list(range(n)), scores, n, 1.0)
        assert sorted(round(v, 6) for _, _, v in got) == sorted(round(v, 6) for _, _, v in plain_segments(scores))


def toxic_rows():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("the of and river stone cloud tree house walk light".split()) for _ in range(40)]
        bad = i % 8 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(40)] = rng.choice(["vile", "scum", "rot"])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = extra(cases.documents(spark, rows + [(1000, None), (1001, ""), (1002, "scum " * 30_000), (None, "vile vile rot scum")]))
    marks = spark.createDataFrame(labels + [(5, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, marks, F.col("doc_id") % 3 != 1))
    got = toxicity.score(docs, model, ["doc_id", "lang"]).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in by.values())
    held = [i for i, _ in rows if i % 3 == 1]
    assert np.mean([(by[i] >= 0.7) == (i % 8 == 0) for i in held]) > 0.95
    assert by[1000] == by[1001] < 0.5 and by[1002] > 0.7 and by[None] > 0.7
    kept = toxicity.keep_below(docs, model, 0.7)
    assert kept.columns == docs.columns and kept.where("doc_id = 1000").count() == 1 and kept.where("doc_id = 1002").count() == 0


def test_toxicity_without_labels(spark):
    docs = cases.documents(spark, [(1, "scum"), (2, None)])
    marks = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(docs, marks, F.lit(True)))
    assert {r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(docs.where("doc_id = 0"), model, ["doc_id"]).count() == 0


# SentencePiece ----------------------------------------------------------------------------------


def model_bytes():
    with open(sentencepiece_fst.default_model(), "rb") as file:
        return file.read()


def test_pieces_equal_the_public_library():
    import sentencepiece

    public = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    mine = sentencepiece_fst.compile_model(model_bytes())
    rng = random.Random(1)
    alphabet = "  ▁ab thein\n\t🙂éñ中文αβ0123456789.,<>|hellowrd "
    texts = ["", " ", "   ", "Hello world", "<s></s><unk><0x0A>", "a" * 3000, "日本語のテキスト", "\x00\x7f"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        ids = mine.encode(text)
        assert ids == public.encode(text), text
        assert mine.decode(ids) == text.replace("▁", " ")


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze, fallback", [(True, True), (True, False), (False, False)])
def test_normalising_models_equal_the_public_library(rule, squeeze, fallback):
    import io

    import sentencepiece

    rng, file = random.Random(4), io.BytesIO()
    words = ["".join(rng.choice("theinorsab") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter([" ".join(words)] * 3), model_writer=file, model_type="bpe", vocab_size=400 if fallback else 140, byte_fallback=fallback,
        normalization_rule_name=rule, remove_extra_whitespaces=squeeze, hard_vocab_limit=False, minloglevel=2,
    )
    public, mine = sentencepiece.SentencePieceProcessor(model_proto=file.getvalue()), sentencepiece_fst.Model(file.getvalue())
    alphabet = " \t\n  ab theino \u3000\xa0éè\u0301ﬁ½①Ａｂ中文αβ한ㅎ.!?03▁🙂\u200b\xad\x01ﷺ"
    texts = ["", " ", "  ", "▁", " ▁ ", "a  b ", "e\u0301", "ﬁn", "ﷺ x", "a ﷺ"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for text in texts:
        ids, exact = mine.encode_exact(text)
        assert ids == public.encode(text), text
        assert mine.decode(ids) == public.decode(ids) and exact == (public.decode(ids) == text)


def test_exact_comes_from_decoding(spark):
    docs = cases.documents(spark, [(1, "same text"), (2, "other words"), (3, None)])
    data = model_bytes()
    model = sentencepiece_fst.Model(data)
    broken = model.encode("other words")[0]
    model.raw_of[broken] = b"x"  # a piece that decodes to something else
    assert [model.encode_exact(t)[1] for t in ("same text", "other words", None)] == [True, False, True]
    assert sentencepiece_fst.encode(docs, data, ["doc_id"]).where("exact").count() == 3


def test_unigram_path_is_the_cheapest():
    model = sentencepiece_fst.compile_model(model_bytes())
    rng = random.Random(2)

    def all_paths(text):
        if not text:
            yield 0.0
        for size in range(1, len(text) + 1):
            if text[:size] in model.ids:
                for rest in all_paths(text[size:]):
                    yield rest - model.score[model.ids[text[:size]]]

    for _ in range(50):
        text = "".join(rng.choice("thein") for _ in range(7))
        cost = sum(-model.score[model.ids[p]] for p in model.cheapest_path(text))
        assert cost == pytest.approx(min(all_paths(text)))


def test_encode_and_decode_rows(spark):
    rows = [*cases.hard_rows(), (20, "tab\there\r\n"), (21, "🙂" * 50)]
    docs = extra(cases.documents(spark, rows))
    data = model_bytes()
    out = sentencepiece_fst.encode(docs, data, ["doc_id", "text"])
    assert out.where("not exact").count() == 0
    back = sentencepiece_fst.decode(out.withColumnRenamed("text", "was"), data).collect()
    assert len(back) == len(rows) and all(r.text == (r.was or "") for r in back)
    assert sentencepiece_fst.encode(docs.where("doc_id = 0"), data, ["doc_id"]).count() == 0


# chat -------------------------------------------------------------------------------------------


def test_template_language():
    render = lambda t, m: "".join(p for p, _ in chat.compile_template(t)(m))
    assert render("a{{ 'b' + \"c\" }}{% if 'x' == 'y' %}no{% elif not ('x' != 'x') %}yes{% else %}no{% endif %}", []) == "abcyes"
    assert render("{% for m in messages %}{{ m.role | upper }}:{{ m.text | trim }};{% endfor %}", [("u", " t "), ("a", "")]) == "U:t;A:;"
    assert chat.fold(chat.parse("a{{ 'b' }}{% if 'x' == 'x' %}c{% endif %}")) == [("emit", ("text", "abc"))]
    masked = list(chat.compile_template(chat.TEMPLATE)([("assistant", "hi")]))
    assert "".join(p for p, m in masked if m) == "hi"
    for bad in ("{{ open }}", "{{ m.__class__ }}", "{% for x in y %}{% endfor %}", "{% if 'a' %}", "{{ 'a' | nothing }}", "{% while %}", "{{ f() }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_escape_round_trip():
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice("\\<|n\nim_end>é") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_conversations(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", control), (2, 1, "assistant", "later"), (2, 0, "system", None), (3, 0, None, "x"),
        (4, 0, "assistant", "long " * 50_000), (5, 0, "assistant", "é\n\\n"), (5, 0, "assistant", "é\n\\n"), (6, None, "user", ""),
    ] + [(7, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    table = extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(table).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1), r or "", x or "") for c, t, r, x in rows if c == conv)
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = {r.conv_id: r for r in chat.render(table).collect()}
    assert all(len(whole[c].formatted) == got[c].formatted_chars for c in got)
    assert chat.unescape(whole[1].formatted[whole[1].loss_spans[0]["start"] : whole[1].loss_spans[0]["end"]]) == control
    assert chat.digests(table.where("conv_id = 0")).count() == 0


# URL rules --------------------------------------------------------------------------------------


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = cases.lower(rest[:cut]), rest[cut:]
    end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return host, tail[:end]


def plain_judge(host, path, rules):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and h:
            key = (len(h) + len(p), len(h), verdict == "block")
            if best is None or key > best[0]:
                best = (key, h + p, verdict)
    return (best[1], best[2]) if best else (None, "allow")


URLS = [
    "http://a.example.net/en/1?x#y", "https://EXAMPLE.net/EN/", "http://example.com/de/", "http://notexample.com/de/x", "ftp://x.org/fr/a?b",
    "http://net/", "http://net", "http://net?/", "net/", None, "", "http://", "http://a.net:80/", "http://é.net/ü", "x://y://z.net/", "http://.net/", "http://example.net./",
]


def test_url_rules(spark):
    rng = random.Random(4)
    rules = [*urlrules.RULES, ("block", "a.b.com", "/"), ("allow", "b.com", "/x"), ("block", "com", "/x/y"), ("block", "b.com", "/x")]
    more = [f"http://{'.'.join(rng.choice(['a', 'b', 'c', 'com', 'net']) for _ in range(rng.randrange(1, 4)))}{rng.choice(['', '/', '/x', '/x/y', '?q'])}" for _ in range(300)]
    rows = list(enumerate(URLS + more)) + [(3, "http://hot.b.com/x")] * 500 + [(None, "http://b.com/x")]
    pages = extra(spark.createDataFrame(rows, "page_id long, url string"))
    got = urlrules.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    merged = [r for r in rules if r[1:] != ("b.com", "/x")] + [("block", "b.com", "/x")]
    want = []
    for i, url in rows:
        host, path = url_parts(url)
        want.append((i, host, path, *plain_judge(host, path, merged)))
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {(r.rule, r.verdict) for r in urlrules.judge(pages, none).collect()} == {(None, "allow")}
    assert urlrules.judge(pages.where("page_id = -5"), none).count() == 0


# nearest neighbours -----------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[100:400] = x[100]  # a vector with many copies
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    bad = [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] + [1.0] * 23, 0), (2003, [None] + [1.0] * 23, 0), (2004, [1.0], 0), (2020, [float("inf")] * 24, 0)]
    table = extra(spark.createDataFrame(rows + bad + rows[:50], "vec_id long, embedding array<double>, label int"))
    got = {}
    for r in ann.nearest(table, 20, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    found = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and q not in {h[1] for h in hits}
        score = x @ x[q]
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in hits)
        assert [(-round(s, 9), v) for _, v, s in hits] == sorted((-round(s, 9), v) for _, v, s in hits)
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(score[i], 9), i))[:20]
        found += len({h[1] for h in hits} & set(order))
    assert found / (20 * len(got)) >= 0.9


def test_nearest_of_few(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (20, [0.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table, 20, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert ann.nearest(table.where("vec_id < 0"), 20, 20).count() == 0


def test_nearest_learns_from_distinct_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(rng.standard_normal((300, 8)))]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    hot = plain.orderBy(F.xxhash64("embedding")).first()  # the first of the sample
    copies = spark.range(1000, 1300).select(F.col("id").alias("vec_id"), F.lit(hot.embedding).alias("embedding"), F.lit(0).alias("label"))
    fit, learnt = ann.fit, []
    monkeypatch.setattr(ann, "fit", lambda vectors, k: learnt.append(fit(vectors, k, rows=200)) or learnt[-1])
    for table in (plain, plain.unionByName(copies)):
        ann.nearest(table, 20, 5).count()
    once, often = learnt
    assert often.radius == once.radius and np.allclose(often.rotation, once.rotation)
