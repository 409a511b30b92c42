"""Hard negatives, substring deduplication and the Merkle manifest against brute force, with the hard cases."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from llm_cases import documents, hard_rows
from pyspark.sql import functions as F

from attrlink.llm import merkle, negatives, substrings

BIG = 2**53 + 1


def mined(rows, every, k=5, m=10):
    """All windows of all anchors by sorting everything."""
    fine = [(i, lab, [int(np.floor(256.0 * float(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, la, va in fine:
        if a % every:
            continue
        other = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, lab) for i, lab, v in fine if len(v) == len(va)]
        best = sorted((s, i) for s, i, lab in other if lab == la and i != a)[:k]
        for s, p in best:
            wanted = sorted((t, i) for t, i, lab in other if lab != la and 30 * -s <= 100 * -t <= 90 * -s)[:m]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(wanted)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, row string, anchor string").select(
        "vec_id", "label", "embedding", "row", "anchor"
    )


def random_vectors(seed, n, labels=3):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(labels)), [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(n)]
    return rows + [(i + n, 1, rows[7][2]) for i in range(n // 3)]  # one vector that a quarter of the rows share


def test_negatives_against_all_pairs(spark):
    rows = random_vectors(3, 300)
    rows += [(9001, None, [1.0] * 6), (9002, 1, None), (9003, 1, [None] * 6), (9004, 1, [float("nan")] * 6), (9005, 2, [float("inf")] * 6),
             (None, 1, [1.0] * 6), (9100, 1, [0.0] * 6), (BIG, 2, rows[5][2]), (BIG + 1, 2, rows[5][2]), (9200, 1, [1.0, 2.0]), (9301, 1, [1.0, 2.0]), (9302, 2, [0.5, 1.0])]
    got = negatives.mine(vectors(spark, [(*r, "x", "y") for r in rows]), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == mined(rows, 10)


def test_negatives_in_small_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("TILE_ROWS", 7), ("TILE_ANCHORS", 3)):
        monkeypatch.setattr(negatives, name, value)
    rows = random_vectors(4, 200, labels=2)
    got = negatives.mine(vectors(spark, [(*r, "x", "y") for r in rows]), F.col("vec_id") % 9 == 0).collect()
    assert sorted(tuple(r) for r in got) == mined(rows, 9)


def test_negatives_of_nothing(spark):
    empty = vectors(spark, [])
    assert negatives.mine(empty, F.col("vec_id") % 10 == 0).collect() == []
    alone = vectors(spark, [(10, 1, [1.0, 0.0], "", ""), (11, 2, [1.0, 0.0], "", "")])
    assert negatives.mine(alone, F.col("vec_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("size", [1.0, 300.0, 3e5])
def test_products_are_exact(size):
    rng = np.random.default_rng(1)
    a, b = (np.floor(rng.normal(size=(5, 8)) * size * 256) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert negatives._product(a, b).astype(np.int64).tolist() == want


def test_products_that_do_not_fit():
    with pytest.raises(ValueError):
        negatives._product(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**40))


def cleaned(rows, window=50):
    """(id, words, removed word places, kept text) by trying every window."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (doc, _), words in zip(rows, split, strict=True):
        if doc is not None:
            for s in range(len(words) - window + 1):
                key = tuple(words[s : s + window])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, _), words in zip(rows, split, strict=True):
        gone = set()
        for s in range(len(words) - window + 1):
            if doc is not None and least[tuple(words[s : s + window])] < doc:
                gone |= set(range(s, s + window))
        out.append((doc, len(words), sorted(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def got_cleaned(df, window=50):
    rows = substrings.deduplicate(df, window).collect()
    return sorted(((r.doc_id, r.n_words, [i for s in r.removed for i in range(s.start, s.end)], r.kept) for r in rows), key=repr)


def passages(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", f"w{rng.randrange(9)}", "Ä x"])
    shared = [[word() for _ in range(rng.randrange(50, 90))] for _ in range(4)]
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            text += rng.choice(shared) + [word() for _ in range(rng.randrange(0, 5))]
        rows.append((rng.randrange(-n, n) if i % 5 else BIG + i, rng.choice([" ", "\n", " \t "]).join(text)))
    return rows


def test_substrings_against_every_window(spark):
    rows = hard_rows() + passages(5, 80) + [(None, hard_rows()[0][1]), (70, "  " + hard_rows()[0][1] + " x" * 60)]
    df = documents(spark, rows).withColumn("batch", F.lit("q")).withColumn("segment", F.lit(1)).repartition(5)
    assert got_cleaned(df) == cleaned(rows)


@pytest.mark.parametrize("window", [1, 3, 8])
def test_substrings_of_other_lengths(spark, window):
    rows = passages(6, 30)
    assert got_cleaned(documents(spark, rows).repartition(3), window) == cleaned(rows, window)


def test_substrings_with_a_full_sketch_and_small_batches(spark, monkeypatch):
    """A sketch far too small lets everything through and changes nothing."""
    rows = passages(7, 60)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 700)
    want = cleaned(rows)
    assert got_cleaned(documents(spark, rows)) == want
    batches = substrings.word_batches(documents(spark, rows), 50)
    few = 64
    seen = substrings.merge(substrings.sketches(batches, 50, 3, few), few)
    below = substrings.group(substrings.candidates(batches, seen, 50, 3, few))
    assert below.count() > 0


def test_substrings_of_nothing(spark):
    assert substrings.deduplicate(documents(spark, [])).collect() == []
    assert got_cleaned(documents(spark, [(None, None), (1, "")])) == cleaned([(None, None), (1, "")])


def test_one_text_repeats_itself(spark):
    """A window that occurs twice in one document only stays."""
    text = " ".join(f"r{i % 60}" for i in range(400))
    rows = [(1, text), (3, "x " + text), (3, "y " + text)]
    assert got_cleaned(documents(spark, rows)) == cleaned(rows)


def leaf(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha256("".join(part(v) for v in row).encode()).hexdigest()


def rise(level, index=None):
    """Layers of a tree over digests; the siblings on the way of ``index``."""
    layers, beside = [level], []
    while len(level) > 1:
        if index is not None:
            start = index // 8 * 8
            beside.append((level[start:index], level[index + 1 : start + 8]))
            index //= 8
        level = [sha256("".join(level[i : i + 8]).encode()).hexdigest() for i in range(0, len(level), 8)]
        layers.append(level)
    return layers, beside


def manifests(rows):
    """Everything by building the whole tree anew for each tampered leaf."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: [leaf(r) for r in groups[g]] for g in order}
    subs = [rise(trees[g])[0][-1][0] for g in order]
    root = rise(subs)[0][-1][0]
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            beside = rise(trees[g], i)[1] + rise(subs, k)[1]
            proof = sha256("".join("".join(a + b) for a, b in beside).encode()).hexdigest()
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            new = leaf((*r[:4], None if r[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))) if hit else leaf(r)
            changed = rise([new if j == i else d for j, d in enumerate(trees[g])])[0]
            top = rise([changed[-1][0] if j == k else s for j, s in enumerate(subs)])[0]
            path = [changed[n][i // 8**n] for n in range(1, len(changed))] + [top[n][k // 8**n] for n in range(1, len(top))] if hit else None
            out.append((r[0], leaf(r), subs[k], root, proof, top[-1][0], top[-1][0] == root, path))
    return sorted(out, key=repr)


def got_manifest(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumn("g", F.lit("x")).withColumn("pos", F.lit(7)).withColumn("uid", F.lit(1)).repartition(3)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [lower if c == "text" else F.col(c) for c in merkle.FIELDS]
    return sorted((tuple(r) for r in merkle.manifest(df, F.when(hit, merkle.leaf(*fields))).collect()), key=repr)


def table(seed, n, langs):
    rng = random.Random(seed)
    rows = [(rng.randrange(2 * n), rng.choice(["s", None, "ü"]), rng.choice(langs), rng.choice([None, 3]), rng.choice(["Ab C", "ab", None, "", "ÄB", "Z" * 500]))
            for _ in range(n)]
    return rows + rows[: n // 10] + [(None, "s", langs[0], 1, "No Id"), (BIG, "s", langs[0], 1, "Big"), (-5, None, None, None, None)]


@pytest.mark.parametrize("n, langs, levels", [(600, ["en", "de", None, ""], 4), (600, ["en", "de"], 1), (90, [f"l{i}" for i in range(30)], 1), (1, ["en"], 4)])
def test_manifest_against_rebuilt_trees(spark, monkeypatch, n, langs, levels):
    """Blocks of one layer put every further layer into the distributed part."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SPAN", merkle.FAN**levels)
    rows = table(n, n, langs)
    assert got_manifest(spark, rows) == manifests(rows)


def test_manifest_of_nothing_and_of_one(spark):
    assert got_manifest(spark, []) == []
    one = [(4, "s", "en", 2, "Hi")]
    assert got_manifest(spark, one) == manifests(one)


def test_versions_share_nodes():
    levels = merkle.grown([leaf((i, None, None, None, None)) for i in range(100)], 3)
    base = levels[-1][0]
    version = merkle.replaced(base, 3, 77, "00" * 32)
    shared = lambda a, b: [x is y for x, y in zip(a[1], b[1], strict=True)]
    assert version[0] != base[0] and shared(base, version) == [True, False]
    assert shared(base[1][1], version[1][1]) == [True, False, True, True, True][: len(base[1][1][1])]
    assert base[1][1][1][1][1][5][0] != "00" * 32 and version[1][1][1][1][1][5][0] == "00" * 32
