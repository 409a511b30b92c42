"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import itertools
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(60))


def documents(spark, rows):
    full = [(*r, "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def hard_rows():
    near = BASE.replace("alpha30", "beta30")
    return [
        (1, BASE), (2, BASE), (2, BASE), (3, near), (4, None), (5, ""), (6, "  \t\n "), (7, "one two"), (8, "ONE two"),
        (9, LONG), (10, LONG + " end"), (None, "no id here at all"), (11, "Ünïcode Wörter ÄB"), (12, BASE.upper()),
    ]


def noisy(seed, n, words=40, vocabulary=30):
    """Documents in groups of edited copies."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        text = [f"v{rng.randrange(vocabulary * 20)}" for _ in range(rng.randrange(1, words))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(text)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(vocabulary * 20)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, n=5):
    w = white_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def components(rows, percent=75):
    """(number of shingles, smallest linked id) per row number, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[root(j)] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(len(sets[i]), least.get(root(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def occurrences(text, items, window=13):
    """(words, hit words, items) of one text by trying every window at every place."""
    words, hit, found = bench_words(text), set(), set()
    for item, phrase in items:
        p = bench_words(phrase)
        size = min(window, len(p))
        for start in range(len(p) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == p[start : start + size]:
                    hit.update(range(at, at + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)
