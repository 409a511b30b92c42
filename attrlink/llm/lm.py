"""Language-model scoring with a weighted backoff automaton.

States are the word sequences of up to ``order - 1`` words that training texts hold; the arc of a word
leads to the longest counted suffix and weighs its smoothed log10 probability; the failure arc of a
state leads to the sequence without its first word and weighs the mass left for unseen words. A text is
read once from left to right: from the present state failure arcs are followed until the word has an
arc, and the weights add up. Smoothing is the hierarchical Dirichlet prior (MacKay and Peto 1995),
``P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m)`` with the add-0.1 estimate at the root, so the arcs
and the failure arc of each state sum to one.

The automaton of all texts would not fit anywhere. Texts are cut into batches of some megabytes
(written once), and a batch needs only the part of the automaton that its own n-grams touch. Batches
send their distinct n-grams with local counts, packed by hash range; each range adds them up over all
batches and answers with totals in the sender's order. An n-gram costs a batch one entry however often
it occurs, so frequent words are no hot keys. Nothing is pruned, capped or sampled. N-grams are told
apart by 64-bit hashes.

Null and empty texts consist of the end token. Rows are scored each, repeated ones equally. Rows
without doc_id are held out of training and marked so; an empty table gives no rows. Without any
training text all probabilities are those of the add-0.1 estimate.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import expand, hash_borders, mix, ngram_hashes, pack, squeeze, text_batches, unpack, word_codes, word_hashes

ORDER = 3
#: Weight of the shorter context, in words, for each order from 2 on.
PRIOR = {2: 6.0, 3: 2.0, 4: 1.0, 5: 1.0}
BATCH_BYTES = 6 << 20
#: Bytes of n-gram hashes that one range should gather.
RANGE_BYTES = 8 << 20
ADD = 0.1
END_HASH = mix(np.array([0x5EED], dtype=np.uint64))[0]


def token_batches(documents: DataFrame, held_out: Column) -> DataFrame:
    """Texts as word codes, some megabytes of text to a row, written once."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, got in enumerate(text_batches(batches, BATCH_BYTES)):
            codes, lens, words = word_codes(got.column("text"))
            yield pa.RecordBatch.from_pydict(
                {
                    "batch": [f"{part}-{number}"],
                    "ids": pa.array([got.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "held": [np.packbits(got.column("held").to_numpy(zero_copy_only=False).astype(bool)).tobytes()],
                    "lens": [squeeze(lens)], "codes": [squeeze(codes)], "words": [word_hashes(words).tobytes()],
                    "tokens": [len(codes) + len(lens)],
                }
            )

    chosen = documents.select("doc_id", F.coalesce(held_out, F.lit(True)).alias("held"), "text")
    schema = "batch string, ids array<long>, held binary, lens binary, codes binary, words binary, tokens long"
    return stage(chosen.mapInArrow(run, schema), "lm-batches")


class Batch:
    """One batch: its token sequence with an end after each text."""

    def __init__(self, row, mask: int):
        lens = expand(row["lens"])
        words = np.frombuffer(row["words"], dtype=np.uint64)
        codes = expand(row["codes"])
        self.ids, self.texts, self.mask = row["ids"], len(lens), np.uint64(mask)
        self.held = np.unpackbits(np.frombuffer(row["held"], dtype=np.uint8), count=len(lens)).astype(bool)
        self.sizes = lens + 1
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.tokens = int(self.sizes.sum())
        self.hashes = np.full(self.tokens, END_HASH, dtype=np.uint64)
        inner = np.ones(self.tokens, dtype=bool)
        inner[self.starts + lens] = False
        if len(codes):
            self.hashes[inner] = words[codes]
        self.place = (np.arange(self.tokens) - np.repeat(self.starts, self.sizes)).astype(np.int32)
        self.train = np.repeat(~self.held, self.sizes)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams of order k, the places where one ends, and which one that is."""
        ends = np.flatnonzero(self.place >= k - 1)
        found, which = np.unique(ngram_hashes(self.hashes, k)[ends - k + 1] & self.mask, return_inverse=True)
        return found, ends, which


def send(batches: DataFrame, order: int, bits: int, mask: int) -> DataFrame:
    """(part, level, piece, batch, grams, counts): distinct n-grams of each batch by hash range."""

    def run(rows):
        for frame in rows:
            for row in frame.to_dict("records"):
                batch = Batch(row, mask)
                unused = np.uint64((~mask & ((1 << 64) - 1)).bit_length())
                for k in range(1, order + 1):
                    grams, ends, which = batch.grams(k)
                    counts = np.bincount(which[batch.train[ends]], minlength=len(grams))
                    borders, out = hash_borders(grams, bits), []
                    for r in range(1 << bits):
                        a, b = borders[r], borders[r + 1]
                        if a < b:
                            out.append(((k << 32) + r, k, r, row["batch"], pack(grams[a:b] >> unused), squeeze(counts[a:b])))
                    yield pd.DataFrame(out, columns=["part", "level", "piece", "batch", "grams", "counts"])

    return batches.select("batch", "ids", "held", "lens", "codes", "words").mapInPandas(
        run, "part long, level int, piece int, batch string, grams binary, counts binary"
    )


def add_up(sent: DataFrame) -> DataFrame:
    """Totals over all batches, in the order of each batch's own n-grams; n and v of order 1."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        grams = [unpack(x) for x in frame["grams"]]
        ends = np.cumsum([len(g) for g in grams])
        counts = np.concatenate([expand(x) for x in frame["counts"]])
        found, which = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.zeros(len(found), dtype=np.int64)
        np.add.at(sums, which, counts)
        answer = frame[["batch", "level", "piece"]].copy()
        answer["totals"] = [squeeze(x) for x in np.split(sums[which], ends[:-1])]
        first = int(frame["level"].iloc[0]) == 1
        answer["n"] = [int(sums.sum()) if first else 0] + [0] * (len(frame) - 1)
        answer["v"] = [int((sums > 0).sum()) if first else 0] + [0] * (len(frame) - 1)
        return answer

    return stage(
        sent.groupBy("part").applyInPandas(run, "batch string, level int, piece int, totals binary, n long, v long"), "lm-totals"
    )


def traverse(batch: Batch, totals: list[np.ndarray], n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 probability, base and known words of each text.

    The state after a place is the longest counted suffix there, so the states of all places are found at
    once; each place then adds the failure arcs from its predecessor's state and the arc of its word."""
    order = len(totals)
    count = []
    for k in range(1, order + 1):
        _, ends, which = batch.grams(k)
        count.append(np.zeros(batch.tokens))
        count[-1][ends] = totals[k - 1][which]
    floor = math.log10(ADD / (n + ADD * (v + 1)))
    arc = np.where(count[0] > 0, np.log10((count[0] + ADD) / (n + ADD * (v + 1))), floor)
    base = arc.copy()
    score = arc
    p = 10.0**arc
    for k in range(2, order + 1):
        m = PRIOR[k]
        context = np.zeros(batch.tokens)
        context[1:] = count[k - 2][:-1]
        context[batch.place < k - 1] = 0
        p = (count[k - 1] + m * p) / (context + m)  # the smoothed weight of an arc of this order
        left = np.log10(m / (context + m))  # the failure arc; 0 where there is no such state
        seen = count[k - 1] > 0
        score = np.where(seen, np.log10(p), score + left)
    per_text = lambda x: np.add.reduceat(x, batch.starts) if batch.texts else np.empty(0)
    return per_text(score), per_text(base), per_text((count[0] > 0).astype(np.int64))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(documents: DataFrame, held_out: Column, order: int = ORDER) -> DataFrame:
    """Scores of all texts by the model learnt from those for which ``held_out`` is false."""
    batches = token_batches(documents, held_out)
    tokens = batches.agg(F.sum("tokens")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1.0, tokens * 8 / RANGE_BYTES))))
    # the high bits stay, as they make the ranges
    used = min(64, math.ceil(math.log2(max(2, tokens * order))) + 26)
    mask = ((1 << 64) - 1) ^ ((1 << (64 - used)) - 1)
    totals = add_up(send(batches, order, bits, mask))
    sums = totals.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records"):
            batch = Batch(row, mask)
            pieces: dict[int, list] = defaultdict(list)
            for level, piece, blob in zip(answers["level"], answers["piece"], answers["totals"], strict=True):
                pieces[level].append((piece, blob))
            total = []
            for k in range(1, order + 1):
                got = [expand(b) for _, b in sorted(pieces[k])]
                total.append(np.concatenate(got) if got else np.zeros(0, np.int64))
            scores, base, known = traverse(batch, total, n, v)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(list(batch.ids), dtype="Int64"), "held_out": batch.held, "n_tokens": batch.sizes,
                        "n_known": known, "train_tokens": n, "base_score": base, "score": scores,
                    }
                )
            )
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in SCORES.split(", ")])

    texts = batches.select("batch", "ids", "held", "lens", "codes", "words")
    answers = totals.select("batch", "level", "piece", "totals")
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, SCORES)


def step(state: tuple, word, counts: dict[tuple, int], n: int, v: int, order: int) -> tuple[tuple, float]:
    """One step of the automaton over plain counts: (next state, log10 weight); the tests' measure."""

    def weight(gram: tuple) -> float:
        if len(gram) == 1:
            return (counts.get(gram, 0) + ADD) / (n + ADD * (v + 1))
        m = PRIOR[len(gram)]
        return (counts.get(gram, 0) + m * weight(gram[1:])) / (counts.get(gram[:-1], 0) + m)

    total = 0.0
    while state and not counts.get((*state, word)):
        m = PRIOR[len(state) + 1]
        total += math.log10(m / (counts.get(state, 0) + m))
        state = state[1:]
    total += math.log10(weight((*state, word)))
    after = (*state, word)[-(order - 1) :] if order > 1 else ()
    while after and not counts.get(after):
        after = after[1:]
    return after, total
