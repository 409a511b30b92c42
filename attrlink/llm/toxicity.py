"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors.

1. ``fit``: words and their stems (first bytes) are counted per class. The log-odds with an
   informative Dirichlet prior (Monroe, Colaresi and Quinn 2008) and their z value decide what enters
   the lexicon. An entry counts no more often than it has different pairs of neighbours (estimated from a bitmap
   that the same pass fills), so the words of a passage that many labelled texts repeat prove nothing. A word scores by its own entry, else by that of its stem; every other word costs a
   small constant, so the mean score is negative.
2. ``segments``: one linear scan (Ruzzo and Tompa 1999) finds every maximal-scoring passage.
3. Karlin and Altschul's extreme-value law turns a passage score into one that is comparable over
   text lengths (``lambda * S - ln(K * n)``); the sum of the significant ones is mapped to 0..1 by a
   logistic curve fitted on the labelled texts that have one. Texts without any get the share of toxic
   ones among the labelled texts without any.

Null and empty texts hold no passage: they get the score of a text without evidence, which is below
any threshold of 0.5 or more. Repeated rows get equal scores. Without labels of both classes nothing
is known to be toxic and every score is 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import BROADCAST_ROWS, give_back, text_batches

#: Bound of the labelled sample that the lexicon and the curve are fitted on, by hash order of doc_id.
SAMPLE_ROWS = 40_000
#: Words of the lexicon at most, the most significant first; bounds what each task is sent.
LEXICON_WORDS = 200_000
#: Weight of the Dirichlet prior, as a share of all counts.
PRIOR_SHARE = 0.1
#: z from which log-odds are taken as evidence.
LEAST_Z = 2.5
#: Evidence beyond this says no more about a text.
MOST_RISE = 15.0
#: Bytes of the stem that an unlisted word falls back to.
STEM = 4
#: Cost of a word without evidence.
DRIFT = 0.15
#: Significance from which a passage counts (expected number of such passages in a text by chance).
LEAST_E = 0.05


@dataclass
class ToxicModel:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 0.1
    a: float = 1.0
    b: float = -20.0
    rest: float = 0.0
    known: bool = False


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    return raw.translate(_TABLE).split()


_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def segments(places: list[int], scores: list[float], n: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end exclusive, score) of ``n`` words of which those at
    ``places`` have ``scores`` and all others cost ``drift``. Linear time (amortized)."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total, last = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total -= drift * (place - last - 1)
        last = place
        if score <= 0:
            total += score
            continue
        start, end, left, right = place, place + 1, total, total + score
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, right - left) for s, e, left, right in found]


def _stem(word: bytes) -> bytes:
    return b"\0" + word[:STEM]


def _hits(words: list[bytes], lexicon: dict[bytes, float]) -> tuple[list[int], list[float]]:
    """Places of the words with an entry of their own or of their stem, and their scores."""
    get = lexicon.get
    places, scores = [], []
    for i, word in enumerate(words):
        score = get(word)
        if score is None:
            score = get(_stem(word))
        if score is not None:
            places.append(i)
            scores.append(score)
    return places, scores


def _evidence(text: str | None, model: ToxicModel) -> tuple[float, list[tuple[int, int, float]], int]:
    words = words_of(text)
    places, scores = _hits(words, model.lexicon)
    n = len(words)
    if not places:
        return 0.0, [], n
    bar = math.log(model.k * n / LEAST_E) / model.lam
    kept = [x for x in segments(places, scores, n, DRIFT) if x[2] >= bar]
    return sum(model.lam * s - math.log(model.k * n) for _, _, s in kept), kept, n


def _chance(rise: float, model: ToxicModel) -> float:
    if not model.known:
        return 0.0
    if rise <= 0:
        return model.rest
    x = model.a * min(rise, MOST_RISE) + model.b
    return max(model.rest, 1 / (1 + math.exp(-max(x, -700.0))))


def fit(labelled: DataFrame) -> ToxicModel:
    """Learn from (text, toxic) rows; the caller passes at most SAMPLE_ROWS of them."""
    unique = labelled.where(F.col("toxic").isNotNull()).groupBy("text").agg(F.max("toxic").alias("toxic"))

    unique = unique.withColumn("toxic", (F.col("toxic") == 1).cast("int"))
    counts = _counts(unique)
    classes = unique.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in classes}
    if not n.get(0) or not n.get(1):
        return ToxicModel()
    sums = counts.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).first()
    all_c, all_t = float(sums["c"] or 0), float(sums["t"] or 0)
    every = all_c + all_t
    if not every:
        return ToxicModel()
    prior = PRIOR_SHARE * (F.col("clean") + F.col("toxic"))

    def odds(c: str, total: float) -> Column:
        return F.log((F.col(c) + prior) / (F.lit(total + PRIOR_SHARE * every) - F.col(c) - prior))

    delta = odds("toxic", all_t) - odds("clean", all_c)
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    able = counts.where(F.abs(z) >= LEAST_Z).orderBy(F.abs(z).desc(), "word").limit(LEXICON_WORDS)
    fewer = able.select("word", F.least("clean", _places("clean_bits")).alias("clean"), F.least("toxic", _places("toxic_bits")).alias("toxic"))
    rows = fewer.select("word", delta.alias("delta"), z.alias("z")).where(F.abs("z") >= LEAST_Z).collect()
    model = ToxicModel({bytes(r["word"]): float(r["delta"]) for r in rows}, known=True)
    return _calibrate(unique, model)


#: Slots of the bitmap that estimates how many different neighbours an entry has.
SLOTS = 64
#: Bytes of text whose words are held at once while counting, and texts that are scored at once.
COUNTED_BYTES, SCORED_TEXTS = 2 << 20, 256
COUNTED = "word binary, clean long, toxic long, clean_bits long, toxic_bits long"


def _counts(unique: DataFrame) -> DataFrame:
    """(word, clean, toxic, clean_bits, toxic_bits) of all words and stems: texts per class, and a bitmap with a bit
    for each pair of neighbours that the entry has there. One pass; a batch sends each entry once."""
    schema = pa.schema([("word", pa.binary()), *((n, pa.int64()) for n in ("clean", "toxic", "clean_bits", "toxic_bits"))])

    def tally(entry: np.ndarray, names: list[bytes], owner: np.ndarray, toxic: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        size = 2 * len(names)
        texts = np.unique(owner * len(names) + entry)
        seen = np.bincount(texts % len(names) * 2 + toxic[texts // len(names)], minlength=size).reshape(-1, 2)
        bits = np.zeros(size, dtype=np.uint64)
        marks = np.unique((entry * 2 + toxic[owner]) * SLOTS + place)
        np.bitwise_or.at(bits, marks // SLOTS, np.uint64(1) << (marks % SLOTS).astype(np.uint64))
        bits = bits.view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), *(pa.array(x) for x in (*seen.T, *bits.T))], schema=schema)

    def run(batches):
        for batch in text_batches(batches, COUNTED_BYTES):
            lists = [words_of(t) for t in batch.column(1).to_pylist()]
            toxic = batch.column(0).to_numpy().astype(np.int64)
            lens = np.array([len(x) for x in lists], dtype=np.int64)
            coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
            if not len(coded):
                continue
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            digest = np.array([xxhash.xxh3_64_intdigest(w) for w in [*names, b""]], dtype=np.uint64)
            owner, ends = np.repeat(np.arange(len(lens)), lens), np.cumsum(lens)[lens > 0]
            before, after = np.append(len(names), code[:-1]), np.append(code[1:], len(names))
            before[ends - lens[lens > 0]] = len(names)
            after[ends - 1] = len(names)
            place = ((digest[before] ^ (digest[after] >> np.uint64(8))) % np.uint64(SLOTS)).astype(np.int64)
            yield tally(code, names, owner, toxic, place)
            stems = pa.array([_stem(w) for w in names], pa.binary()).dictionary_encode()
            yield tally(stems.indices.to_numpy().astype(np.int64)[code], stems.dictionary.to_pylist(), owner, toxic, place)

    counted = unique.select("toxic", "text").mapInArrow(run, COUNTED).groupBy("word").agg(
        *(F.sum(c).alias(c) for c in ("clean", "toxic")), *(F.bit_or(c).alias(c) for c in ("clean_bits", "toxic_bits"))
    )
    return stage(counted, "toxic-counts")


def _places(bits: str) -> Column:
    """Different neighbours by linear counting: as many as leave so many slots empty; a full bitmap sets no bound."""
    free = SLOTS - F.bit_count(bits)
    return F.when(free > 0, F.round(-SLOTS * F.log(free / SLOTS)).cast("long")).otherwise(F.lit((1 << 63) - 1))


def _calibrate(unique: DataFrame, model: ToxicModel) -> ToxicModel:
    """lambda and K of the chance law from clean texts, then the logistic curve over both classes."""

    def best(batches):
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = words_of(text)
                found = segments(*_hits(words, model.lexicon), len(words), DRIFT)
                out.append((max((s for _, _, s in found), default=0.0), len(words)))
            yield pd.DataFrame({"toxic": batch["toxic"], "best": [b for b, _ in out], "n": [n for _, n in out]})

    rows = unique.mapInPandas(best, "toxic int, best double, n long").toPandas()  # at most SAMPLE_ROWS rows
    clean = rows[(rows.toxic == 0) & (rows.n > 0)]
    # Gumbel tail of the best passage among clean texts: P(S >= s) = 1 - exp(-K n e^(-lambda s))
    scores = clean.best[clean.best > 0]
    model.lam = float(np.clip(1.0 / scores.mean(), 0.2, 2.0)) if len(scores) else 1.0
    model.k = float(np.clip(len(scores) / max(1.0, clean.n.sum()), 1e-6, 1.0))

    def rise(batches):
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "rise": [_evidence(t, model)[0] for t in batch["text"]]})

    seen = unique.mapInPandas(rise, "toxic int, rise double").toPandas()
    x, y = np.minimum(seen.rise.to_numpy(), MOST_RISE), seen.toxic.to_numpy(dtype=float)
    none = x <= 0
    model.rest = float(np.clip(y[none].mean(), 0.0, 0.5)) if none.any() else 0.0
    x, y = np.append(x[~none], [0.0, MOST_RISE]), np.append(y[~none], [0.0, 1.0])  # two mild anchors
    w = np.zeros(2)
    design = np.column_stack([x, np.ones_like(x)])
    for _ in range(60):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-2 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    model.a, model.b = float(max(w[0], 1e-6)), float(w[1])
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, among: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents for which ``among`` (of doc_id) holds.

    The labels are cut by hash order before they meet the texts, so the join can broadcast them."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & among)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(rows, BROADCAST_ROWS))
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


SCORED = "score double, n_words long, passages array<struct<start:long,end:long,score:double>>"


def score(documents: DataFrame, model: ToxicModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, score, number of words and significant passages of each whole text."""
    send = documents.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON_WORDS

    names = documents.select(*keep).schema
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        m = send.value
        for batch in batches:
            got = [_evidence(t, m) for t in batch.column(batch.num_columns - 1).to_pylist()]
            spans = [[{"start": s, "end": e, "score": v} for s, e, v in p] for _, p, _ in got]
            columns = {"score": pa.array([_chance(r, m) for r, _, _ in got], pa.float64()), "n_words": pa.array([n for _, _, n in got], pa.int64()), "passages": pa.array(spans, passage)}
            # the columns that stay go through untouched
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *columns.values()], names=[*batch.schema.names[:-1], *columns])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in names) + ", " + SCORED
    return documents.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def keep_below(documents: DataFrame, model: ToxicModel, bar: float) -> DataFrame:
    """The rows of ``documents`` whose text scores less than ``bar``, all columns as they are."""
    send = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = send.value
        for whole in batches:
            for start in range(0, whole.num_rows, SCORED_TEXTS):
                batch = whole.slice(start, SCORED_TEXTS)
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([_chance(_evidence(t, m)[0], m) < bar for t in texts], pa.bool_()))
            give_back()

    return documents.mapInArrow(run, documents.schema)
