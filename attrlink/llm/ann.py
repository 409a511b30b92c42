"""Approximate nearest neighbours by multi-index hashing.

``fit`` learns a rotation on a bounded sample of the distinct vectors (iterative quantization, Gong and
Lazebnik 2011) that turns vectors into 64-bit codes. Largest inner product becomes smallest angle by one
more coordinate, ``sqrt(M^2 - |x|^2)`` with M the largest norm. Codes are split into substrings (Norouzi,
Punjani and Fleet 2012); rows are dealt to blocks by (substring, low four bits of its value). Codes within
Hamming radius ``m * (rho + 1) - 1`` agree in one of m substrings up to rho bits, so a query visits the
blocks that may hold values within rho and meets each such code. Within a block this is a scan: all inner
products are computed and the codes then mask those beyond the radius. The queries that visit a block
stand in one task; salts split the index rows only. What is left is reranked by exact inner products in
double precision. The radius is set on the sample so that it holds the wanted share of true neighbours;
copies of the query itself are met by equality. Queries that end with too few rows are run again over all
of the index.

Equal vectors are one entry of the index with their k + 1 smallest ids, so a vector that a third of all
rows share is no hot bucket; blocks of frequent values are salted. Vectors that are null, empty, zero,
of another length than most, or hold null or non-finite components take no part. Rows that repeat a
vec_id and vector count once. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .common import partitions

BITS = 64
#: Bound of the sample that rotation and radius are fitted on, by hash order.
SAMPLE_ROWS = 20_000
#: Share of true neighbours that the radius should hold.
WANTED = 0.97
#: Index rows that a block should hold.
BLOCK_ROWS = 20_000
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray
    norm: float
    substrings: int
    rho: int
    radius: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Index vectors with the coordinate that makes all norms equal."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, rest])

    def of(self, lifted: np.ndarray) -> np.ndarray:
        """Codes as m columns of 16 bits."""
        bits = ((lifted - self.mean) @ self.rotation) > 0
        packed = np.packbits(bits, axis=1, bitorder="little")
        return packed.view("<u2")


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column], dtype=np.float64)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    plain = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", v.alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    zero = F.forall("embedding", lambda x: x == 0)
    plain = plain.where(good & ~zero)
    usual = plain.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return plain.where(F.size("embedding") == (usual["d"] if usual else 0))


def fit(vectors: DataFrame, k: int, bits: int = BITS, rows: int = SAMPLE_ROWS) -> Codes | None:
    """The rotation and the radius, from at most ``rows`` distinct vectors with their number of ``copies``. The
    sample goes by hash, so vectors that are not distinct would have all their copies in it or none; in the
    radius, a neighbour counts as often as its copies stand among the k."""
    norm = vectors.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if norm is None:
        return None
    sample = vectors.select("embedding", "copies").orderBy(F.xxhash64("embedding")).limit(rows).collect()
    x, copies = _matrix([r["embedding"] for r in sample]), np.array([r["copies"] for r in sample])
    codes = Codes(np.zeros(0), np.zeros((0, 0)), float(norm), bits // 16, 0, 0)
    lifted = codes.lifted(x)
    rng = np.random.default_rng(11)
    codes.mean = lifted.mean(axis=0)
    centred = lifted - codes.mean
    _, _, axes = np.linalg.svd(centred[:5000], full_matrices=True)
    width = lifted.shape[1]
    chosen = axes[:bits].T if width >= bits else np.column_stack([axes.T, rng.standard_normal((width, bits - width))])
    reduced = centred @ chosen
    turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(25):
        signs = np.where(reduced @ turn > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(reduced.T @ signs)
        turn = u @ vt
    codes.rotation = chosen @ turn
    # distances of true neighbours within the sample, which is sparser than the whole: a safe radius
    asked = rng.permutation(len(x))[: min(500, len(x))]
    product = x[asked] @ x.T
    product[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-product, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(asked), 0), int)
    mine, theirs = codes.of(np.column_stack([x[asked], np.zeros(len(asked))])), codes.of(lifted)
    far = _ONES[mine[:, None, :] ^ theirs[best]].sum(axis=2)
    # of the k, what the copies of the vector itself and of nearer neighbours leave; its own entry is always met
    by_score = np.argsort(-np.take_along_axis(product, best, axis=1), axis=1)
    far, share = np.take_along_axis(far, by_score, axis=1), copies[np.take_along_axis(best, by_score, axis=1)]
    left = k - (np.cumsum(share, axis=1) - share + copies[asked][:, None] - 1)
    share = np.minimum(share, np.maximum(left, 0))
    if share.sum() == 0:
        share = np.ones_like(far)
    codes.radius = int(np.quantile(np.repeat(far.ravel(), share.ravel()), WANTED)) if far.size else bits
    codes.rho = codes.radius // codes.substrings
    return codes


def build_index(vectors: DataFrame, codes: Codes, salts: int) -> DataFrame:
    """(sub, part, entry, embedding, code) : each distinct vector once per substring."""
    send = vectors.sparkSession.sparkContext.broadcast(codes)  # some thousand numbers

    def run(batches):
        c = send.value
        for batch in batches:
            code = c.of(c.lifted(_matrix(batch["embedding"])))
            blob = [x.tobytes() for x in code]
            for j in range(c.substrings):
                yield pd.DataFrame(
                    {"sub": j, "value": code[:, j].astype(np.int32), "entry": batch["entry"], "embedding": batch["embedding"], "code": blob}
                )

    rows = vectors.mapInPandas(run, "sub int, value int, entry long, embedding array<double>, code binary")
    return rows.withColumn("part", _part(F.col("sub"), F.col("value"), F.pmod("entry", F.lit(salts)), salts))


GROUPS = 16


def _part(sub, value, salt, salts):
    """Block of a substring value: values are dealt to groups by their low bits, each salted."""
    return ((sub * GROUPS + F.pmod(value, F.lit(GROUPS))) * salts + salt).cast("int")


def search(queries: DataFrame, index: DataFrame, codes: Codes, k: int, salts: int, whole: bool = False) -> DataFrame:
    """(query_id, entry, score): the k best entries that each query met in each block."""
    send = queries.sparkSession.sparkContext.broadcast(codes)

    def route(batches):
        c = send.value
        everything = np.arange(1 << 16, dtype=np.uint16)
        for batch in batches:
            code = c.of(np.column_stack([_matrix(batch["embedding"]), np.zeros(len(batch))]))
            out = []
            for i, row in enumerate(batch.itertuples(index=False)):
                for j in range(1 if whole else c.substrings):
                    near = everything if whole else everything[_ONES[everything ^ code[i, j]] <= c.rho]
                    for g in np.unique(near % GROUPS):
                        for salt in range(salts):
                            out.append(((j * GROUPS + int(g)) * salts + salt, row.query_id, row.embedding, code[i].tobytes()))
            yield pd.DataFrame(out, columns=["part", "query_id", "embedding", "code"])

    def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        c = send.value
        found = []
        if len(asked) and len(rows):
            sub = int(rows["sub"].iloc[0])
            x, entry = _matrix(rows["embedding"]), rows["entry"].to_numpy()
            code = np.frombuffer(b"".join(rows["code"]), dtype="<u2").reshape(len(rows), -1)
            for start in range(0, len(asked), 256):
                part = asked.iloc[start : start + 256]
                q = _matrix(part["embedding"])
                theirs = np.frombuffer(b"".join(part["code"]), dtype="<u2").reshape(len(part), -1)
                score = q @ x.T
                if not whole:
                    total = np.zeros(score.shape, dtype=np.uint8)
                    seen = np.zeros(score.shape, dtype=bool)
                    for j in range(c.substrings):
                        apart = _ONES[theirs[:, j][:, None] ^ code[:, j][None, :]]
                        total += apart
                        if j < sub:
                            seen |= apart <= c.rho  # an earlier substring's block has this pair
                        elif j == sub:
                            mine = apart <= c.rho
                    score[~mine | seen | (total > c.radius)] = -np.inf
                keep = min(k, score.shape[1])
                bar = -np.partition(-score, keep - 1, axis=1)[:, keep - 1]
                near = score >= np.where(np.isfinite(bar), bar - 1e-9 * np.maximum(1, np.abs(bar)), -np.inf)[:, None]
                near &= np.isfinite(score)
                a, b = np.nonzero(near)
                exact = np.cumsum(q[a] * x[b], axis=1)[:, -1] if len(a) else np.empty(0)  # in order of components
                found.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[a], "entry": entry[b], "score": exact}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "entry": [], "score": []})

    tasks = partitions(queries.sparkSession)
    asked = queries.mapInPandas(route, "part int, query_id long, embedding array<double>, code binary").repartition(tasks, "part")
    rows = (index.where("sub = 0") if whole else index).select("part", "sub", "entry", "embedding", "code").repartition(tasks, "part")
    met = asked.groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(meet, "query_id long, entry long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def nearest(embeddings: DataFrame, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: k nearest others of the rows whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    plain = stage(usable(embeddings), "ann-vectors")
    # -0.0 and 0.0 group as one; equal vectors keep their k + 1 smallest ids, cut before the shuffle
    some = Window.partitionBy("embedding").orderBy("vec_id")
    members = plain.distinct().withColumn("place", F.row_number().over(some)).where(F.col("place") <= k + 1)
    members = stage(members.withColumn("entry", F.xxhash64("embedding")).drop("place"), "ann-members")
    entries = stage(members.groupBy("entry").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies")), "ann-entries")
    codes = fit(entries, k)
    if codes is None:
        return spark.createDataFrame([], schema)
    count = entries.count()
    salts = max(1, -(-count // (GROUPS * BLOCK_ROWS)))
    index = stage(build_index(entries, codes, salts), "ann-index")
    queries = stage(plain.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "embedding"), "ann-queries")
    found = stage(search(queries, index, codes, k + 1, salts), "ann-found")
    want = min(k + 1, count)
    few = queries.join(found.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < want)
    few = stage(few.select("query_id", "embedding"), "ann-few")
    if not few.isEmpty():
        again = search(few, index, codes, k + 1, salts, whole=True)
        found = found.join(few.select("query_id"), "query_id", "left_anti").unionByName(again)
    # the copies of a query need no radius; components are summed in the order of ``search``
    own = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    own = queries.select("query_id", F.xxhash64("embedding").alias("entry"), own.alias("score"))
    found = found.join(own.select("query_id", "entry"), ["query_id", "entry"], "left_anti").unionByName(own)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = found.join(members.select("entry", "vec_id"), "entry").where("vec_id != query_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
