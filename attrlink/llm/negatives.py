"""Hard negatives by slot-decomposed selection.

An anchor's positives are its nearest rows of the same label; each asks for the best rows of other labels
whose score lies in a window below the positive's own score. The windows of one anchor overlap.

1. ``nearest_positives``: the best rows of the anchor's label, from blocks of anchors against blocks of rows.
2. The upper limits of the positives' windows split the scores into disjoint slots; a row falls into one slot
   of an anchor at most. Each block keeps the top k of every slot (the combiner, before anything is
   shuffled), a window over (anchor, slot) keeps the top k of all blocks.
3. The window of the j-th positive is all slots from the j-th on, cut at its lower limit. Slots in
   descending order are one sorted list, so each window is the head of a suffix of that list.

Anchors are a stated query set against all rows: blocks of up to BLOCK rows of either side meet, nothing of a
pair is emitted but the top k of each slot. Blocks are dealt by a hash of the row, so neither a label nor a
vector that a third of all rows share makes a block larger. Scores are exact integers.

Rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors meet those
of equal length only. Rows that bear the anchor's id are not among its positives; repeated rows count as often
as they occur. Ties go to the smaller id. An empty table, or one without anchors, gives no rows. Scores beyond
64 bits raise ``ValueError``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .common import partitions

#: Rows of one side of a block pair.
BLOCK = 65_536
#: Rows and anchors whose scores are held at once.
TILE_ROWS, TILE_ANCHORS = 8_192, 128
#: Groups that labels are dealt to in the first step, each cut into blocks of its own.
LABEL_GROUPS = 64
#: Components become integers of 1 / SCALE.
SCALE = 256.0

MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, v, size): rows that take part, their components as integers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("double"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.alias("v"),
        F.size("embedding").alias("size"),
    )


def _matrix(vectors: pa.ChunkedArray, size: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, in the narrowest type that holds them."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 2**53:
        return a @ b.T
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("inner products of these vectors don't fit into 64 bits")


def _top(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of the k best allowed scores of each anchor; ties by the smaller row."""
    least = np.iinfo(np.int64).min if scores.dtype.kind == "i" else -np.inf
    held = np.where(allowed, scores, least)
    if held.shape[1] > k:
        bar = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        a, b = np.nonzero((held >= bar[:, None]) & allowed)
    else:
        a, b = np.nonzero(allowed)
    order = np.lexsort((b, -held[a, b], a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, a, side="left")
    keep = np.arange(len(a)) - first < k
    return a[keep], b[keep]


class _Best:
    """The combiner: top k per (anchor, slot) over the tiles of a block."""

    def __init__(self, k: int):
        self.k, self.parts = k, []

    def add(self, anchor, slot, score, vec_id):
        self.parts.append((anchor, np.broadcast_to(slot, len(anchor)), score.astype(np.int64), vec_id))

    def table(self, rows: np.ndarray) -> pa.Table:
        anchor, slot, score, vec_id = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((vec_id, -score, slot, anchor))
        anchor, slot, score, vec_id = anchor[order], slot[order], score[order], vec_id[order]
        new = np.flatnonzero(np.diff(anchor, prepend=-1) | np.diff(slot, prepend=-1))
        place = np.arange(len(anchor)) - np.repeat(new, np.diff(np.append(new, len(anchor))))
        keep = place < self.k
        return pa.table({"anchor": rows[anchor[keep]], "slot": slot[keep].astype(np.int32), "score": score[keep], "vec_id": vec_id[keep]})


FOUND = "anchor long, slot int, score long, vec_id long"
_EMPTY = pa.table({"anchor": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64())})


def _meet(k: int, slots):
    """A block of anchors meets a block of rows; ``slots(tile of anchors, scores, rows)`` yields (slot, allowed)."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return _EMPTY
        rows = rows.sort_by("vec_id")  # equal scores: the first row has the smallest id
        size = asked["size"][0].as_py()
        q, x = _matrix(asked["v"], size), _matrix(rows["v"], size)
        ids, labels = (rows[c].to_numpy() for c in ("vec_id", "label"))
        out = []
        for start in range(0, len(q), TILE_ANCHORS):
            tile, best = asked.slice(start, TILE_ANCHORS), _Best(k)
            for at in range(0, len(x), TILE_ROWS):
                scores = _product(q[start : start + TILE_ANCHORS], x[at : at + TILE_ROWS])
                here = slice(at, at + TILE_ROWS)
                for slot, allowed in slots(tile, scores, ids[here], labels[here]):
                    a, b = _top(scores, allowed, k)
                    best.add(a, slot, scores[a, b], ids[here][b])
            out.append(best.table(tile["anchor"].to_numpy()))
        return pa.concat_tables(out)

    return run


def _blocks(rows: DataFrame, number: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(number)).cast("int")


def _paired(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int, more: list[str]):
    """Both sides dealt to all pairs of blocks, within equal ``more`` columns and vector sizes."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = [*more, "size", "a", "r"]
    tasks = partitions(rows.sparkSession)
    left = anchors.withColumn("a", _blocks(anchors, anchor_blocks, 1)).withColumn("r", every(row_blocks)).withColumnRenamed("row", "anchor")
    right = rows.withColumn("r", _blocks(rows, row_blocks, 2)).withColumn("a", every(anchor_blocks)).drop("row")
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys))


def _numbers(rows: int, anchors: int, spark, share: float = 1.0) -> tuple[int, int]:
    """Blocks of anchors and of rows: of BLOCK at most, and enough to occupy all tasks."""
    a = max(1, -(-int(anchors * share) // BLOCK))
    r = max(1, -(-int(rows * share) // BLOCK), -(-partitions(spark) // a))
    return a, min(r, max(1, rows // 256))


def _best_of_all(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def nearest_positives(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int], k: int) -> DataFrame:
    """(anchor, slot, score, vec_id, place): the k best other rows of each anchor's label."""

    def same(tile, scores, ids, labels):
        yield 0, (tile["label"].to_numpy()[:, None] == labels) & (tile["vec_id"].to_numpy()[:, None] != ids)

    group = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")
    a, r = _numbers(*counts, rows.sparkSession, 1 / 3)
    pairs = _paired(anchors.withColumn("g", group), rows.withColumn("g", group), a, r, ["g"])
    return _best_of_all(pairs.applyInArrow(_meet(k, same), FOUND), k)


def slot_tops(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int], k: int) -> DataFrame:
    """(anchor, slot, score, vec_id, place): the k best rows of other labels in each slot.

    ``anchors`` has ``upper`` and ``lower``, the limits of its positives' windows in descending order; slot j
    goes from the j-th upper limit down to above the next one, and no lower than the j-th lower limit."""

    def split(tile, scores, ids, labels):
        upper, lower = tile["upper"].to_pylist(), tile["lower"].to_pylist()
        most = max(map(len, upper))
        other = tile["label"].to_numpy()[:, None] != labels
        none = np.iinfo(np.int64).min  # an anchor of fewer positives has empty slots
        # limits are whole numbers, compared as 64-bit integers
        whole = scores.astype(np.int64)
        at = lambda lists, j: np.array([x[j] if j < len(x) else none for x in lists], dtype=np.int64)[:, None]
        for j in range(most):
            yield j, other & (whole <= at(upper, j)) & (whole > at(upper, j + 1)) & (whole >= at(lower, j))

    pairs = _paired(anchors, rows, *_numbers(*counts, rows.sparkSession), [])
    return _best_of_all(pairs.applyInArrow(_meet(k, split), FOUND), k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; ``vectors``: vec_id, label, embedding.

    A negative's score lies between ``low`` and ``high`` percent of the positive's."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors), "mining-rows")
    anchors = stage(rows.where(is_anchor), "mining-anchors")
    counts = rows.count(), anchors.count()
    if not counts[1]:
        return spark.createDataFrame([], MINED)
    near = nearest_positives(anchors, rows, counts, positives)
    # integer division rounds towards zero, so limits are taken from remainders
    whole = lambda p: F.call_function("div", p, F.lit(100))
    upper = lambda p: whole(high * p - F.pmod(high * p, F.lit(100)))
    lower = lambda p: whole(low * p + F.pmod(-low * p, F.lit(100)))
    best = F.array_sort(F.collect_list(F.struct("place", F.col("vec_id").alias("id"), "score")))  # at most ``positives``
    wanted = near.groupBy("anchor").agg(best.alias("near"))
    wanted = stage(
        wanted.select(
            "anchor", "near", F.transform("near", lambda x: upper(x["score"])).alias("upper"),
            F.transform("near", lambda x: lower(x["score"])).alias("lower"),
        ),
        "mining-positives",
    )
    asked = anchors.join(wanted.withColumnRenamed("anchor", "row").drop("near"), "row")
    tops = slot_tops(asked, rows, counts, negatives)
    # slots in descending order, one sorted list of positives * negatives entries at most
    falling = F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("minus"), F.col("vec_id").alias("id"))))
    merged = tops.groupBy("anchor").agg(falling.alias("falling"))
    each = wanted.join(merged, "anchor").join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    each = each.select("anchor_id", "falling", "lower", F.posexplode("near").alias("j", "positive"))
    suffix = F.slice(F.filter("falling", lambda x: x["slot"] >= F.col("j")), 1, negatives)
    in_window = F.filter(suffix, lambda x: -x["minus"] >= F.get("lower", F.col("j")))
    return each.select("anchor_id", "positive", F.posexplode(in_window).alias("rank", "negative")).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"), F.col("positive.score").alias("positive_score"),
        (-F.col("negative.minus")).alias("negative_score"),
    )
