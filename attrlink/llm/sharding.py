"""Sharding by a k-d tree whose splits are distributed weighted medians.

A node with k leaves to come is split at the weight floor(k/2)/k along its widest dimension. Every
dimension becomes one 62-bit key: the scaled value in the high bits, a hash of the row in the low bits,
so a value that a third of all rows share can be cut as well. The median is found by radix: a
histogram over a few thousand bins per open node, then over the bins of the bin that holds the median,
until a bin is light or a single key. Each histogram is one aggregation over a narrow table; the
driver sees at most nodes x bins sums.

Law: ``bytes``. Null texts count no bytes (size 1), null dimensions are the least value. Repeated rows
are told apart by the row number given when the narrow table is written; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .common import small

BINS_LOG = 11
VALUE_BITS, HASH_BITS = 31, 31
#: A histogram bin this light (share of its node's bytes) is not opened further.
TOLERANCE = 1e-5


def narrow(documents: DataFrame) -> DataFrame:
    """The columns that sharding needs, written once with a fixed row number."""
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    return stage(
        documents.select(
            "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"),
            F.log(size.cast("double")).alias("d0"),
            (F.xxhash64(F.col("source")) / F.lit(2.0**64)).alias("d1"),
            (F.xxhash64(F.col("lang")) / F.lit(2.0**64)).alias("d2"),
            F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("d3"),
            F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("node"),
        ),
        "shard-rows",
    )


DIMENSIONS = ("d0", "d1", "d2", "d3")


def _key(dim: str, low: float, high: float) -> Column:
    scale = (2.0**VALUE_BITS - 1) / (high - low) if high > low else 0.0
    value = ((F.col(dim) - F.lit(low)) * F.lit(scale)).cast("long")
    spread = F.shiftrightunsigned(F.xxhash64("row", "doc_id", F.lit(dim)), 64 - HASH_BITS)
    return F.shiftleft(value, HASH_BITS).bitwiseOR(spread)


def _values(rows: DataFrame, names: str, values: list[tuple]) -> DataFrame:
    """A table of a few literal rows (one per tree node), for a broadcast join."""
    text = ", ".join(f"({', '.join(f'{v}L' for v in row)})" for row in values)
    return F.broadcast(rows.sparkSession.sql(f"SELECT * FROM VALUES {text} AS t({names})"))


def _descend(rows: DataFrame, splits: list[tuple[int, int, int, int]]) -> DataFrame:
    """``rows`` moved down one level: splits are (node, dimension, border, right child)."""
    joined = rows.join(_values(rows, "node, dim, border, right_node", splits), "node", "left")
    goes_right = F.element_at("keys", (F.col("dim") + 1).cast("int")) >= F.col("border")
    node = F.when(goes_right, F.col("right_node")).otherwise(F.col("node"))
    return joined.select(*[c for c in rows.columns if c != "node"], node.alias("node"))


def _medians(rows: DataFrame, dims: dict[int, int], goals: dict[int, float], totals: dict[int, int]) -> dict[int, int]:
    """The key of each node below which its goal of bytes lies."""
    low = dict.fromkeys(goals, 0)
    width = dict.fromkeys(goals, VALUE_BITS + HASH_BITS)
    searching = set(goals)
    while searching:
        asked = [(n, dims[n], low[n], low[n] + (1 << width[n]), max(0, width[n] - BINS_LOG)) for n in sorted(searching)]
        joined = rows.join(_values(rows, "node, dim, low, high, shift", asked), "node")
        key = F.element_at("keys", (F.col("dim") + 1).cast("int"))
        shifted = F.expr("shiftright(key - low, int(shift))")
        counts = (
            joined.select("node", "size", "low", "high", "shift", key.alias("key")).where("key >= low and key < high")
            .groupBy("node", shifted.alias("bin")).agg(F.sum("size").alias("bytes")).collect()
        )
        for n, _, _, _, shift in asked:
            run, chosen, weight = 0, 0, 0
            for chosen, weight in sorted((r["bin"], r["bytes"]) for r in counts if r["node"] == n):
                if run + weight > goals[n]:
                    break
                run += weight
            low[n] += chosen << shift
            goals[n] -= run
            width[n] = shift
            if shift == 0 or weight <= TOLERANCE * totals[n]:
                low[n] += (1 << shift) if goals[n] > weight / 2 else 0
                searching.discard(n)
    return low


def kd_tree(rows: DataFrame, leaves: int) -> DataFrame:
    """``rows`` (see ``narrow``) with their leaf number in ``shard``."""
    bounds = rows.agg(*[f(d).alias(f"{n}{d}") for d in DIMENSIONS for n, f in (("l", F.min), ("h", F.max))]).first()
    spans = {d: (float(bounds[f"l{d}"] or 0), float(bounds[f"h{d}"] or 0)) for d in DIMENSIONS}
    placed = rows.withColumn("keys", F.array(*[_key(d, *spans[d]) for d in DIMENSIONS]))
    level = {0: leaves}  # the first leaf of each node, and its number of leaves
    while any(k > 1 for k in level.values()):
        stats = placed.groupBy("node").agg(
            F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
        )
        found = {r["node"]: r for r in stats.collect() if level[r["node"]] > 1}  # one row per node
        if not found:
            break
        dims = {n: max(range(len(DIMENSIONS)), key=lambda i: _share(r, DIMENSIONS[i], spans)) for n, r in found.items()}
        totals = {n: r["bytes"] for n, r in found.items()}
        goals = {n: totals[n] * (level[n] // 2) / level[n] for n in found}
        borders = _medians(placed, dims, goals, totals)
        placed = _descend(placed, [(n, dims[n], borders[n], n + level[n] // 2) for n in sorted(found)])
        level = {
            first: k
            for n, leaf_count in level.items()
            for first, k in ([(n, leaf_count // 2), (n + leaf_count // 2, leaf_count - leaf_count // 2)] if leaf_count > 1 else [(n, 1)])
        }
    return placed.withColumn("shard", F.col("node").cast("int")).drop("keys", "node")


def _share(row, dim: str, spans: dict) -> float:
    low, high = spans[dim]
    return (row[dim] or 0.0) / (high - low) if high > low else 0.0


def shard(documents: DataFrame, leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of all rows.

    Give the number of leaves, or the bytes that a leaf should reach at most."""
    rows = narrow(documents)
    if leaves is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, math.ceil(total / target_bytes))
    placed = kd_tree(rows, leaves).withColumn("chunk", F.shiftright("row", 33))
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    at = Window.partitionBy("shard", "chunk").orderBy("row")
    numbered = placed.withColumn("at", F.row_number().over(at) - 1).join(small(offsets), ["shard", "chunk"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
