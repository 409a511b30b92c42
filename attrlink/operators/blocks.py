"""Best-k search between two sets of values, in bounded blocks.

A key may hold any number of distinct values on either side. Each side of a large key is cut into
blocks by hash; every query block meets every preset block of its key in one cogroup, which scores
the two bounded blocks in numpy and returns at most ``k`` hits per query. No pair is ever shuffled
and no group grows with the data. A second, small step merges the block winners.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels, trees
from ..session import compute_partitions, stage

# executors need no copy of this package: the numpy helpers travel with the task
cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(trees)

QUERY_BLOCK = 1024
PRESET_BLOCK = 4096
#: How many times larger the blocks of a search by trees are, whose work grows little with the presets: each block of
#: queries brings all presets of its key along, so there should be few.
TREE_BLOCKS = (8, 16)


def add_blocks(queries: DataFrame, presets: DataFrame, keys: list[str], by_query, by_preset, larger=(1, 1)):
    """Both sides with block numbers ``qb`` and ``pb``, copied to each block they must meet.

    Only keys above a block size need numbers; there are at most ``rows / block size`` of them,
    and their table is written first so that its real size decides how it is joined.
    """
    query_block, preset_block = QUERY_BLOCK * larger[0], PRESET_BLOCK * larger[1]
    if keys:
        counts = queries.groupBy(*keys).agg(F.count("*").alias("nq"), F.lit(0).alias("np"))
        counts = counts.unionByName(
            presets.groupBy(*keys).agg(F.lit(0).cast("long").alias("nq"), F.count("*").alias("np"))
        )
        large = (
            counts.groupBy(*keys)
            .agg(F.sum("nq").alias("nq"), F.sum("np").alias("np"))
            .filter((F.col("nq") > query_block) | (F.col("np") > preset_block))
        )
        large = stage(large, "large-keys")
        if large.isEmpty():
            only = {"qb": F.lit(0), "pb": F.lit(0)}
            return queries.withColumns(only), presets.withColumns(only)
        queries = queries.join(large, keys, "left")
        presets = presets.join(large, keys, "left")
        nq, n_p = F.coalesce("nq", F.lit(1)), F.coalesce("np", F.lit(1))
    else:
        nq, n_p = F.lit(queries.count()), F.lit(presets.count())
    q_blocks = F.greatest(F.ceil(nq / query_block), F.lit(1)).cast("int")
    p_blocks = F.greatest(F.ceil(n_p / preset_block), F.lit(1)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    queries = queries.withColumn("qb", F.pmod(F.xxhash64(*by_query), q_blocks).cast("int"))
    queries = queries.withColumn("pb", every(p_blocks)).drop("nq", "np")
    presets = presets.withColumn("pb", F.pmod(F.xxhash64(*by_preset), p_blocks).cast("int"))
    presets = presets.withColumn("qb", every(q_blocks)).drop("nq", "np")
    return queries, presets


def block_hits(
    queries: DataFrame,
    presets: DataFrame,
    keys: list[str],
    by_query: list[str],
    by_preset: list[str],
    search: Callable[[pa.Table, pa.Table], tuple],
    payload: list[str],
    larger: tuple[int, int] = (1, 1),
) -> DataFrame:
    """Hits of every query block against every preset block of its key.

    ``search`` gets the two blocks and returns (query row, preset row, score, kind) arrays.
    ``larger``: how many times the usual sizes the blocks may have. The result has the keys, the ``by_query`` columns, the preset ``payload``, score and kind.
    """
    # both sides may come from one table: give the presets column identities of their own
    presets = presets.select(*(F.col(c).alias(c) for c in presets.columns))
    left, right = add_blocks(queries, presets, keys, by_query, by_preset, larger)
    carried = [*keys, *by_query]
    fields = [queries.schema[c] for c in carried] + [presets.schema[c] for c in payload]
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in fields]
        + [T.StructField("score", T.DoubleType()), T.StructField("kind", T.IntegerType())]
    )

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        if q.num_rows and p.num_rows:
            qi, pi, score, kind = search(q, p)
        else:
            qi = pi = kind = np.empty(0, np.int64)
            score = np.empty(0)
        hits = q.select(carried).take(pa.array(qi))
        for name in payload:
            hits = hits.append_column(name, p.column(name).take(pa.array(pi)))
        hits = hits.append_column("score", pa.array(score, pa.float64()))
        return hits.append_column("kind", pa.array(kind, pa.int32()))

    # one text names the meeting of two blocks; as a computed column it keeps the number of
    # partitions asked for even where a key column is constant
    cell = F.to_json(F.struct(*keys, "qb", "pb"))
    n = compute_partitions(queries.sparkSession)
    left, right = (
        side.withColumn("cell", cell).repartition(n, "cell").groupBy("cell")
        for side in (left, right)
    )
    return left.cogroup(right).applyInArrow(meet, schema)


def merge_hits(hits: DataFrame, by: list[str], k: int, held: DataFrame, on: list[str]) -> DataFrame:
    """The ``k`` best rows per query out of its block winners, as an ordered array ``matches``.

    A winner is a distinct value; its first ``k`` rows (``rows`` of ``held``, in row order) are fetched by
    ``on`` for the winners only. Any row among the ``k`` best has its value among the ``k`` best values, so
    nothing is lost on the way.
    """
    best = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("rank"))
    top = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    top = top.join(held, on)
    found = F.transform(
        "rows",
        lambda r: F.struct(
            (-F.col("score")).alias("order"), r["row_id"].alias("row_id"), r.alias("row"),
            F.col("score").alias("score"), F.col("kind").alias("kind"),
        ),
    )
    return top.groupBy(*by).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list(found))), 1, k).alias("matches")
    )
