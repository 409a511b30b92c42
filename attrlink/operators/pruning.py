"""Best-k search over a whole table in ordered blocks, most promising blocks first.

Both sides are sorted so that alike members stand together, and cut into blocks. Each block gets an envelope
(``functions.envelopes``); comparing envelopes bounds the score of every pair of blocks. Each query block first meets the
blocks of its best bounds. The k-th scores found there are what any further block has to reach, so a pair of
blocks whose bound lies below the smallest of them, or below the threshold, never meets. No hit is lost.

What is compared for all pairs are envelopes, one for a thousand or more rows. Only block pairs that may
matter send their rows anywhere. Where the values of all blocks are alike the bounds cut nothing, and every pair of
blocks meets as in ``blocks``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import envelopes, kernels, trees
from ..session import compute_partitions, stage

cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(trees)
cloudpickle.register_pickle_by_value(envelopes)

#: Rows of a block, on either side.
BLOCK = 1024
#: Envelopes compared in one task step.
CHUNK = 256
#: Blocks that a query block meets before anything is known about its scores.
FIRST = 2
#: Block pairs below which all of them meet at once: comparing envelopes would take longer.
FEW_PAIRS = 16


@dataclass(frozen=True)
class Arrangement:
    """How a kind of member is sorted (columns ``__order`` and ``__group``), described and bounded."""

    order: Callable[[DataFrame, str], DataFrame]
    envelope: Callable[[pa.Table], bytes]
    bounds: Callable[[list[bytes], list[bytes]], np.ndarray]


@dataclass(frozen=True)
class Found:
    """Hits, the block pairs that met to find them, and how many pairs there were."""

    hits: DataFrame
    met: DataFrame
    pairs: int


def ordered_blocks(rows: DataFrame, order: str, name: str, block: str, size: int) -> DataFrame:
    """``rows`` with a block number: up to ``size`` neighbours of one group, in the order of the column ``order``."""
    ranges = min(compute_partitions(rows.sparkSession), max(1, -(-rows.count() // size)))
    place = F.monotonically_increasing_id()  # partition and place in it, fixed by writing the table
    dealt = rows.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumn("__place", place)
    run = F.floor(F.col("__place").bitwiseAND((1 << 33) - 1) / size)
    number = F.xxhash64(F.shiftright("__place", 33), run, "__group")  # equal numbers would only make one block of two
    return stage(dealt.withColumn(block, number).drop("__place", "__group", order), name)


def few_blocks(queries: DataFrame, presets: DataFrame) -> bool:
    """Whether two tables make so few pairs of blocks that pruning can't pay."""
    blocks = [-(-side.count() // BLOCK) for side in (queries, presets)]
    return blocks[0] * blocks[1] <= FEW_PAIRS


def _envelopes(rows: DataFrame, block: str, envelope) -> DataFrame:
    def describe(table: pa.Table) -> pa.Table:
        return pa.table({block: table[block].slice(0, 1), "envelope": pa.array([envelope(table)], pa.binary())})

    return stage(rows.groupBy(block).applyInArrow(describe, f"{block} long, envelope binary"), "envelopes")


def _bounded(left: DataFrame, right: DataFrame, chunks: tuple[int, int], bounds, threshold: float) -> DataFrame:
    """(qb, pb, bound) of the block pairs that may reach the threshold, chunk by chunk of envelopes."""

    def compare(q: pa.Table, p: pa.Table) -> pa.Table:
        if q.num_rows and p.num_rows:
            bound = bounds(q["envelope"].to_pylist(), p["envelope"].to_pylist())
            i, j = np.nonzero(bound >= threshold)
        else:
            bound, i, j = np.empty((1, 1)), np.empty(0, np.int64), np.empty(0, np.int64)
        return pa.table({"qb": q["qb"].take(pa.array(i)), "pb": p["pb"].take(pa.array(j)), "bound": pa.array(bound[i, j], pa.float64())})

    deal = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("x", deal("qb", chunks[0])).withColumn("y", every(chunks[1]))
    right = right.withColumn("y", deal("pb", chunks[1])).withColumn("x", every(chunks[0]))
    met = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(compare, "qb long, pb long, bound double")
    return stage(met, "block-pairs")


def _meet(queries: DataFrame, presets: DataFrame, pairs: DataFrame, carried: list[str], payload: list[str], search, threshold: float) -> DataFrame:
    """Hits of the given block pairs; queries may bring what each has to reach as ``need``."""
    fields = [queries.schema[c] for c in carried] + [presets.schema[c] for c in payload]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("score", T.DoubleType()), T.StructField("kind", T.IntegerType())])

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        if q.num_rows and p.num_rows:
            need = q["need"].to_numpy() if "need" in q.column_names else threshold
            qi, pi, score, kind = search(q, p, need)
        else:
            qi = pi = kind = np.empty(0, np.int64)
            score = np.empty(0)
        hits = q.select(carried).take(pa.array(qi))
        for name in payload:
            hits = hits.append_column(name, p.column(name).take(pa.array(pi)))
        return hits.append_column("score", pa.array(score, pa.float64())).append_column("kind", pa.array(kind, pa.int32()))

    n = compute_partitions(queries.sparkSession)
    asked = queries.join(pairs.select("qb", "pb"), "qb").repartition(n, "qb", "pb")
    offered = presets.join(pairs.select("qb", "pb"), "pb").repartition(n, "qb", "pb")
    return asked.groupBy("qb", "pb").cogroup(offered.groupBy("qb", "pb")).applyInArrow(meet, schema)


def pruned_hits(
    queries: DataFrame, presets: DataFrame, by_query: str, by_preset: str, payload: list[str], search, arrangement: Arrangement,
    k: int, threshold: float, size: int | None = None,
) -> Found:
    """Hits among which are the ``k`` best presets of each query, with (score, kind) as ``search`` gives them.

    ``search`` gets two blocks and what to reach (a number or one for each query), and returns (query row, preset
    row, score, kind) arrays with the k best hits of each query in the block."""
    size = BLOCK if size is None else size
    presets = presets.select(*(F.col(c).alias(c) for c in presets.columns))  # both sides may come from one table
    left = ordered_blocks(arrangement.order(queries, by_query), "__order", "query-blocks", "qb", size)
    right = ordered_blocks(arrangement.order(presets, by_preset), "__order", "preset-blocks", "pb", size)
    ours, theirs = _envelopes(left, "qb", arrangement.envelope), _envelopes(right, "pb", arrangement.envelope)
    counts = ours.count(), theirs.count()
    chunks = tuple(max(1, -(-n // CHUNK)) for n in counts)
    pairs = _bounded(ours, theirs, chunks, arrangement.bounds, threshold)
    best_first = Window.partitionBy("qb").orderBy(F.desc("bound"), "pb")
    first = stage(pairs.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= FIRST), "first-pairs")
    hits = stage(_meet(left, right, first, [by_query], payload, search, threshold), "first-hits")
    # what a query has to reach: its k-th score so far, or the threshold while it has fewer hits
    worst = Window.partitionBy(by_query).orderBy(F.desc("score"))
    kth = hits.withColumn("place", F.row_number().over(worst)).where(F.col("place") == k).select(by_query, F.col("score").alias("kth"))
    asked = left.join(kth, by_query, "left").withColumn("need", F.greatest(F.coalesce("kth", F.lit(float(threshold))), F.lit(float(threshold)))).drop("kth")
    asked = stage(asked, "asked-again")
    low = asked.groupBy("qb").agg(F.min("need").alias("low"))
    rest = pairs.join(first.select("qb", "pb"), ["qb", "pb"], "left_anti").join(low, "qb").where("bound >= low")
    rest = stage(rest.select("qb", "pb"), "further-pairs")
    if not rest.isEmpty():
        hits = hits.unionByName(_meet(asked, right, rest, [by_query], payload, search, threshold))
    return Found(hits, first.select("qb", "pb").unionByName(rest), counts[0] * counts[1])


def text_order(rows: DataFrame, column: str) -> DataFrame:
    """Values of alike length and alike characters stand together: by length, then by their sorted characters."""
    chars = F.array_join(F.array_sort(F.split(F.col(column), "")), "")
    length = F.floor(F.char_length(column) / 4)
    return rows.withColumns({"__group": length, "__order": F.concat(F.lpad(length.cast("string"), 9, "0"), chars)})


def text_arrangement(full: bool = False) -> Arrangement:
    def envelope(table: pa.Table) -> bytes:
        name = "normalized" if "normalized" in table.column_names else "value"
        return envelopes.of_texts(table[name].to_pylist())

    return Arrangement(text_order, envelope, lambda a, b: envelopes.text_bounds(a, b, full))


#: Vectors that serve as centers, at most; they are sent to every task.
CENTERS = 1024


def vector_arrangement(sample: DataFrame, per_center: int = BLOCK // 2) -> Arrangement:
    """Vectors are sorted by the nearest of some centers, which are vectors of ``sample`` in hash order."""
    count = max(1, min(CENTERS, -(-sample.count() // per_center)))
    spread = sample.select("vector").distinct().orderBy(F.xxhash64("vector"), "vector").limit(count)
    centers = np.array([r["vector"] for r in spread.collect()], dtype=np.float64)  # CENTERS rows at most

    def order(rows: DataFrame, column: str) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

        def assign(batches):
            for batch in batches:
                x = kernels.matrix(pa.chunked_array([batch.column("vector")]))
                best, far = envelopes.nearest_center(x, centers) if len(x) else (np.empty(0), np.empty(0))
                names = pa.array([f"{c:06d}{d:020.9f}" for c, d in zip(best, np.maximum(far, 0), strict=True)], pa.string())
                group = pa.array(best.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, names, group], names=[*batch.schema.names, "__order", "__group"])

        return rows.mapInArrow(assign, f"{fields}, __order string, __group long")

    def envelope(table: pa.Table) -> bytes:
        return envelopes.of_vectors(kernels.matrix(table["vector"]))

    return Arrangement(order, envelope, envelopes.vector_bounds)


#: Rows that a packed query row and a packed preset row hold, and rows of a file of them.
PACKED, FILE_ROWS = (4096, 1024), 1 << 16
#: Files that presets are dealt to at least, so that few queries make enough tasks.
PRESET_FILES = 8


def _packed(rows: DataFrame, arrangement: Arrangement, by: str, carried: list[str], size: int, files: int, name: str) -> DataFrame:
    """``rows`` in order, up to ``size`` of them packed into one: lists of ``carried``, the vectors, and the balls of
    its runs of one group."""
    types = {c: rows.schema[c].dataType.simpleString() for c in carried}
    schema = ", ".join(f"`{c}` array<{t}>" for c, t in types.items()) + ", vectors binary, ends binary, centers binary, radii binary"

    def pack(table: pa.Table) -> pa.RecordBatch:
        x = kernels.matrix(table["vector"])
        group = table["__group"].to_numpy()
        ends = np.append(np.nonzero(group[1:] != group[:-1])[0] + 1, len(group))
        runs = np.split(x, ends[:-1])
        centers = np.stack([r.mean(axis=0) for r in runs])
        radii = np.array([np.linalg.norm(r - c, axis=1).max() for r, c in zip(runs, centers, strict=True)])
        lists = [pa.ListArray.from_arrays([0, len(x)], table[c].combine_chunks()) for c in carried]
        blobs = [pa.array([a.tobytes()], pa.binary()) for a in (x, ends.astype(np.int64), centers, radii)]
        return pa.RecordBatch.from_arrays([*lists, *blobs], [*carried, "vectors", "ends", "centers", "radii"])

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows >= size:
                yield pack(held.slice(0, size).combine_chunks())
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield pack(held.combine_chunks())

    ordered = arrangement.order(rows, by).repartitionByRange(files, "__order").sortWithinPartitions("__order")
    return stage(ordered.select(*carried, "vector", "__group").mapInArrow(run, schema), name)


def streamed_vector_hits(queries: DataFrame, presets: DataFrame, by_query: str, by_preset: str, arrangement: Arrangement, k: int, threshold: float) -> DataFrame:
    """The ``k`` best presets of each query by the dot product of ``vector`` (times 100), file by file of presets.

    Both sides are packed in order. Every packed query row meets the packed preset rows one after the other, which are
    read where they lie: no vector is shuffled for a meeting. The k-th score so far and the balls of the runs leave out
    what can't be among the best. A query leaves each file of presets with ``k`` hits, so the hits grow as the queries
    until the presets need more than PRESET_FILES files."""
    spark = queries.sparkSession
    payload = [by_preset, "rank"]
    counts = queries.count(), presets.count()
    files = [max(least, -(-n // FILE_ROWS)) for n, least in zip(counts, (min(compute_partitions(spark), -(-counts[0] // PACKED[0])), min(PRESET_FILES, -(-counts[1] // PACKED[1]))), strict=True)]
    left = _packed(queries, arrangement, by_query, [by_query], PACKED[0], max(1, files[0]), "packed-queries")
    right = _packed(presets, arrangement, by_preset, payload, PACKED[1], max(1, files[1]), "packed-presets")
    left = left.select(F.monotonically_increasing_id().alias("block"), *(F.col(c).alias(f"q_{i}") for i, c in enumerate(left.columns)))
    right = right.select(*(F.col(c).alias(f"p_{i}") for i, c in enumerate(right.columns)))
    packed = ["vectors", "ends", "centers", "radii"]
    names = {f"q_{i}": ("q", c) for i, c in enumerate([by_query, *packed])} | {f"p_{i}": ("p", c) for i, c in enumerate([*payload, *packed])}
    fields = [queries.schema[by_query], *(presets.schema[c] for c in payload)]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("kind", T.IntegerType())])

    def meet(batches):
        now, x, state = None, None, None

        def leave():
            at, ids, rank, score = state
            arrays = [x[0].take(pa.array(at)), ids, pa.array(rank), pa.array(score), pa.array(np.zeros(len(at), np.int32))]
            return pa.RecordBatch.from_arrays(arrays, names=[*schema.names])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {"q": {}, "p": {}}
                for name, (side, column) in names.items():
                    value = batch.column(batch.schema.get_field_index(name))[i]
                    row[side][column] = value.values if isinstance(value, pa.ListScalar) else value.as_buffer()
                block = batch.column(0)[i].as_py()
                if block != now:
                    if now is not None:
                        yield leave()
                    now, x = block, (row["q"][by_query], *envelopes.packed_block(row["q"]))
                    need = np.full(len(x[1]), threshold)
                    state = (np.empty(0, np.int64), row["p"][by_preset].slice(0, 0), np.empty(0, np.int64), np.empty(0))
                y, ends, centers, radii = envelopes.packed_block(row["p"])
                low = np.minimum.reduceat(need, np.append(0, x[2][:-1]))
                close = envelopes.ball_bounds(x[3], x[4], centers, radii) >= low[:, None]
                if not close.any():
                    continue
                run_rows = lambda which, stops: np.nonzero(np.repeat(which, np.diff(stops, prepend=0)))[0]
                ours, theirs = run_rows(close.any(axis=1), x[2]), run_rows(close.any(axis=0), ends)
                rank = row["p"]["rank"].to_numpy()
                search = kernels.better_in_block if np.isfinite(need).all() else kernels.nearest_in_block
                qi, pi, score, _ = search(x[1][ours], y[theirs], rank[theirs], need[ours], k)
                if not len(qi):
                    continue
                qi, pi = ours[qi], theirs[pi]
                at, ranks, scores = np.append(state[0], qi), np.append(state[2], rank[pi]), np.append(state[3], score)
                ids = pa.concat_arrays([state[1], row["p"][by_preset].take(pa.array(pi))])
                pick = kernels.keep_best(at, np.arange(len(at)), scores, None, ranks, k)
                at, ranks, scores = at[pick], ranks[pick], scores[pick]
                state = (at, ids.take(pa.array(pick)), ranks, scores)
                full = np.bincount(at, minlength=len(need)) >= k
                kth = np.full(len(need), np.inf)
                np.minimum.at(kth, at, scores)
                need = np.where(full, np.maximum(kth, threshold), threshold)
        if now is not None:
            yield leave()

    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(meet, schema)
