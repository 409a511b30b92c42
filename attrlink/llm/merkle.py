"""A Merkle manifest of a table as a persistent, path-copying tree.

Each row is a leaf. Leaves of one group (lang) ascend by doc_id; every FAN consecutive nodes become one until
a single one, the group's subroot, remains. The subroots, in order of their groups, likewise give the root.

* ``leaves`` hashes rows where they are read; only digests and ids are sorted, never texts. ``placed``
  numbers them from the places inside range partitions and the partitions' counts, so a group that holds a
  third of all rows is cut like any other.
* ``packed`` deals SPAN consecutive, aligned nodes of a group to one block and reduces each block to one
  node. Those nodes are the next layer, packed again, until each group has one; layers shrink by SPAN.
* ``paths`` goes down again: each node learns the siblings of all its ancestors.
* A tampered leaf makes a version: in its block only the ancestors are copied (``replaced``), all other nodes are the
  very objects of the original tree. The version goes on from the block's node over the layers above, by
  the siblings that its block has learnt; every block continues its own versions.

Null doc_ids come first in their group, the null group comes first. Rows of equal doc_id are ordered by their
digest; repeated rows are leaves of their own. An empty table gives no rows. Columns other than the hashed
ones play no part.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage
from .common import partitions, small

#: Children of a node, and layers of nodes inside a block.
FAN, LEVELS = 8, 4
SPAN = FAN**LEVELS
#: Rows with paths that may be broadcast; one has a few kilobytes.
WIDE_ROWS = 5_000
#: Fixed values of the contract: the hashed columns, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(*fields: Column) -> Column:
    """SHA-256 of all fields, each with its length in front, or ``-`` for null."""
    parts = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in parts]), 256)


def join(digests) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    """Layers above ``n`` nodes."""
    layers = 0
    while n > 1:
        n, layers = -(-n // FAN), layers + 1
    return layers


def grown(digests: list[str], layers: int) -> list[list[tuple]]:
    """The nodes of all layers over ``digests``; a node is (digest, children) and never changes."""
    levels = [[(d, ()) for d in digests]]
    for _ in range(layers):
        below = levels[-1]
        runs = [tuple(below[i : i + FAN]) for i in range(0, len(below), FAN)]
        levels.append([(join(d for d, _ in run), run) for run in runs])
    return levels


def replaced(node: tuple, layers: int, index: int, digest: str) -> tuple:
    """The version of ``node`` whose leaf at ``index`` has ``digest``: its ancestors are new, the rest is shared."""
    if not layers:
        return digest, ()
    which, inner = divmod(index, FAN ** (layers - 1))
    children = node[1]
    new = replaced(children[which], layers - 1, inner, digest)
    run = (*children[:which], new, *children[which + 1 :])
    return join(d for d, _ in run), run


def copied(node: tuple, layers: int, index: int) -> list[str]:
    """Digests of the ancestors of the leaf at ``index``, lowest first."""
    found = []
    while layers:
        found.append(node[0])
        layers -= 1
        which, index = divmod(index, FAN**layers)
        node = node[1][which]
    return found[::-1]


def siblings(levels: list[list[tuple]], index: int) -> list[tuple[str, str]]:
    """What stands left and right of the ancestors at each layer inside their runs, as joined digests."""
    found = []
    for level in levels[:-1]:
        start = index - index % FAN
        found.append(("".join(d for d, _ in level[start:index]), "".join(d for d, _ in level[index + 1 : start + FAN])))
        index //= FAN
    return found


def leaves(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(uid, g, lang, doc_id, digest, changed): one row for each row of ``documents``; digests as 32 bytes."""
    changed = F.lit(None).cast("string") if tampered is None else tampered
    return stage(
        documents.select(
            F.monotonically_increasing_id().alias("uid"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"), "doc_id",
            F.unhex(leaf(*[F.col(x) for x in FIELDS])).alias("digest"), F.unhex(changed).alias("changed"),
        ),
        "merkle-leaves",
    )


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with their place (pos) in their group g and the group's size n."""
    ranges = partitions(nodes.sparkSession)
    row = F.monotonically_increasing_id()
    dealt = nodes.repartitionByRange(ranges, "g", *order).sortWithinPartitions("g", *order)
    dealt = stage(dealt.withColumn("row", row), "merkle-order").withColumn("part", F.shiftright("row", 33))
    # one row per group and range
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("here"), F.min("row").alias("first"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("g")
    offsets = counts.select(
        "g", "part", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(every).alias("n")
    )
    offsets = stage(offsets, "merkle-offsets")
    return dealt.join(small(offsets), ["g", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift")


BLOCK = "g string, block long, n long, root string, members array<struct<digest:binary,changed:binary,doc_id:long>>"
_MEMBER = pa.list_(pa.struct([("digest", pa.binary()), ("changed", pa.binary()), ("doc_id", pa.int64())]))
_BLOCK = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("root", pa.string()), ("members", _MEMBER)])


def packed(nodes: DataFrame, name: str) -> DataFrame:
    """One row per block of SPAN nodes: its members in order and the node that they become."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        digests = [d.hex() for d in table["digest"].to_pylist()]
        root = grown(digests, min(LEVELS, height(n)))[-1][0][0]
        members = pa.StructArray.from_arrays([table[f.name].combine_chunks() for f in _MEMBER.value_type], fields=list(_MEMBER.value_type))
        row = [pa.array([table[c][0].as_py()], _BLOCK.field(c).type) for c in ("g", "block", "n")]
        return pa.Table.from_arrays([*row, pa.array([root]), pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members).cast(_MEMBER)], schema=_BLOCK)

    block = F.floor(F.col("pos") / SPAN).cast("long")
    rows = nodes.select("g", block.alias("block"), "pos", "n", "digest", "changed", F.col("doc_id").cast("long").alias("doc_id"))
    return stage(rows.groupBy("g", "block").applyInArrow(run, BLOCK), name)


SIDES = "array<struct<left:string,right:string>>"
_SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def paths(blocks: DataFrame) -> DataFrame:
    """(g, block, top, above): for each block of one layer its group's last node, and the siblings of the
    block's ancestors up to there."""
    if blocks.where(F.col("n") > SPAN).isEmpty():
        return blocks.select("g", "block", F.col("root").alias("top"), F.array().cast(SIDES).alias("above"))
    layer = blocks.select(
        "g", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).cast("long").alias("n"), F.unhex("root").alias("digest"),
        F.lit(None).cast("binary").alias("changed"), F.lit(None).cast("long").alias("doc_id"),
    )
    upper = packed(layer, "merkle-layer")
    rows = upper.join(paths(upper), ["g", "block"])
    schema = pa.schema([("g", pa.string()), ("block", pa.int64()), ("top", pa.string()), ("above", _SIDES)])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels = grown([m["digest"].hex() for m in row["members"]], min(LEVELS, height(row["n"])))
                rest = [(x["left"], x["right"]) for x in row["above"]]
                size = len(row["members"])
                above = [[{"left": a, "right": b} for a, b in [*siblings(levels, i), *rest]] for i in range(size)]
                first = row["block"] * SPAN
                columns = [[row["g"]] * size, list(range(first, first + size)), [row["top"]] * size, above]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    found = rows.select("g", "block", "n", "members", "top", "above").mapInArrow(run, f"g string, block long, top string, above {SIDES}")
    return stage(found, "merkle-paths")


MANIFEST = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "copied array<string>"
)


def manifest(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``documents``.

    ``tampered`` gives the digest of the changed leaf (64 hex digits), or null where nothing was changed. ``copied``:
    the digests of the ancestors that the row's version has of its own, lowest first; null where nothing was changed.
    """
    blocks = packed(placed(leaves(documents, tampered), ["doc_id", "digest", "uid"]), "merkle-blocks")
    up = paths(blocks)
    tops = stage(up.select("g", F.col("top").alias("subroot")).distinct(), "merkle-subroots")
    # the subroots are the leaves of one more tree; its only group is the empty name
    last = tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.unhex("subroot").alias("digest"))
    last = stage(placed(last, ["name"]), "merkle-tops")
    final = packed(last.withColumn("changed", F.lit(None).cast("binary")).withColumn("doc_id", F.lit(None).cast("long")), "merkle-root")
    whole = paths(final)
    ends = _ends(final, whole, last)
    rows = blocks.join(small(up, most=WIDE_ROWS), ["g", "block"]).join(small(ends, most=WIDE_ROWS), "g")
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
    schema = pa.schema(list(zip([x.split()[0] for x in MANIFEST.split(", ")], types, strict=True)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                layers = min(LEVELS, height(row["n"]))
                levels = grown([m["digest"].hex() for m in row["members"]], layers)
                above = [(x["left"], x["right"]) for x in (*row["above"], *row["beyond"])]
                rest = "".join(a + b for a, b in above)
                out = []
                for i, member in enumerate(row["members"]):
                    digest, beside = member["digest"].hex(), siblings(levels, i)
                    proof = sha256(("".join(a + b for a, b in beside) + rest).encode()).hexdigest()
                    path = None
                    if member["changed"] is None:
                        folded = digest
                        for left, right in (*beside, *above):
                            folded = join((left, folded, right))
                    else:
                        version = replaced(levels[-1][0], layers, i, member["changed"].hex())
                        folded, path = version[0], copied(version, layers, i)
                        for left, right in above:
                            folded = join((left, folded, right))
                            path.append(folded)
                    out.append((member["doc_id"], digest, row["top"], row["root"], proof, folded, folded == row["root"], path))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)

    return rows.select("g", "block", "n", "members", "top", "above", "beyond", F.col("end").alias("root")).mapInArrow(run, MANIFEST)


def _ends(final: DataFrame, whole: DataFrame, last: DataFrame) -> DataFrame:
    """(g, end, beyond): the root, and the siblings on the way from each group's subroot to it."""
    schema = pa.schema([("pos", pa.int64()), ("end", pa.string()), ("beyond", _SIDES)])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels = grown([m["digest"].hex() for m in row["members"]], min(LEVELS, height(row["n"])))
                rest, size = [(x["left"], x["right"]) for x in row["above"]], len(row["members"])
                beyond = [[{"left": a, "right": b} for a, b in [*siblings(levels, i), *rest]] for i in range(size)]
                first = row["block"] * SPAN
                columns = [list(range(first, first + size)), [row["top"]] * size, beyond]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    found = final.join(whole, ["g", "block"]).select("block", "n", "members", "top", "above").mapInArrow(run, f"pos long, end string, beyond {SIDES}")
    return stage(last.select(F.col("name").alias("g"), "pos").join(found, "pos").drop("pos"), "merkle-ends")
