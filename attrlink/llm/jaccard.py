"""N-gram Jaccard join in the Jaccard metric space: pivots, regions, windows, recursion; exact.

``d(A, B) = 1 - |A n B| / |A u B|`` is a metric on shingle sets. Equal sets are one point, so copies
never meet each other.

1. Outer pivots are single shingles. A point lies in the region of the shingles it holds; ordered from
   rare to frequent, two points within the radius share one of their first ``n - ceil(t n) + 1``
   shingles, so a point is replicated to those regions only. The order comes from a fixed-size table of
   counts over all shingles of all texts, so a passage that a third of all texts share stands last.
2. Points of one region meet at its pivot point, the smallest one. A batch of texts sends one summary for
   each of its shingles (its smallest point there), so a frequent shingle gets one entry per batch; the
   answer names the smallest of all, and the batch assigns its own members. Members that can't overlap
   enough with any other, by size and place of the shared shingle, stay out.
3. First each point is compared with its nearest pivot, the one it shares most outer regions with. Points
   within the radius of one pivot are connected, and regions inside one component are settled: this is
   all that groups of copies need, at the cost of one comparison a point.
4. The other regions first lose the points that can't link to any other one there, by a bound that needs
   the first shingles only. What is left is joined in full. Distances to a pivot settle most pairs: points within its radius
   are connected, and points whose distances to it differ by more than the radius (the triangle
   inequality) can't be linked. What is left recurses with the next pivot. A region beyond one task's size
   is joined as pairs of blocks.

No link is lost and no list of pairs of a group is made; components come from links to pivots.

A text with fewer words than a shingle is one shingle; texts without words are points of their own.
Null doc_id: the row takes part, ids of its component come from the others. Repeated rows are one point.
Points are told apart by 64-bit digests of their sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import (
    expand, give_back, hash_borders, mix, ngram_hashes, pack, pack32, partitions, small, squeeze, text_batches, unpack, unpack32, word_codes, word_hashes,
)
from .common import stage_in_small_batches as stage


WORDS = 5
#: Similarity from which two texts link, in hundredths.
PERCENT = 75
BATCH_BYTES = 3 << 20
RANGE_BYTES = 4 << 20
#: Slots of the table of shingle counts (fixed; one byte of each is broadcast).
SLOTS_LOG = 22
#: Bits of a shingle's hash that stay behind when whole sets travel: two sets of a hundred thousand shingles take two
#: different ones for equal with a chance of one in ten thousand.
SPARED = 16
#: Parts that the table is added up in.
CHUNKS = 16
#: Shingles of an inner region that one task compares at once.
REGION_SHINGLES = 2_000_000


def least_overlap(a, b):
    """Shared shingles from which sets of sizes a and b link."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


class Sets:
    """The shingle sets of a batch of texts: sorted hashes of all texts, one after the other."""

    def __init__(self, texts: pa.Array, words_per: int = WORDS):
        codes, lens, words = word_codes(texts)
        hashes = word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
        del codes, words
        starts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        # shingles of a text: one for each place that has all words, or one in all for a short text
        count = np.where(lens >= words_per, lens - words_per + 1, (lens > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        owner = np.repeat(np.arange(len(lens), dtype=np.int32), count)
        gram = np.zeros(first[-1], dtype=np.uint64)
        full = (lens >= words_per)[owner]
        place = np.flatnonzero(full) + (starts[:-1] - first[:-1])[owner[full]]
        gram[full] = ngram_hashes(hashes, words_per)[place]
        del full, place
        for i in np.flatnonzero((lens > 0) & (lens < words_per)):
            gram[first[i]] = ngram_hashes(hashes[starts[i] : starts[i + 1]], int(lens[i]))[0]
        del hashes
        for x, y in zip(first[:-1], first[1:], strict=True):
            gram[x:y].sort()
        keep = np.ones(len(gram), dtype=bool)
        keep[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        self.grams, self.owner = gram[keep], owner[keep]
        self.sizes = np.bincount(self.owner, minlength=len(lens)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def points(self) -> np.ndarray:
        """A digest of each set; 0 stands for the empty set."""
        raw = self.grams.view(np.uint8)
        return np.array(
            [
                (xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b].data) or 1) if b > a else 0
                for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)
            ],
            dtype=np.uint64,
        )


def _slots(grams: np.ndarray) -> np.ndarray:
    return (mix(grams ^ np.uint64(0xA5A5)) >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)


def describe(documents: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(rid, doc_id, point, n) of each text, and the table of shingle counts."""

    width = (1 << SLOTS_LOG) // CHUNKS

    def run(batches):
        counts = np.zeros(1 << SLOTS_LOG, dtype=np.uint32)
        for got in text_batches(batches, BATCH_BYTES):
            sets = Sets(got.column("text"))
            np.add.at(counts, _slots(sets.grams), np.uint32(1))
            yield pa.RecordBatch.from_pydict(
                {"rid": got.column("rid").combine_chunks(), "doc_id": got.column("doc_id").combine_chunks(), "point": pa.array(sets.points().view(np.int64)), "n": pa.array(sets.sizes),
                 "chunk": pa.nulls(got.num_rows, pa.int32()), "counts": pa.nulls(got.num_rows, pa.binary())}
            )
        for c in range(CHUNKS):
            part = counts[c * width : (c + 1) * width]
            yield pa.RecordBatch.from_pydict(
                {"rid": pa.nulls(1, pa.int64()), "doc_id": pa.nulls(1, pa.int64()), "point": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()),
                 "chunk": pa.array([c], pa.int32()), "counts": [squeeze(part)]}
            )

    rows = stage(
        documents.select(row_id().alias("rid"), "doc_id", "text").mapInArrow(run, "rid long, doc_id long, point long, n long, chunk int, counts binary"), "jaccard-points"
    )

    # groups of one chunk and a few dozen senders: the table is of fixed size, the partial sums come in rounds
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.int64)
        for blob in frame["counts"]:
            total += expand(blob)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "counts": [squeeze(total)]})

    parts = rows.where(F.col("chunk").isNotNull()).select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("round"))
    some = parts.groupBy("chunk", "round").applyInPandas(add, "chunk int, counts binary")
    table = np.zeros(1 << SLOTS_LOG, dtype=np.int64)
    for row in some.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect():  # CHUNKS rows
        table[row["chunk"] * width : (row["chunk"] + 1) * width] = expand(row["counts"])
    return rows.where(F.col("chunk").isNull()).select("rid", "doc_id", "point", "n"), table


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for slots of ordinary counts, then one class for each doubling above; any choice gives exact results."""
    mean = max(1.0, float(counts.mean()))
    ordinary = mean + 5 * math.sqrt(mean)
    classes = np.zeros(len(counts), dtype=np.uint8)
    frequent = np.flatnonzero(counts > ordinary)
    classes[frequent] = 1 + np.log2(counts[frequent] / ordinary)
    return classes


def prefixes(sets: Sets, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, place) of the first shingles of each text, from rare to frequent."""
    rank = classes[_slots(sets.grams)]
    # texts and, inside, shingles are in order already; only the frequent ones move back
    order = np.argsort(sets.owner.astype(np.int64) << 8 | rank, kind="stable")
    length = sets.sizes - (PERCENT * sets.sizes + 99) // 100 + 1
    place = (np.arange(len(order)) - sets.starts[:-1][sets.owner]).astype(np.int32)
    first = place < length[sets.owner]
    return sets.grams[order[first]], sets.owner[first], place[first]


class Entries:
    """The prefix entries of a batch, sorted by shingle; equal sets of the batch count once."""

    def __init__(self, sets: Sets, classes: np.ndarray):
        points = sets.points().view(np.int64)
        _, once = np.unique(points, return_index=True)
        once = once[np.lexsort((points[once], sets.sizes[once]))]  # numbered by size, then digest
        self.points, self.sizes = points[once], sets.sizes[once]
        number = np.full(len(points), -1, dtype=np.int64)
        number[once] = np.arange(len(once))
        gram, owner, place = prefixes(sets, classes)
        mine = number[owner] >= 0
        gram, at, place = gram[mine], number[owner[mine]], place[mine]
        order = np.argsort(gram)
        gram, self.at, self.place = gram[order], at[order], place[order]
        head = np.ones(len(gram), dtype=bool)
        head[1:] = gram[1:] != gram[:-1]
        self.heads = np.flatnonzero(head)
        self.grams = gram[self.heads]
        self.members = np.diff(np.append(self.heads, len(gram)))
        self.first = np.minimum.reduceat(self.at, self.heads) if len(gram) else self.at


SENT = (
    "batch string, part int, grams binary, points binary, sizes binary, at binary, places binary, members binary"
)


def send(documents: DataFrame, classes: np.ndarray, bits: int) -> DataFrame:
    """Per batch its entries (part -1), and for each hash range one summary per shingle: its smallest
    point, its members and the most shingles that follow it in one of them."""
    table = documents.sparkSession.sparkContext.broadcast(classes)  # fixed size

    def run(batches):
        task = TaskContext.get().partitionId()
        for number, got in enumerate(text_batches(batches, BATCH_BYTES)):
            e = Entries(Sets(got.column("text")), table.value)
            if not len(e.grams):
                continue
            name = f"{task}-{number}"
            rows = [(name, -1, None, e.points.tobytes(), pack32(e.sizes), pack32(e.at), pack32(e.place), pack32(e.members))]
            rest = np.maximum.reduceat(e.sizes[e.at] - e.place, e.heads)
            first = e.first
            borders = hash_borders(e.grams, bits)
            for r in range(1 << bits):
                a, b = borders[r], borders[r + 1]
                if a < b:
                    used, at = np.unique(first[a:b], return_inverse=True)
                    rows.append((name, r, pack(e.grams[a:b]), e.points[used].tobytes(), pack32(e.sizes[used]), pack32(at), pack32(rest[a:b]), pack32(e.members[a:b])))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SENT.split(", ")])

    def arrow(batches):
        schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32()}.get(t, pa.binary())) for n, t in (x.split() for x in SENT.split(", "))])
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    return stage(documents.select("doc_id", "text").mapInArrow(arrow, SENT), "jaccard-entries")


def _answers(frame: pd.DataFrame) -> pd.DataFrame:
    """For each batch's shingles of one range: which have members elsewhere, and their region."""
    grams = [unpack(x) for x in frame["grams"]]
    ends = np.cumsum([len(g) for g in grams])
    gram = np.concatenate(grams)
    del grams
    order = np.argsort(gram).astype(np.int32)
    gram = gram[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = gram[1:] != gram[:-1]
    del gram
    starts = np.flatnonzero(head).astype(np.int32)
    group = np.empty(len(order), dtype=np.int32)
    group[order] = np.cumsum(head, dtype=np.int32) - 1
    del head
    size = np.concatenate([unpack32(s)[unpack32(a)] for s, a in zip(frame["sizes"], frame["at"], strict=True)])
    least = np.minimum.reduceat(size[order], starts)
    point = np.concatenate([np.frombuffer(p, np.int64)[unpack32(a)] for p, a in zip(frame["points"], frame["at"], strict=True)])
    smallest = np.where(size == least[group], point, np.iinfo(np.int64).max)
    firsts = np.minimum.reduceat(smallest[order], starts)
    del size, smallest
    # a point that several batches hold is one member
    members = np.concatenate([unpack32(x) for x in frame["members"]])
    other = np.maximum.reduceat(members[order], starts) > 1
    other |= np.logical_or.reduceat((point != firsts[group])[order], starts)
    del members, point
    rest = np.concatenate([unpack32(x) for x in frame["places"]])
    most = np.maximum.reduceat(rest[order], starts)
    del rest, order
    out, at = [], 0
    for end in ends:
        mine = group[at:end]
        on = other[mine]
        mine = mine[on]
        out.append((np.packbits(on).tobytes(), firsts[mine].tobytes(), pack32(least[mine]), pack32(most[mine]), end - at))
        at = end
    answer = frame[["batch", "part"]].copy()
    for i, name in enumerate(("shared", "pivots", "least", "most", "count")):
        answer[name] = [x[i] for x in out]
    give_back()
    return answer


def outer_regions(entries: DataFrame) -> DataFrame:
    """(pivot, point, n, pivot_n, shared), distinct per batch: which points meet at which pivot point, and in how many
    of the outer regions."""
    summaries = entries.where("part >= 0")
    answers = summaries.groupBy("part").applyInPandas(
        _answers, "batch string, part int, shared binary, pivots binary, least binary, most binary, count long"
    )

    def meet(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(answers):
            return pd.DataFrame({"pivot": [], "point": [], "n": [], "pivot_n": [], "shared": []}).astype("int64")
        row, answers = own.iloc[0], answers.sort_values("part")
        points, sizes = np.frombuffer(row["points"], np.int64), unpack32(row["sizes"]).astype(np.int64)
        at, place, members = unpack32(row["at"]), unpack32(row["places"]).astype(np.int64), unpack32(row["members"]).astype(np.int64)
        shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c) for x, c in zip(answers["shared"], answers["count"], strict=True)]).astype(bool)
        pivots = np.concatenate([np.frombuffer(x, np.int64) for x in answers["pivots"]])
        least = np.concatenate([unpack32(x) for x in answers["least"]]).astype(np.int64)
        most = np.concatenate([unpack32(x) for x in answers["most"]]).astype(np.int64)
        times, here = members[shared], np.repeat(shared, members)
        pivot, least, most = np.repeat(pivots, times), np.repeat(least, times), np.repeat(most, times)
        at, place = at[here], place[here]
        n = sizes[at]
        able = (np.minimum(n - place, most) >= least_overlap(n, least)) & (points[at] != pivot)
        # pivots by number: a pivot has one size, so pivot and point make the key
        names, which = np.unique(pivot[able], return_inverse=True)
        size = np.zeros(len(names), dtype=np.int64)
        size[which] = least[able]
        found, shared = np.unique(which * len(points) + at[able], return_counts=True)
        pivot, point = np.divmod(found, max(1, len(points)))
        return pd.DataFrame({"pivot": names[pivot], "point": points[point], "n": sizes[point], "pivot_n": size[pivot], "shared": shared})

    own = entries.where("part = -1").select("batch", "points", "sizes", "at", "places", "members")
    return own.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(meet, "pivot long, point long, n long, pivot_n long, shared long")


class Region:
    """Points of one region in memory; links are found pivot by pivot."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n)])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every = every[order]
        head = np.ones(len(every), dtype=bool)
        head[1:] = every[1:] != every[:-1]
        self.codes = np.empty(len(order), dtype=np.int32)
        self.codes[order] = np.cumsum(head) - 1
        self.holders = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)[order]
        self.first = np.flatnonzero(head)
        self.uses = np.diff(np.append(self.first, len(every)))
        self.parent = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def overlaps(self, i: int) -> np.ndarray:
        """How many members of set i each set has."""
        mine = self.codes[self.starts[i] : self.starts[i + 1]]
        uses = self.uses[mine]
        ends = np.cumsum(uses)
        at = np.arange(ends[-1], dtype=np.int32) + np.repeat((self.first[mine] - (ends - uses)).astype(np.int32), uses)
        return np.bincount(self.holders[at], minlength=len(self.n))

    def compare(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of all points to point i, and which of them link to it; links are noted."""
        overlap = self.overlaps(i)
        union = self.n[i] + self.n - overlap
        linked = 100 * overlap >= PERCENT * union
        for j in np.flatnonzero(linked):
            a, b = self.root(i), self.root(int(j))
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((i, int(j)))
        return 1 - overlap / union, linked

    def settle(self) -> list[tuple[int, int]]:
        """Links that connect all linked points of the region."""
        radius = 1 - PERCENT / 100 + 1e-9
        open_points = np.ones(len(self.n), dtype=bool)
        covered: dict[int, np.ndarray] = {}
        for p in range(len(self.n)):
            if open_points[p]:
                _, linked = self.compare(p)
                mine = np.flatnonzero(linked & open_points)
                open_points[mine] = False
                if len(mine) > 1:
                    covered[p] = mine[mine != p]
        if len({self.root(i) for i in range(len(self.n))}) > 1:
            for p, mine in covered.items():
                distance, _ = self.compare(p)
                roots = np.array([self.root(i) for i in range(len(self.n))])
                for x in mine[np.argsort(-distance[mine])]:
                    # the window: only a point of another component this close to the pivot can link to x
                    if ((roots != roots[x]) & (distance <= distance[x] + radius)).any():
                        before = len(self.links)
                        self.compare(int(x))
                        if len(self.links) > before:
                            roots = np.array([self.root(i) for i in range(len(self.n))])
        return self.links


def row_id() -> Column:
    return F.xxhash64("doc_id", "text")


KEYS = ["pivot", "i", "j"]


def ship(documents: DataFrame, rows: DataFrame, members: DataFrame, classes: np.ndarray | None = None) -> DataFrame:
    """(pivot, i, j, point, n, last, grams): the sets of ``members`` (pivot, i, j, point), computed from the texts
    where they lie and sent once per membership; sorted by region within partitions.

    With ``classes`` only the first shingles in their order are sent, with 32 bits each, and the order's key
    of the last of them: enough for an upper bound of what two sets share."""
    table = documents.sparkSession.sparkContext.broadcast(classes)
    meets = members.groupBy("point").agg(F.collect_set(F.struct(*KEYS)).alias("meets"))
    chosen = rows.join(meets, "point").groupBy("point").agg(F.min("rid").alias("rid"), F.first("meets").alias("meets"))
    chosen = stage(chosen, "jaccard-chosen")
    listed = chosen.agg(F.sum(F.size("meets"))).first()[0] or 0  # the lists are what grows, so their entries are counted
    texts = documents.select(row_id().alias("rid"), "text").join(small(chosen, listed), "rid").select("point", "meets", "text")

    def run(batches):
        for got in text_batches(batches, BATCH_BYTES):
            sets = Sets(got.column("text"))
            lists = got.column("meets").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            owner, flat = pc.list_parent_indices(lists), lists.flatten()
            last = np.zeros(len(sets.sizes), dtype=np.int64)
            if table.value is None:
                blobs = [pack(sets.grams[a:b] >> np.uint64(SPARED)) for a, b in zip(sets.starts[:-1], sets.starts[1:], strict=True)]
            else:
                gram, at, _ = prefixes(sets, table.value)
                ends = np.searchsorted(at, np.arange(len(sets.sizes) + 1))
                some = np.flatnonzero(np.diff(ends))
                final = gram[ends[1:][some] - 1]
                last[some] = _order_key(final, table.value)
                blobs = [pack(np.sort(gram[a:b] >> np.uint64(32))) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            grams = pa.array(blobs, pa.binary())
            columns = {k: flat.field(k) for k in KEYS}
            columns |= {"point": got.column("point").take(owner).combine_chunks(), "n": pa.array(sets.sizes).take(owner), "last": pa.array(last).take(owner), "grams": grams.take(owner)}
            yield pa.RecordBatch.from_pydict(columns)

    sent = texts.mapInArrow(run, "pivot long, i long, j long, point long, n long, last long, grams binary")
    return sent.repartition(partitions(documents.sparkSession), *KEYS).sortWithinPartitions(*KEYS)


def _order_key(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Place of shingles in the order of prefixes; equal for shingles that are too close to tell apart."""
    return (classes[_slots(grams)].astype(np.int64) << 55) | (grams >> np.uint64(9)).astype(np.int64)


def _by_region(shipped: DataFrame, settle) -> DataFrame:
    """(a, b) of all regions, by ``settle(frame of one region)``; a task reads its regions one after the other."""

    def run(batches):
        held: list[pd.DataFrame] = []
        for frame in batches:
            same = np.ones(len(frame), dtype=bool)
            for k in KEYS:
                column = frame[k].to_numpy()
                same[1:] &= column[1:] == column[:-1]
                same[0] &= bool(held) and held[-1][k].iloc[-1] == column[0]
            borders = [0, *(i for i in np.flatnonzero(~same) if i), len(frame)]
            out = []
            for number, (start, end) in enumerate(zip(borders[:-1], borders[1:], strict=True)):
                if held and (number or not same[0]):
                    out += settle(pd.concat(held))
                    held = []
                held.append(frame.iloc[start:end])
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
            give_back()
        if held:
            yield pd.DataFrame(settle(pd.concat(held)), columns=["a", "b"]).astype("int64")

    return shipped.mapInPandas(run, "a long, b long")


def _star(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """Points within the radius of the region's pivot."""
    frame = frame.drop_duplicates("point")
    pivot = frame["pivot"].iloc[0]
    order = np.argsort(frame["point"].to_numpy() != pivot, kind="stable")
    points = frame["point"].to_numpy()[order]
    if len(points) < 2 or points[0] != pivot:
        return []
    _, linked = Region([unpack(x) for x in frame["grams"].to_numpy()[order]]).compare(0)
    return [(int(pivot), int(x)) for x in points[linked] if x != pivot]


def _whole(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """Links that connect all linked points of the region."""
    frame = frame.drop_duplicates("point").sort_values(["n", "point"])
    points = frame["point"].to_numpy()
    if len(points) < 2:
        return []
    found = Region([unpack(x) for x in frame["grams"]]).settle()
    return [(int(points[i]), int(points[j])) for i, j in found]


def _able(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """(pivot, point) of the points that may link to another one of the region.

    Of two sets, let the prefix of A end first in the common order. What A shares with B is in both prefixes,
    or in the rest of A. Hashes of 32 bits can only make the bound larger."""
    frame = frame.drop_duplicates("point")
    points, n, last = (frame[c].to_numpy() for c in ("point", "n", "last"))
    if len(points) < 2:
        return []
    parts = [unpack(x) for x in frame["grams"]]
    size = np.array([len(x) for x in parts])
    region = Region([np.unique(x) for x in parts])
    able = np.zeros(len(points), dtype=bool)
    for i in range(len(points)):
        shared = region.overlaps(i) + (size[i] - region.n[i])  # equal 32-bit hashes inside one set count as shared
        rest = np.where(last[i] <= last, n[i] - size[i], n - size)
        fits = shared + rest >= least_overlap(n[i], n)
        fits &= (4 * n >= 3 * n[i]) & (4 * n[i] >= 3 * n)
        fits[i] = False
        able |= fits
        able[i] |= fits.any()
    return [(int(frame["pivot"].iloc[0]), int(x)) for x in points[able]]


def nearest_pivots(documents: DataFrame, rows: DataFrame, regions: DataFrame, limit: int = REGION_SHINGLES) -> DataFrame:
    """(a, b): each point against the pivot that it shares the most outer regions with. A pivot with many
    points is sent to as many parts as they fill."""
    # the pivot is the smaller set; one below three quarters of the other's size can't link to it
    best = regions.where("100 * pivot_n >= %d * n" % PERCENT).groupBy("point").agg(F.max(F.struct("shared", "pivot", "n")).alias("best"))
    best = stage(best.select("point", "best.pivot", "best.n"), "jaccard-nearest")
    parts = best.groupBy("pivot").agg(F.ceil(F.sum("n") / limit).alias("parts"))
    dealt = best.join(small(parts), "pivot").select("pivot", F.pmod(F.xxhash64("point"), "parts").alias("i"), F.lit(0).cast("long").alias("j"), "point")
    pivots = parts.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.lit(0).cast("long").alias("j"), F.col("pivot").alias("point"))
    return stage(_by_region(ship(documents, rows, dealt.unionByName(pivots)), _star), "jaccard-links")


def _blocks(regions: DataFrame, limit: int) -> DataFrame:
    """(pivot, i, j, point): regions as they are, or, beyond ``limit`` shingles, as all pairs of their blocks."""
    sizes = regions.groupBy("pivot").agg(F.sum("n").alias("weight"))
    sizes = sizes.select("pivot", F.when(F.col("weight") > limit, F.ceil(F.col("weight") * 2 / limit)).otherwise(1).alias("blocks"))
    placed = regions.join(small(sizes), "pivot").withColumn("mine", F.pmod(F.xxhash64("point"), "blocks"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return meets.select("pivot", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "point")


def _near_sizes(regions: DataFrame) -> DataFrame:
    """The rows of ``regions`` that have another point of their region near enough in size to link. Sizes are
    counted first, so what is sorted of a pivot are its distinct sizes and not its points."""
    sizes = regions.groupBy("pivot", "n").agg(F.count("*").alias("points"))
    by_size = Window.partitionBy("pivot").orderBy("n")
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    near = (F.col("points") > 1) | (100 * before >= PERCENT * F.col("n")) | (100 * F.col("n") >= PERCENT * after)
    kept = sizes.withColumn("near", F.coalesce(near, F.lit(False))).where("near").select("pivot", "n")
    return regions.join(kept, ["pivot", "n"], "left_semi").select(*regions.columns)


def able_points(documents: DataFrame, rows: DataFrame, regions: DataFrame, classes: np.ndarray, limit: int = REGION_SHINGLES) -> DataFrame:
    """The rows (pivot, point, n) of ``regions`` whose point may link to another of its region, by prefixes alone."""
    found = _by_region(ship(documents, rows, _blocks(regions, 4 * limit), classes), _able).distinct()
    found = stage(found.select(F.col("a").alias("pivot"), F.col("b").alias("point")), "jaccard-able")
    return regions.join(small(found), ["pivot", "point"], "left_semi")


def inner_regions(documents: DataFrame, rows: DataFrame, regions: DataFrame, limit: int = REGION_SHINGLES) -> DataFrame:
    """(a, b): links that connect all linked points of each region (pivot, point, n). Regions beyond ``limit``
    are joined as pairs of blocks, each pair in a task of its own."""
    return stage(_by_region(ship(documents, rows, _blocks(regions, limit)), _whole), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """(point, component): the least point of each connected component, by large and small stars."""
    edges = stage(links.where("a != b").distinct(), "star-edges")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("least"))
        joined = down.join(low, "a")
        small_star = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(joined.select("a", F.col("least").alias("b")))
        edges = stage(small_star.where("a != b").distinct(), "star-edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if now == before:
            return edges.select(F.col("a").alias("point"), F.col("b").alias("component"))
        before = now


def classify(documents: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and component (a number for each group of rows with words; that
    of all rows without is 0) of each row of ``documents``."""
    rows, counts = describe(documents)
    total = int(counts.sum())
    bits = max(0, math.ceil(math.log2(max(1.0, total / 4 * 8 / RANGE_BYTES))))
    order = frequency_classes(counts)
    entries = send(documents, order, bits)
    regions = stage(outer_regions(entries).distinct(), "jaccard-regions")
    links = nearest_pivots(documents, rows, regions)
    # what one component holds already is settled; the other regions are joined in full
    labels = components(links)
    pivots = regions.select("pivot").distinct().select("pivot", F.col("pivot").alias("point"))
    own = pivots.join(rows.select("point", "n").distinct(), "point").select("pivot", "point", "n")
    all_rows = stage(regions.select("pivot", "point", "n").unionByName(own), "jaccard-regions")
    named = all_rows.join(small(labels), "point", "left").withColumn("component", F.coalesce("component", "point"))
    open_regions = named.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_regions = stage(open_regions.where("low != high").select("pivot"), "jaccard-open")
    open_rows = stage(_near_sizes(all_rows.join(small(open_regions), "pivot", "left_semi")), "jaccard-open-rows")
    left = able_points(documents, rows, open_rows, order)
    more = inner_regions(documents, rows, stage(left, "jaccard-left"))
    linked = components(links.unionByName(more))
    known = rows.join(small(linked), "point", "left").withColumn("component", F.coalesce("component", "point"))
    ids = known.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    joined = known.join(small(ids), "component", "left")
    mine = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("rid", "doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"), "component")
