"""Removal of repeated word windows, with a count-min sketch in front of the exact grouping.

A window is ``WINDOW`` consecutive words of one text. Each word goes that is covered by a window whose words
also start somewhere in a document of a smaller doc_id; windows are judged on the input.

1. ``word_batches``: texts become batches of word codes, written once. Everything later reads those.
2. ``sketches``: each batch counts its distinct windows in a count-min sketch of DEPTH rows. A sketch is cut
   into segments by the window's hash, and only its counters above zero are sent. ``merge`` adds the sketches of
   one segment and answers each batch which of its counters stand at two documents or more. A counter is
   never below the true count, so a repeated window is never lost; only the size of the sketch, which
   follows the number of windows, decides how many others come along.
3. ``candidates``: windows whose counters all stand at two or more are sent again with 96 bits of hash and the
   batch's smallest doc_id. ``group`` finds the smallest doc_id of each window over all batches and answers
   one bit for each: whether it lies below the batch's own.
4. ``deduplicate``: each batch marks its covered words and returns the rest.

A batch sends a window once, however often it occurs there, so a passage that a third of all texts share
costs one entry per batch and its group is spread over all segments by its windows' hashes. Messages
are never empty, so their number is bounded by that of the entries and not by batches times segments.
Words of a window are compared by hash: with n distinct windows, two of them collide somewhere with a chance
of n * n / 2**97 at most (a third of a millionth for 10**11 windows).

Null texts have no words. Texts shorter than a window keep all words. Rows of equal doc_id are no smaller
than one another; rows without a doc_id are neither smaller nor larger than any, they stay whole. Repeated rows
are returned as often as they occur. A text longer than a batch is a batch of its own.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import expand, mix, partitions, squeeze, text_batches, word_hashes

WINDOW = 50
#: Bytes of text in a batch.
BATCH_BYTES = 8 << 20
#: Rows of the sketch, and counters of each row per window of the corpus.
DEPTH, COUNTERS_PER_WINDOW = 2, 4
#: Windows of the corpus per segment.
SEGMENT_WINDOWS = 1 << 22
#: Multipliers of the two window hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

BATCHES = "batch string, ids binary, missing binary, lens binary, codes binary, words binary, windows long"
_KEPT_COLUMNS = ["batch", "ids", "missing", "lens", "codes", "words"]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, codes of all words, and words per text; words lie between ASCII white space."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = parts.flatten()
    keep = pc.not_equal(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(parts).filter(keep)
    coded = flat.filter(keep).dictionary_encode()
    lens = np.bincount(owner.to_numpy(zero_copy_only=False), minlength=len(texts))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), lens


def word_batches(documents: DataFrame, window: int) -> DataFrame:
    """Texts as batches of about BATCH_BYTES; staged, since every later step reads them again."""

    def run(batches):
        for t in text_batches(batches, BATCH_BYTES):
            ids, texts = t.column(0).combine_chunks(), t.column(1).combine_chunks()
            words, codes, lens = _words(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks))
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            row = {
                "batch": uuid.uuid4().hex, "ids": squeeze(ids.fill_null(0).to_numpy(zero_copy_only=False)),
                "missing": np.packbits(missing).tobytes(), "lens": squeeze(lens), "codes": squeeze(codes),
                "words": zstandard.compress("\n".join(words.to_pylist()).encode("utf-8", "surrogatepass"), 3),
                "windows": int(np.maximum(lens - window + 1, 0).sum()),
            }
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema(
        [("batch", pa.string()), *((n, pa.binary()) for n in ("ids", "missing", "lens", "codes", "words")), ("windows", pa.int64())]
    )
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(chosen.mapInArrow(run, BATCHES), "substring-batches")


def _rolled(hashes: np.ndarray, base: int, n: int) -> np.ndarray:
    """Polynomial hash of the ``n`` values from each place on, by doubling; the last n-1 places are missing."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    total, length = None, 0
    block, size = hashes, 1
    while True:
        if n & size:  # blocks of all powers of two in n, one after the other
            if total is None:
                total = block.copy()
            else:
                width = len(hashes) - length - size + 1
                total = total[:width] * np.uint64(pow(base, size, 1 << 64)) + block[length : length + width]
            length += size
        if length == n:
            return mix(total)
        block = block[:-size] * np.uint64(pow(base, size, 1 << 64)) + block[size:]
        size *= 2


class Batch:
    """One batch: its distinct windows in the order of their hashes."""

    def __init__(self, row: dict, window: int):
        self.lens, self.codes = expand(row["lens"]), expand(row["codes"])
        blob = zstandard.decompress(row["words"]).decode("utf-8", "surrogatepass")
        self.words = pa.array(blob.split("\n") if blob else [], pa.large_string())
        self.missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(self.lens)).astype(bool)
        self.ids, self.window = expand(row["ids"]), window
        self.starts = np.concatenate([[0], np.cumsum(self.lens)]).astype(np.int64)
        hashes = word_hashes(self.words)[self.codes] if len(self.codes) else np.empty(0, np.uint64)
        #: places where a window of a document that has an id starts, and the number of that document
        whole = np.maximum(self.lens - window + 1, 0) * ~self.missing
        self.owner = np.repeat(np.arange(len(self.lens)), whole)
        self.at = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole) + self.starts[:-1][self.owner]
        first, second = (_rolled(hashes, b, window)[self.at] for b in _BASES)
        order = np.lexsort((self.ids[self.owner], second, first))
        self.at, self.owner, first, second = self.at[order], self.owner[order], first[order], second[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.which = np.cumsum(new) - 1
        #: of each distinct window: both hashes, its smallest doc_id, and whether another id has it too
        self.first, self.second, self.least = first[new], second[new], self.ids[self.owner[new]]
        self.several = np.zeros(len(self.first), dtype=bool)
        self.several[self.which[self.ids[self.owner] != self.least[self.which]]] = True

    def segments(self, count: int) -> np.ndarray:
        """Borders of the segments among the distinct windows."""
        tops = [((i << 64) + count - 1) // count for i in range(1, count)]
        inner = np.searchsorted(self.first, np.array(tops, dtype=np.uint64)) if tops else []
        return np.concatenate([[0], inner, [len(self.first)]]).astype(np.int64)


def _cells(batch: Batch, part: slice, row: int, width: int) -> np.ndarray:
    """Counters that the windows of one segment hit in one row of the sketch."""
    source = batch.first if row == 0 else batch.second
    return (mix(source[part] + np.uint64(row)) & np.uint64(width - 1)).astype(np.int64)


def _rows_of(frames):
    for table in frames:
        for row in table.to_pylist():
            yield row


def sketches(batches: DataFrame, window: int, segments: int, width: int) -> DataFrame:
    """(segment, batch, row, cells, several): each batch's counters above zero, and which stand above one."""
    schema = pa.schema([("segment", pa.int32()), ("batch", pa.string()), ("row", pa.int32()), ("cells", pa.binary()), ("several", pa.binary())])

    def run(frames):
        for row in _rows_of(frames):
            batch, out = Batch(row, window), []
            borders = batch.segments(segments)
            for s in np.flatnonzero(np.diff(borders)):
                part = slice(borders[s], borders[s + 1])
                for r in range(DEPTH):
                    cells, back = np.unique(_cells(batch, part, r, width), return_inverse=True)
                    sums = np.bincount(back, weights=1 + batch.several[part], minlength=len(cells))
                    out.append((int(s), row["batch"], r, squeeze(np.diff(cells, prepend=0)), np.packbits(sums > 1).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return batches.select(*_KEPT_COLUMNS).mapInArrow(run, "segment int, batch string, row int, cells binary, several binary")


def merge(sent: DataFrame, width: int) -> DataFrame:
    """The sketches of a segment added up; each batch learns which of its counters stand at two or more."""

    def run(table: pa.Table) -> pa.Table:
        rows = table["row"].to_numpy()
        cells, several = table["cells"].to_pylist(), table["several"].to_pylist()
        bits = [b""] * len(rows)
        for r in range(DEPTH):
            counters = np.zeros(width, dtype=np.uint8)
            mine = np.flatnonzero(rows == r)
            for i in mine:
                hit = np.cumsum(expand(cells[i]))
                more = np.unpackbits(np.frombuffer(several[i], np.uint8), count=len(hit))
                counters[hit] = np.minimum(counters[hit] + 1 + more, 2)
            for i in mine:
                bits[i] = np.packbits(counters[np.cumsum(expand(cells[i]))] > 1).tobytes()
        return pa.table(
            {"batch": table["batch"], "kind": table["row"], "segment": table["segment"], "bits": pa.array(bits, pa.binary())}
        )

    return stage(sent.groupBy("segment").applyInArrow(run, ANSWER), "substring-sketch")


ANSWER = "batch string, kind int, segment int, bits binary"
#: Kind of the answers of the exact step; those of the sketch are its row numbers.
EXACT = -1


def _answers(table: pa.Table) -> dict[int, dict[int, bytes]]:
    found: dict[int, dict[int, bytes]] = defaultdict(dict)
    for kind, segment, bits in zip(*(table[c].to_pylist() for c in ("kind", "segment", "bits")), strict=True):
        found[kind][segment] = bits
    return found


def _repeated(batch: Batch, part: slice, segment: int, width: int, found: dict[int, dict[int, bytes]]) -> np.ndarray:
    """Windows of a segment whose counters all stand at two or more, as places among the batch's windows."""
    fine = np.ones(part.stop - part.start, dtype=bool)
    for r in range(DEPTH):
        cells, back = np.unique(_cells(batch, part, r, width), return_inverse=True)
        fine &= np.unpackbits(np.frombuffer(found[r][segment], np.uint8), count=len(cells)).astype(bool)[back]
    return part.start + np.flatnonzero(fine)


def candidates(batches: DataFrame, answers: DataFrame, window: int, segments: int, width: int) -> DataFrame:
    """(segment, batch, first, second, least, ids): windows that may be repeated, with the batch's smallest doc_id."""
    names = ["segment", "batch", "first", "second", "least", "ids"]
    schema = pa.schema([("segment", pa.int32()), ("batch", pa.string()), *((n, pa.binary()) for n in names[2:])])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        found, out = _answers(known), []
        for row in rows.to_pylist():
            batch = Batch(row, window)
            borders = batch.segments(segments)
            for s in np.flatnonzero(np.diff(borders)):
                here = _repeated(batch, slice(borders[s], borders[s + 1]), s, width, found)
                if len(here):
                    ids, number = np.unique(batch.least[here], return_inverse=True)
                    first = np.diff(batch.first[here], prepend=np.uint64(0)).view(np.int64)
                    second = (batch.second[here] >> np.uint64(32)).astype("<u4").tobytes()
                    out.append((int(s), row["batch"], squeeze(first), second, squeeze(number), squeeze(np.diff(ids, prepend=0))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return (
        batches.select(*_KEPT_COLUMNS).groupBy("batch").cogroup(answers.groupBy("batch"))
        .applyInArrow(run, "segment int, batch string, first binary, second binary, least binary, ids binary")
    )


def group(sent: DataFrame) -> DataFrame:
    """Exact groups of equal windows: one bit per entry, whether a document of a smaller doc_id has it."""

    def run(table: pa.Table) -> pa.Table:
        first = [np.cumsum(expand(x).view(np.uint64), dtype=np.uint64) for x in table["first"].to_pylist()]
        ends = np.cumsum([len(x) for x in first])
        second = np.frombuffer(b"".join(table["second"].to_pylist()), "<u4")
        least = np.concatenate(
            [np.cumsum(expand(i))[expand(n)] for i, n in zip(table["ids"].to_pylist(), table["least"].to_pylist(), strict=True)]
        )
        first = np.concatenate(first)
        order = np.lexsort((least, second, first))
        a, b = first[order], second[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        smallest = least[order][new][np.cumsum(new) - 1]
        below = np.empty(len(order), dtype=bool)
        below[order] = smallest < least[order]
        bits = [np.packbits(x).tobytes() for x in np.split(below, ends[:-1])]
        kind = pa.array(np.full(len(bits), EXACT, dtype=np.int32))
        return pa.table({"batch": table["batch"], "kind": kind, "segment": table["segment"], "bits": pa.array(bits, pa.binary())})

    return stage(sent.groupBy("segment").applyInArrow(run, ANSWER), "substring-groups")


def _covered(batch: Batch, segments: int, width: int, found: dict[int, dict[int, bytes]]) -> np.ndarray:
    """Which words of the batch lie in a window that a smaller doc_id has too."""
    below = np.zeros(len(batch.first), dtype=bool)
    maybe = np.zeros(len(batch.first), dtype=bool)
    borders = batch.segments(segments)
    for s in np.flatnonzero(np.diff(borders)):
        here = _repeated(batch, slice(borders[s], borders[s + 1]), s, width, found)
        if len(here):
            maybe[here] = True
            below[here] = np.unpackbits(np.frombuffer(found[EXACT][s], np.uint8), count=len(here)).astype(bool)
    gone = below[batch.which] | (maybe[batch.which] & (batch.ids[batch.owner] > batch.least[batch.which]))
    marks = np.zeros(len(batch.codes) + 1, dtype=np.int64)
    np.add.at(marks, batch.at[gone], 1)
    np.add.at(marks, batch.at[gone] + batch.window, -1)
    return np.cumsum(marks[:-1]) > 0


CLEANED = "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string"


def deduplicate(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, the removed word ranges [start, end) and the kept words joined by one space."""
    spark = documents.sparkSession
    batches = word_batches(documents, window)
    windows = batches.agg(F.sum("windows")).first()[0] or 0
    segments = max(2 * partitions(spark), -(-windows // SEGMENT_WINDOWS))
    width = 1 << max(6, (COUNTERS_PER_WINDOW * -(-windows // segments) - 1).bit_length())
    seen = merge(sketches(batches, window, segments, width), width)
    below = group(candidates(batches, seen, window, segments, width))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("removed", pa.list_(span)), ("kept", pa.string())])

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        found, out = _answers(known), []
        for row in rows.to_pylist():
            batch = Batch(row, window)
            gone = _covered(batch, segments, width, found)
            owner = np.repeat(np.arange(len(batch.lens)), batch.lens)
            # kept words joined text by text
            stay = np.flatnonzero(~gone)
            borders = np.concatenate([[0], np.cumsum(np.bincount(owner[stay], minlength=len(batch.lens)))])
            words = batch.words.take(pa.array(batch.codes[stay])) if len(stay) else pa.array([], pa.large_string())
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(borders, pa.int32()), words), pa.scalar(" ", pa.large_string())).cast(pa.string())
            # a range starts where a covered word follows one that isn't, or a new text
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            head = np.zeros(len(gone) + 1, dtype=bool)
            head[batch.starts] = True
            inner = head[:-1] & gone
            begin = np.flatnonzero((edge[:-1] == 1) | inner)
            both = np.append(gone, False)
            stop = np.flatnonzero(((edge == -1) | (head & both)) & np.append(False, gone))
            of = owner[begin]
            spans = pa.StructArray.from_arrays(
                [pa.array(begin - batch.starts[of]), pa.array(stop - batch.starts[of])], fields=list(span)
            )
            places = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(batch.lens)))])
            ids = pa.array(batch.ids, mask=batch.missing)
            removed = pa.ListArray.from_arrays(pa.array(places, pa.int32()), spans)
            out.append(pa.Table.from_arrays([ids, pa.array(batch.lens), removed, kept], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    texts = batches.select(*_KEPT_COLUMNS)
    return texts.groupBy("batch").cogroup(seen.unionByName(below).groupBy("batch")).applyInArrow(run, CLEANED)
