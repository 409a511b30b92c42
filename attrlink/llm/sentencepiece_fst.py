"""SentencePiece encoding and decoding as a weighted transducer.

``compile_model`` turns a model file into three parts that are composed with each text: the
normaliser (the model's table of rewrites, longest first; spaces; the meta symbol), the piece automaton (a trie
over characters) and byte fallback (characters outside every piece become three-digit byte pieces). The answer is
the tropical shortest path through (position, last piece).

Unigram models weigh an arc by the negated score of its piece. BPE models weigh it 0 if the piece may
follow the last one and infinity if not: two pieces may stand side by side exactly if merging their
joined text gives the two back. With these weights the one path of finite weight is the result of the
merges, so each prefix needs one last piece only (checked against the public library in the tests).

No piece crosses from other characters into the meta symbol, nor a character that only its own piece holds, so the
lattice falls apart into chunks at those places (found at compile time from the pieces). Equal chunks are solved once.

Null texts have no pieces, like empty ones. The ids of every text are decoded, and ``exact`` says whether that gave
the text itself: not where the normaliser changed it, where it holds the meta symbol (a space when decoded) or where
a piece was unknown. Repeated rows give equal rows. Characters without a piece fall back to their UTF-8 bytes, or to
one unknown piece for a run of them where the model has no byte pieces.
"""

from __future__ import annotations

import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

META = "▁"
#: Texts whose ids a worker holds at once.
ENCODED_TEXTS = 512
_MODELS: dict[str, "Model"] = {}


def default_model() -> str:
    """The model file of the installed public vocabularies; any other path may be passed instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            size = varint()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _rewrites(table: bytes) -> dict[str, str]:
    """The rewrites of a normalisation table: a double-array trie over UTF-8 bytes whose leaves point at texts."""
    if not table:
        return {}
    size = int.from_bytes(table[:4], "little")
    units, texts = np.frombuffer(table[4 : 4 + size], dtype="<u4").astype(np.int64), table[4 + size :]
    jump = (units >> 10) << ((units & (1 << 9)) >> 6)
    found: dict[str, str] = {}
    level, byte = [(int(jump[0]), b"")], np.arange(1, 256)
    while level:
        after = []
        for start in range(0, len(level), 4096):
            part = level[start : start + 4096]
            at = np.array([node for node, _ in part])[:, None] ^ byte
            here = units[np.minimum(at, len(units) - 1)]
            for row, column in zip(*np.nonzero((at < len(units)) & ((here & 0x800000FF) == byte)), strict=True):
                node, key = int(at[row, column]), part[row][1] + bytes([byte[column]])
                below = node ^ int(jump[node])
                if units[node] >> 8 & 1:
                    text = int(units[below]) & 0x7FFFFFFF
                    found[key.decode("utf-8")] = texts[text : texts.index(b"\0", text)].decode("utf-8")
                after.append((below, key))
        level = after
    return found


class Normaliser:
    """The first transducer: rewrites of a table (the longest that fits, from the left), then extra spaces."""

    def __init__(self, rewrites: dict[str, str], squeeze: bool):
        self.rewrites, self.squeeze = rewrites, squeeze
        self.reach: dict[str, int] = {}
        for key in rewrites:
            self.reach[key[0]] = max(self.reach.get(key[0], 0), len(key))
        one_of = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        longer = [k for k in rewrites if len(k) > 1]
        parts = [one_of({k for k in rewrites if len(k) == 1})] if len(longer) < len(rewrites) else []
        parts += [f"{one_of({k[0] for k in longer})}(?={one_of({k[1] for k in longer})})"] if longer else []
        #: Where a rewrite may begin.
        self.start = re.compile("|".join(parts)) if parts else None

    def __call__(self, text: str) -> str:
        if not self.start and not self.squeeze:
            return text
        out, end = [], ""

        def put(part: str, whole: bool):
            nonlocal end
            if self.squeeze:
                part = re.sub("  +", " ", part) if not whole else part
                part = part.lstrip(" ") if end in ("", " ") else part
            if part:
                out.append(part)
                end = part[-1]

        at = 0
        while at < len(text):
            hit = self.start.search(text, at) if self.start else None
            place = hit.start() if hit else len(text)
            if place > at:
                put(text[at:place], False)
            at = place
            if hit:
                size = next((n for n in range(self.reach[text[at]], 0, -1) if text[at : at + n] in self.rewrites), 0)
                put(self.rewrites[text[at : at + size]] if size else text[at], True)
                at += size or 1
        return "".join(out)


class Model:
    """A compiled model: pieces, byte pieces, the legal neighbours, and a cache of solved chunks."""

    CACHE, PAIRS = 300_000, 1_000_000

    def __init__(self, data: bytes):
        pieces, self.bpe, normal, trained = [], False, {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                score = np.frombuffer(f.get(2, b"\0\0\0\0"), dtype="<f4")[0]
                pieces.append((f.get(1, b"").decode("utf-8"), float(score), f.get(3, 1)))
            elif number == 2:
                trained = dict(_fields(value))
                self.bpe = trained.get(3, 1) == 2
            elif number == 3:
                normal = dict(_fields(value))
            elif number == 5 and dict(_fields(value)).get(2):
                raise ValueError("models that normalise decoded texts are not supported")
        if trained.get(24, 0) or not normal.get(5, 1):
            raise ValueError("models with spaces at the ends of words or without the meta symbol are not supported")
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.normal = Normaliser(_rewrites(normal.get(2, b"")), self.squeeze)
        self.score = [s for _, s, _ in pieces]
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == 2)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.value = {i: b for b, i in self.byte.items()}
        #: What each id stands for in a decoded text.
        unknown = trained.get(44, " ⁇ ".encode())
        self.raw_of = [
            bytes([self.value[i]]) if kind == 6 else b"" if kind == 3 else unknown if kind == 2 else p.replace(META, " ").encode()
            for i, (p, _, kind) in enumerate(pieces)
        ]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        #: Pieces that lose their space at the start of a text.
        self.spaced = {i for p, i in self.ids.items() if p.startswith(META)}
        self.longest = max(map(len, self.ids), default=1)
        #: The longest piece that starts with four given characters; without an entry it has three at most.
        self.reach: dict[str, int] = {}
        for piece in self.ids:
            if len(piece) > 3:
                self.reach[piece[:4]] = max(self.reach.get(piece[:4], 0), len(piece))
        crossing = any(re.search(f"[^{META}]{META}", p) for p in self.ids)
        #: Characters of no piece but their own; no piece crosses them either.
        alone = {chr(c) for c in range(128)}.difference(*(p for p in self.ids if len(p) > 1))
        alone = "".join(map(re.escape, sorted(alone)))
        between = f"|[{alone}]+" if alone else ""
        self.cut = None if crossing else re.compile(f"{META}*[^{META}{alone}]+|{META}+{between}")
        self.least = min(self.score, default=0.0) - 10.0
        #: Solved chunks, their ids as 32-bit integers in one piece of memory.
        self.solved: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fits = lru_cache(maxsize=None)(self._fits)

    def merged(self, text: str) -> tuple[str, ...]:
        """Merge neighbours, best score first and leftmost among equals; used on piece pairs only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                return tuple(parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ((left, right) if left else (right,))

    def lattice_path(self, chunk: str) -> list[str]:
        """The one path of finite weight: depth first from the left, longest arcs first. A state is a place
        and the last piece; states from which no path leads on are remembered."""
        n, ids, reach, fits = len(chunk), self.ids, self.reach.get, self.fits
        pieces: list[str] = []
        dead: set[tuple[int, str]] | None = None
        at, last, size = 0, "", reach(chunk[:4], 3)
        while at < n:
            if size > n - at:
                size = n - at
            while size:
                piece = chunk[at : at + size]
                if (piece in ids or size == 1) and fits(last, piece) and (dead is None or (at + size, piece) not in dead):
                    pieces.append(piece)
                    at, last = at + size, piece
                    size = reach(chunk[at : at + 4], 3)
                    break
                size -= 1
            else:
                dead = dead or set()
                dead.add((at, last))
                size = len(pieces.pop()) - 1
                at -= size + 1
                last = pieces[-1] if pieces else ""
        return pieces

    def cheapest_path(self, chunk: str) -> list[str]:
        """The path of the least sum of negated scores."""
        n = len(chunk)
        cost, back = [0.0] + [np.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                piece = chunk[start:end]
                weight = -self.score[self.ids[piece]] if piece in self.ids else -self.least if end - start == 1 else np.inf
                if cost[start] + weight < cost[end]:
                    cost[end], back[end] = cost[start] + weight, start
        pieces, at = [], n
        while at:
            pieces.append(chunk[back[at] : at])
            at = back[at]
        return pieces[::-1]

    def path(self, chunk: str) -> tuple[int, ...]:
        """Ids of the shortest path over a normalised chunk."""
        pieces = self.lattice_path(chunk) if self.bpe else self.cheapest_path(chunk)
        found = tuple(map(self.ids.get, pieces))
        if None not in found:
            return found
        out: list[int] = []
        for piece, number in zip(pieces, found, strict=True):
            if number is not None:
                out.append(number)
            elif self.byte:
                out.extend(self.byte[b] for b in piece.encode("utf-8", "surrogatepass"))
            elif out[-1:] != [self.unknown]:
                out.append(self.unknown)
        return tuple(out)

    def solve(self, chunk: str) -> bytes:
        """A chunk that is not among the recent ones; two generations of solved chunks are kept."""
        found = self.older.get(chunk)
        if found is None:
            path = self.path(chunk)
            found = pack(f"={len(path)}i", *path)
        if len(chunk) <= 64:
            if len(self.solved) >= self.CACHE:
                self.older, self.solved = self.solved, {}
                if self.fits.cache_info().currsize > self.PAIRS:
                    self.fits.cache_clear()
            self.solved[chunk] = found
        return found

    def forget(self) -> None:
        """Drop what was solved, keep what was compiled. Chunks and pairs go together: the entries of one lie among
        those of the other, and a page that still holds a living entry can't go back to the system."""
        self.solved, self.older = {}, {}
        self.fits.cache_clear()

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        normal = (META if self.prefix else "") + self.normal(text).replace(" ", META)
        if self.squeeze:
            normal = normal.rstrip(META)
        return self.cut.findall(normal) if self.cut else [normal] if normal else []

    def encode(self, text: str | None) -> list[int]:
        return self.encode_exact(text)[0]

    def encode_exact(self, text: str | None) -> tuple[list[int], bool]:
        """Ids, and whether decoding them gives the text back."""
        ids, exact = self.encode_packed(text)
        return np.frombuffer(ids, np.int32).tolist(), exact

    def encode_packed(self, text: str | None) -> tuple[bytes, bool]:
        """The same with the ids as 32-bit integers."""
        chunks = self.chunks(text)
        found = list(map(self.solved.get, chunks))
        if None in found:
            found = [self.solve(c) if x is None else x for c, x in zip(chunks, found, strict=True)]
        packed = b"".join(found)
        if not self.byte:
            ids = np.frombuffer(packed, np.int32)
            again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            packed = ids[np.append(True, ~again)[: len(ids)]].tobytes()
        return packed, self.decode(memoryview(packed).cast("i")) == (text or "")

    def decode(self, ids) -> str:
        skip = 0
        for i in ids if self.prefix or self.squeeze else ():
            skip += i in self.spaced
            if self.raw_of[i] and not (self.squeeze and self.raw_of[i] == b" "):
                break
            if skip and not self.squeeze:
                break
        return b"".join(map(self.raw_of.__getitem__, ids))[skip:].decode("utf-8", "replace")


def compile_model(data: bytes) -> Model:
    """One compiled model per worker process and model content."""
    key = str(hash(data))
    if key not in _MODELS:
        _MODELS[key] = Model(data)
    return _MODELS[key]


def encode(documents: DataFrame, data: bytes, keep: list[str], forget: bool = False) -> DataFrame:
    """``keep`` columns, ``ids`` array<int>, ``n_pieces`` and ``exact`` (decoding gives the text back).

    ``data`` is the model file's content (half a megabyte): the driver reads the path, as only the
    driver is sure to see it, and each task gets the bytes. ``forget``: a task leaves no solved chunks in its worker,
    for jobs whose workers go on to other steps; the next task solves its chunks anew."""
    send = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        model = compile_model(send.value)
        try:
            yield from encoded(model, batches)
        finally:
            if forget:
                model.forget()
                give_back()

    def encoded(model, batches):
        for whole in batches:
            for start in range(0, whole.num_rows, ENCODED_TEXTS):
                batch = whole.slice(start, ENCODED_TEXTS)
                texts = batch.column(batch.num_columns - 1)
                ids, ends, exact = [], [0], []
                total = 0
                for text in texts.to_pylist():
                    got, same = model.encode_packed(text)
                    ids.append(got)
                    total += len(got) // 4
                    ends.append(total)
                    exact.append(same)
                flat = np.frombuffer(b"".join(ids), np.int32)
                arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
                arrays.append(pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat)))
                arrays.append(pa.array(np.diff(ends).astype(np.int64)))
                arrays.append(pa.array(exact, pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "ids", "n_pieces", "exact"])
            give_back()

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in documents.select(*keep).schema)
    return documents.select(*keep, F.col("text").alias("__text")).mapInArrow(
        run, f"{schema}, ids array<int>, n_pieces long, exact boolean"
    )


def decode(encoded: DataFrame, data: bytes) -> DataFrame:
    """``encoded`` with ``text`` from its ``ids``; null ids give null."""
    send = encoded.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        model = compile_model(send.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            text = pa.array([None if x is None else model.decode(x) for x in ids], pa.string())
            yield batch.append_column("text", text)

    plain = encoded.drop("text")
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in plain.schema)
    return plain.mapInArrow(run, f"{schema}, text string")
