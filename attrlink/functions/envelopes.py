"""What a block of values or vectors has at most, and how well two blocks can match at best.

An envelope describes all members of a block. ``bounds`` compares lists of envelopes and never falls below the
score of any pair of members, so blocks that can't reach a wanted score are left out without loss.
"""

from __future__ import annotations

import io
import zlib

import numpy as np

from .kernels import PATTERN_POINTS, ROUNDING, Features

#: Slots that characters are folded into, and bits of the sets of tokens and spellings.
CHAR_SLOTS, SET_BITS = 64, 8192


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    with io.BytesIO() as file:
        np.savez(file, **arrays)
        return file.getvalue()


def unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """One stacked array for each name, from blobs of equal names and shapes."""
    parts = [np.load(io.BytesIO(b)) for b in blobs]
    return {name: np.stack([p[name] for p in parts]) for name in parts[0].files}


def _set(members) -> np.ndarray:
    bits = np.zeros(SET_BITS, dtype=bool)
    for m in members:
        bits[zlib.crc32(m.encode("utf-8", "surrogatepass")) % SET_BITS] = True
    return np.packbits(bits)


def of_texts(values: list[str]) -> bytes:
    """Envelope of a block of values."""
    f = Features(values)
    chars = np.zeros((len(values), CHAR_SLOTS), dtype=np.int32)
    for row, value in enumerate(values):
        for c in value:
            chars[row, ord(c) % CHAR_SLOTS] += 1
    return packed({
        "chars": chars.max(axis=0), "size": np.array([f.size.min(), f.size.max(), f.distinct_size.min()]),
        "tokens": _set({t for tokens in f.tokens for t in tokens}), "numbers": _set(str(n) for n in set(f.number_count.tolist())),
        "same": _set(f.spelling("same")), "bare": _set(f.spelling("bare")), "digits": _set(f.spelling("digits")),
    })


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two sets may have a member in common, for all pairs."""
    return np.stack([(row & b).any(axis=1) for row in a])


def text_bounds(blobs_a: list[bytes], blobs_b: list[bytes], full: bool = False) -> np.ndarray:
    """Upper bounds of the best pair score of blocks: the counterpart of ``kernels.ceilings``.

    A common subsequence has of no character more than both blocks have in any one value. Ratios grow with it and
    fall with the lengths. Token sets score otherwise only if the blocks share a token."""
    a, b = unpacked(blobs_a), unpacked(blobs_b)
    common = np.stack([np.minimum(row, b["chars"]).sum(axis=1) for row in a["chars"]]).astype(float)
    (a_min, a_max, a_set), (b_min, b_max, b_set) = a["size"].T, b["size"].T
    common = np.minimum(common, np.minimum.outer(a_max, b_max))
    short = np.minimum.outer(a_min, b_min)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.where(short + common > 0, 200 * np.minimum(common, short) / (short + np.minimum(common, short)), 0)
        words = np.where(np.add.outer(a_set, b_set) > 0, 200 * common / np.add.outer(a_set, b_set), 0)
        best = np.maximum(np.where(common >= short, 100 * (common > 0), whole), np.minimum(words, 100))
        if full:
            part = lambda n: np.minimum(common / np.maximum(n, 1), 1)
            jaro = (part(a_min[:, None]) + part(b_min[None, :]) + 1) / 3
            best = np.maximum(best, 100 * np.where(jaro > 0.7, jaro + 0.4 * (1 - jaro), jaro))
    empty = (a_set == 0)[:, None] & (b_set == 0)[None, :]
    best[_meet(a["tokens"], b["tokens"]) | empty] = 100
    points = PATTERN_POINTS
    pattern = (
        points["unit"] * _meet(a["numbers"], b["numbers"]) + points["equal"] * _meet(a["same"], b["same"])
        + points["punctuation"] * _meet(a["bare"], b["bare"]) + points["number_format"] * _meet(a["digits"], b["digits"])
    )
    return np.maximum(best, pattern) + ROUNDING


def of_vectors(x: np.ndarray) -> bytes:
    """Envelope of a block of vectors: the ball around their mean."""
    center = x.mean(axis=0)
    return packed({"center": center, "radius": np.linalg.norm(x - center, axis=1).max()})


def vector_bounds(blobs_a: list[bytes], blobs_b: list[bytes]) -> np.ndarray:
    """Upper bounds of the dot product (times 100) of any two members of two balls."""
    a, b = unpacked(blobs_a), unpacked(blobs_b)
    return ball_bounds(a["center"], a["radius"], b["center"], b["radius"])


def ball_bounds(centers_a: np.ndarray, radii_a: np.ndarray, centers_b: np.ndarray, radii_b: np.ndarray) -> np.ndarray:
    norm_a, norm_b = np.linalg.norm(centers_a, axis=1), np.linalg.norm(centers_b, axis=1)
    reach = np.outer(norm_a, radii_b) + np.outer(radii_a, norm_b) + np.outer(radii_a, radii_b)
    best = centers_a @ centers_b.T + reach
    return 100 * best + 1e-5 + 1e-9 * np.abs(best)


def nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest center of each vector, and the squared distance to it."""
    far = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def packed_block(row: dict) -> tuple[np.ndarray, ...]:
    """Vectors, ends of the runs, their centers and radii of a packed row."""
    ends, radii = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["radii"])
    n, runs = int(ends[-1]), len(ends)
    return np.frombuffer(row["vectors"]).reshape(n, -1), ends, np.frombuffer(row["centers"]).reshape(runs, -1), radii
