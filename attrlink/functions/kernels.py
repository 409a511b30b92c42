"""Numpy scoring of batches of string pairs.

These helpers run inside Spark tasks (grouped-map and pandas UDF bodies). Spark partitions the
work into bounded batches; a batch is scored column-wise: one numpy step advances every pair by
one character, so no Python code runs per pair except for values longer than one machine word.

All scores are 0..100.  ``200.0 * lcs / (n + m)`` is the common form of the subsequence ratio.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd

from . import trees

WORD = 64
ONE = np.uint64(1)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)

# The score names, in the order that breaks ties between equal best scores.
SCORES = (
    "ratio",
    "partial_ratio",
    "token_sort_ratio",
    "token_set_ratio",
    "jaro_winkler",
    "levenshtein",
    "pattern",
)
# The same for the per-key profile.
PROFILED_SCORES = (
    "ratio",
    "partial_ratio",
    "token_sort_ratio",
    "token_set_ratio",
    "pattern",
    "multiplier_unit",
)
# Points of the pattern score, number pattern, accepted range of number quotients.
PATTERN_POINTS = {"unit": 30, "equal": 20, "punctuation": 15, "number_format": 25}
PROFILED_PATTERN_POINTS = {"equal": 30, "letters": 25, "multipliers": 20, "numbers": 15}
MULTIPLIER_UNIT_POINTS = {"multipliers": 40, "units": 30, "numbers": 30}
NUMBER = re.compile(r"\d+\.?\d*")
QUOTIENT_RANGE = (0.1, 10.0)
NUMBER_TOLERANCE = 0.001
# Bounds are single precision; this much is added so that rounding never drops a pair.
ROUNDING = 0.001
# Presets from which on trees look for the pairs worth scoring; queries and presets that are compared without them at once.
TREES_FROM, PART = 512, (1024, 4096)
# What trees ask for first, and by how much they ask for less while a query has too few hits; no pattern score is above
# LEAST_ASKED unless spellings are equal.
ASKED_FIRST, ASKED_STEP, LEAST_ASKED = 96.0, 3.0, 55.0
# Nodes that trees may look at for one time of asking, as a share of all pairs.
TREE_SHARE = 1.0
# Promising pairs per query that are scored first, to learn how good its best matches are: so many, or a share of all.
SEEDS, SEED_SHARE = 24, 32


# ------------------------------------------------------------------ encoding


class Encoded:
    """Strings as one padded code matrix plus position bit masks per character (<= 64 chars)."""

    def __init__(self, strings):
        n = len(strings)
        self.length = np.fromiter((len(s) for s in strings), np.int64, n)
        flat = np.frombuffer("".join(strings).encode("utf-32-le"), dtype=np.uint32)
        self.alphabet, codes = np.unique(flat, return_inverse=True)
        width = max(int(self.length.max(initial=0)), 1)
        self.pad = len(self.alphabet)
        self.code = np.full((n, width), self.pad, dtype=np.int32)
        rows = np.repeat(np.arange(n), self.length)
        starts = np.cumsum(self.length) - self.length
        cols = np.arange(len(flat)) - np.repeat(starts, self.length)
        self.code[rows, cols] = codes
        self.mask = np.zeros((n, self.pad + 1), dtype=np.uint64)
        for j in range(width):
            live = np.nonzero(self.length > j)[0]
            self.mask[live, self.code[live, j]] |= ONE << np.uint64(j)


def low_bits(count):
    """uint64 with the ``count`` lowest bits set (0..64)."""
    count = np.asarray(count, dtype=np.int64)
    out = (ONE << np.minimum(count, 63).astype(np.uint64)) - ONE
    return np.where(count >= WORD, FULL, out)


def _advance(state, hit):
    """One character of the bit-parallel LCS recurrence (Crochemore et al. 2001, Hyyro 2004)."""
    u = state & hit
    return (state + u) | (state - u)


def lcs(enc, i, j):
    """Length of the longest common subsequence of strings ``i`` and ``j`` (index arrays)."""
    order = np.argsort(-enc.length[j], kind="stable")
    i, j = i[order], j[order]
    steps = enc.length[j]
    state = np.full(len(i), FULL, dtype=np.uint64)
    for s in range(int(steps.max(initial=0))):
        n = int(np.searchsorted(-steps, -s, side="left"))
        state[:n] = _advance(state[:n], enc.mask[i[:n], enc.code[j[:n], s]])
    out = np.empty(len(i), dtype=np.int64)
    out[order] = np.bitwise_count(~state & low_bits(enc.length[i]))
    return out


def subsequence_ratio(common, n, m):
    total = n + m
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total == 0, 100.0, 200.0 * common / total)


def ratio(enc, i, j):
    return subsequence_ratio(lcs(enc, i, j), enc.length[i], enc.length[j])


def _best_window(enc, i, j, floor):
    """Best ratio of needle ``i`` against the windows of text ``j`` (needle not longer).

    Exact where it exceeds ``floor`` (an array), else 0.
    """
    order = np.argsort(-enc.length[i], kind="stable")
    ni, tj, best = i[order], j[order], np.maximum(floor[order], 0.0)
    nlen, tlen = enc.length[ni], enc.length[tj]
    full = low_bits(nlen)
    # windows at the start of the text, of every length up to the needle's
    state = np.full(len(ni), FULL, dtype=np.uint64)
    last = int(tlen.max(initial=0))
    hits = np.zeros((len(ni), last), dtype=np.uint64)
    for s in range(last):
        hits[:, s] = enc.mask[ni, enc.code[tj, s]]
    for s in range(int(nlen.max(initial=0))):
        n = int(np.searchsorted(-nlen, -s, side="left"))
        state[:n] = _advance(state[:n], hits[:n, s])
        got = np.bitwise_count(~state[:n] & full[:n])
        np.maximum(best[:n], 200.0 * got / (nlen[:n] + s + 1), out=best[:n])
    # later windows: full length, or cut by the end of the text. A window that starts with a
    # character foreign to the needle is never better than the next one, and no window is better
    # than the count of its characters that the needle has.
    known = np.zeros((len(ni), last + 1), dtype=np.int32)
    np.cumsum(hits[:, :last] != 0, axis=1, out=known[:, 1:])
    for p in range(1, last):
        width = np.minimum(nlen, tlen - p)
        some = np.nonzero((width > 0) & (hits[:, p] != 0))[0]
        most = known[some, np.minimum(p + nlen[some], last)] - known[some, p]
        live = some[200.0 * most / (nlen[some] + width[some]) > best[some]]
        if not len(live):
            continue
        need = nlen[live]
        rows = hits[live, p : p + int(need[0])]
        state = np.full(len(live), FULL, dtype=np.uint64)
        for s in range(rows.shape[1]):
            n = int(np.searchsorted(-need, -s, side="left"))
            state[:n] = _advance(state[:n], rows[:n, s])
        got = np.bitwise_count(~state & full[live])
        best[live] = np.maximum(best[live], 200.0 * got / (need + width[live]))
    out = np.empty(len(i))
    out[order] = np.where(best > np.maximum(floor[order], 0.0), best, 0.0)
    return out


def partial_ratio(enc, i, j, floor=None):
    """Best ratio of the shorter value against the windows of the longer; with ``floor`` exact
    only above it."""
    floor = np.full(len(i), 0.0) if floor is None else floor
    a, b = enc.length[i], enc.length[j]
    out = np.zeros(len(i))
    out[(a == 0) & (b == 0)] = 100.0
    some = (a > 0) & (b > 0)
    pick = np.nonzero(some & (a <= b))[0]
    if len(pick):
        out[pick] = _best_window(enc, i[pick], j[pick], floor[pick])
    pick = np.nonzero(some & (b <= a))[0]
    if len(pick):
        other = _best_window(enc, j[pick], i[pick], np.maximum(floor[pick], out[pick]))
        out[pick] = np.maximum(out[pick], other)
    return out


def levenshtein(enc, i, j):
    """Edit distance, bit-parallel (Myers 1999 in the form of Hyyro 2003)."""
    order = np.argsort(-enc.length[j], kind="stable")
    i, j = i[order], j[order]
    n_i, n_j = enc.length[i], enc.length[j]
    top = np.where(n_i > 0, ONE << np.maximum(n_i - 1, 0).astype(np.uint64), np.uint64(0))
    pv = np.full(len(i), FULL, dtype=np.uint64)
    mv = np.zeros(len(i), dtype=np.uint64)
    dist = n_i.copy()
    for s in range(int(n_j.max(initial=0))):
        n = int(np.searchsorted(-n_j, -s, side="left"))
        eq = enc.mask[i[:n], enc.code[j[:n], s]]
        p, m = pv[:n], mv[:n]
        xv = eq | m
        xh = (((eq & p) + p) ^ p) | eq
        ph = m | ~(xh | p)
        mh = p & xh
        dist[:n] += (ph & top[:n]) != 0
        dist[:n] -= (mh & top[:n]) != 0
        ph = (ph << ONE) | ONE
        mh = mh << ONE
        pv[:n] = mh | ~(xv | ph)
        mv[:n] = ph & xv
    dist = np.where(n_i == 0, n_j, dist)
    out = np.empty(len(i), dtype=np.int64)
    out[order] = dist
    return out


def levenshtein_score(enc, i, j):
    longest = np.maximum(enc.length[i], enc.length[j])
    return np.where(
        longest == 0, 100.0, (1.0 - levenshtein(enc, i, j) / np.maximum(longest, 1)) * 100.0
    )


def jaro_winkler(enc, i, j):
    """Jaro-Winkler * 100: prefix weight 0.1, at most 4 characters, only above 0.7."""
    n_i, n_j = enc.length[i], enc.length[j]
    reach = np.maximum(np.maximum(n_i, n_j) // 2 - 1, 0)
    rows = np.arange(len(i))
    width = int(max(n_i.max(initial=0), n_j.max(initial=0), 1))
    left = np.full((len(i), width + 1), -1, dtype=np.int64)
    right = np.full((len(i), width + 1), -1, dtype=np.int64)
    used = np.zeros(len(i), dtype=np.uint64)
    found = np.zeros(len(i), dtype=np.int64)
    for s in range(int(n_i.max(initial=0))):
        char = enc.code[i, s]
        window = low_bits(np.minimum(s + reach + 1, WORD)) & ~low_bits(np.maximum(s - reach, 0))
        free = enc.mask[j, char] & window & ~used
        first = free & (~free + ONE)
        hit = (first != 0) & (s < n_i)
        used = np.where(hit, used | first, used)
        left[rows[hit], found[hit]] = char[hit]
        found = found + hit
    seen = np.zeros(len(i), dtype=np.int64)
    for s in range(int(n_j.max(initial=0))):
        hit = (used >> np.uint64(s)) & ONE != 0
        right[rows[hit], seen[hit]] = enc.code[j, s][hit]
        seen = seen + hit
    swaps = (left != right).sum(axis=1) // 2
    m = np.maximum(found, 1)
    jaro = (found / np.maximum(n_i, 1) + found / np.maximum(n_j, 1) + (found - swaps) / m) / 3.0
    jaro = np.where(found == 0, 0.0, jaro)
    prefix = np.zeros(len(i), dtype=np.int64)
    same = np.ones(len(i), dtype=bool)
    for s in range(min(4, enc.code.shape[1])):
        same = same & (enc.code[i, s] == enc.code[j, s]) & (s < n_i) & (s < n_j)
        prefix = prefix + same
    score = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1.0 - jaro), jaro)
    return np.where((n_i == 0) & (n_j == 0), 1.0, score) * 100.0


# ------------------------------------------------------------------ long values


def long_lcs(a, b):
    """LCS length of two strings of any length: the same recurrence on Python integers."""
    if len(a) < len(b):
        a, b = b, a
    masks = {}
    for p, c in enumerate(b):
        masks[c] = masks.get(c, 0) | (1 << p)
    full = (1 << len(b)) - 1
    state = full
    for c in a:
        u = state & masks.get(c, 0)
        state = ((state + u) | (state - u)) & full
    return len(b) - state.bit_count()


def long_ratio(a, b):
    return 100.0 if not a and not b else 200.0 * long_lcs(a, b) / (len(a) + len(b))


def long_partial(a, b, floor=0.0):
    """Best window ratio; exact where it exceeds ``floor``, else 0."""
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 100.0
    best = floor = max(floor, 0.0)
    for needle, text in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        masks = {}
        for p, c in enumerate(needle):
            masks[c] = masks.get(c, 0) | (1 << p)
        full = (1 << len(needle)) - 1
        known = np.r_[0, np.cumsum([c in masks for c in text])].tolist()
        for start in range(len(text)):
            width = min(len(needle), len(text) - start)
            most = known[start + width] - known[start]
            if start and (text[start] not in masks or 200.0 * most <= best * (len(needle) + width)):
                continue
            state = full
            for s in range(width):
                u = state & masks.get(text[start + s], 0)
                state = ((state + u) | (state - u)) & full
                if start == 0 or s + 1 == width:
                    got = len(needle) - state.bit_count()
                    best = max(best, 200.0 * got / (len(needle) + s + 1))
    return best if best > floor else 0.0


def long_token_set(x, y):
    """Token-set ratio of two token sets of any size."""
    if not x or not y:
        return 0.0
    both = x & y
    if both and (len(both) == len(x) or len(both) == len(y)):
        return 100.0
    sect = " ".join(sorted(both))
    sides = [" ".join(sorted(t - both)) for t in (x, y)]
    gap = 1 if both else 0
    full = [len(sect) + gap + len(d) for d in sides]
    best = 200.0 * (len(sect) + gap + long_lcs(*sides)) / sum(full)
    return max([best] + [200.0 * len(sect) / (len(sect) + n) for n in full if both])


def long_levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for x, ca in enumerate(a, 1):
        row = [x]
        for y, cb in enumerate(b, 1):
            row.append(min(prev[y] + 1, row[-1] + 1, prev[y - 1] + (ca != cb)))
        prev = row
    return prev[-1]


def long_jaro_winkler(a, b):
    if not a and not b:
        return 100.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for x, c in enumerate(a):
        for y in range(max(0, x - reach), min(len(b), x + reach + 1)):
            if not used[y] and b[y] == c:
                used[y] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swaps = sum(p != q for p, q in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0
    if jaro > 0.7:
        prefix = 0
        while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
            prefix += 1
        jaro += prefix * 0.1 * (1.0 - jaro)
    return jaro * 100.0


# ------------------------------------------------------------------ value features


class Features:
    """Per-value facts that pair scores need, computed once per distinct value of a batch."""

    def __init__(self, values):
        self.value = values
        n = len(values)
        tokens = [v.split() for v in values]
        self.sorted = [" ".join(sorted(t)) for t in tokens]
        distinct = [sorted(set(t)) for t in tokens]
        self.distinct = [" ".join(t) for t in distinct]
        self.repeats = np.fromiter((s != d for s, d in zip(self.sorted, self.distinct)), bool, n)
        self.tokens = [frozenset(t) for t in distinct]
        self.size = np.fromiter((len(v) for v in values), np.int64, n)
        self.distinct_size = np.fromiter((len(v) for v in self.distinct), np.int64, n)
        self.token_count = np.fromiter((len(t) for t in distinct), np.int64, n)
        self.token_bits = np.fromiter((_token_bits(t) for t in distinct), np.uint64, n)
        self.shortest = np.fromiter((min(map(len, t), default=0) for t in distinct), np.int64, n)
        bits = [_char_bits(v) for v in values]
        self.char_bits = np.fromiter((b[0] for b in bits), np.uint64, n)
        self.repeat_bits = np.fromiter((b[1] for b in bits), np.uint64, n)
        # padded matrices of token ids and numbers; values longer than a word are kept out of
        # them, so one long text cannot widen them for all
        fits = self.size <= WORD
        vocabulary = {}
        widest = int(self.token_count[fits].max(initial=0))
        self.token_id = np.full((n, max(widest, 1)), -1, np.int64)
        lengths = []
        for row in np.nonzero(fits)[0]:
            for col, tok in enumerate(distinct[row]):
                at = vocabulary.get(tok)
                if at is None:
                    at = vocabulary[tok] = len(lengths)
                    lengths.append(len(tok))
                self.token_id[row, col] = at
        self.token_length = np.array(lengths + [0], dtype=np.int64)
        numbers = [NUMBER.findall(v) for v in values]
        self.number_count = np.fromiter((len(x) for x in numbers), np.int64, n)
        self.numbers = [[float(x) for x in found] for found in numbers]
        self.number = np.full((n, max(int(self.number_count[fits].max(initial=0)), 1)), np.nan)
        for row in np.nonzero(fits & (self.number_count > 0))[0]:
            self.number[row, : len(numbers[row])] = self.numbers[row]
        self.bare, self.digits, self.same = (_ids(self.spelling(x)) for x in ("bare", "digits", "same"))

    def spelling(self, kind):
        """What must be equal for two values to score as equal in this respect."""
        if kind == "bare":
            return (re.sub(r"[^\w\s]", "", v).lower() for v in self.value)
        if kind == "digits":
            return (re.sub(r"[^\d.]", "", v) for v in self.value)
        return (v.lower() for v in self.value)


def _ids(strings):
    seen = {}
    return np.fromiter((seen.setdefault(s, len(seen)) for s in strings), np.int64)


def _token_bits(tokens):
    bits = 0
    for t in tokens:
        bits |= 1 << (zlib.crc32(t.encode()) & 63)
    return bits


_SLOT = {c: n for n, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 -.,()_")}


def _char_bits(value):
    """Two sets folded into one word each: characters, and (character, occurrence) from the second
    occurrence on.

    A member of a's set missing from b's costs a at least one character of any common subsequence,
    and a bit stands for at least one member, so ``len(a)`` less the bits only a has bounds the
    common subsequence from above.
    """
    bits, again, count = 0, 0, {}
    for c in value:
        k = count[c] = count.get(c, 0) + 1
        if k == 1:
            slot = _SLOT.get(c)
            bits |= 1 << (43 + ord(c) % 21 if slot is None else slot)
        else:
            again |= 1 << ((ord(c) * 37 + k * 11) & 63)
    return bits, again


def common_bound(fa, fb, i, j):
    """Upper bound of the LCS length for value ``i`` of ``fa`` and ``j`` of ``fb``."""
    x, y = fa.char_bits[i], fb.char_bits[j]
    u, v = fa.repeat_bits[i], fb.repeat_bits[j]
    lost_a = np.bitwise_count(x & ~y) + np.bitwise_count(u & ~v)
    lost_b = np.bitwise_count(y & ~x) + np.bitwise_count(v & ~u)
    return np.minimum(fa.size[i] - lost_a, fb.size[j] - lost_b)


def unit_conversion(f, i, j, guarded):
    """Same count of numbers and every quotient within range (vacuous without numbers)."""
    ok = f.number_count[i] == f.number_count[j]
    if guarded:
        ok = ok & (f.number_count[i] > 0)
    low, high = QUOTIENT_RANGE
    fits = (f.size[i] <= WORD) & (f.size[j] <= WORD)
    with np.errstate(divide="ignore", invalid="ignore"):
        for s in range(f.number.shape[1]):
            live = np.nonzero(ok & fits & (f.number_count[i] > s))[0]
            if not len(live):
                break
            a, b = f.number[i[live], s], f.number[j[live], s]
            q = np.where(b != 0, a / b, 0.0)
            ok[live] = (q >= low) & (q <= high)
    for p in np.nonzero(ok & ~fits)[0]:
        pairs = zip(f.numbers[i[p]], f.numbers[j[p]])
        ok[p] = all(b != 0 and low <= a / b <= high for a, b in pairs)
    return ok


def pattern_score(f, i, j, guarded=False):
    points = PATTERN_POINTS
    digits = f.digits[i] == f.digits[j]
    if guarded:
        digits = digits & (f.number_count[i] > 0) & (f.number_count[j] > 0)
    score = (
        points["unit"] * unit_conversion(f, i, j, guarded)
        + points["equal"] * (f.same[i] == f.same[j])
        + points["punctuation"] * (f.bare[i] == f.bare[j])
        + points["number_format"] * digits
    )
    return np.minimum(score, 100).astype(float)


def token_set_ratio(f, i, j, floor, common, above_sorted=False):
    """Token-set ratio; exact wherever the result exceeds ``floor`` (an array).

    ``above_sorted``: no floor is below the token-sort ratio, which is the same for values that neither share nor
    repeat a token. ``common`` bounds the characters the two values share. Shared tokens use up their own
    characters of that bound, so what is left bounds the subsequence of the differing tokens.
    """
    out = np.zeros(len(i))
    live = np.nonzero((f.token_count[i] > 0) & (f.token_count[j] > 0))[0]
    if not len(live):
        return out
    i, j = i[live], j[live]
    shared = np.zeros(len(i), dtype=np.int64)
    shared_len = np.zeros(len(i), dtype=np.int64)
    overlap = (f.token_bits[i] & f.token_bits[j]) != 0
    near = np.nonzero(overlap)[0]
    if len(near):
        for s in range(int(f.token_count[i[near]].max(initial=0))):
            tok = f.token_id[i[near], s]
            hit = (tok >= 0) & (f.token_id[j[near]] == tok[:, None]).any(axis=1)
            shared[near] += hit
            shared_len[near] += np.where(hit, f.token_length[tok], 0)
    sect = shared_len + np.maximum(shared - 1, 0)
    gap = (shared > 0).astype(np.int64)

    def rest(k):
        left = f.token_count[k] - shared
        chars = f.distinct_size[k] - (f.token_count[k] - 1) - shared_len
        return np.where(left > 0, chars + left - 1, 0)

    ab, ba = rest(i), rest(j)
    full_a, full_b = sect + gap + ab, sect + gap + ba
    best = np.zeros(len(i))
    with np.errstate(divide="ignore", invalid="ignore"):
        for other, extra in ((full_a, ab), (full_b, ba)):
            one = 100.0 * (sect + other - (gap + extra)) / (sect + other)
            best = np.where(gap > 0, np.maximum(best, one), best)
        contained = (gap > 0) & ((ab == 0) | (ba == 0))
        total = full_a + full_b
        left = np.minimum(np.minimum(ab, ba), np.maximum(common[live] - sect - gap, 0))
        bound = 100.0 * (total - (ab + ba - 2 * left)) / total
    best[contained] = 100.0
    open_ = ~contained & (bound > np.maximum(best, floor[live]))
    if above_sorted:
        open_ &= (gap > 0) | f.repeats[i] | f.repeats[j]
    open_ = np.nonzero(open_)[0]
    if len(open_):
        diff_a, diff_b = [], []
        for a, b, g in zip(i[open_].tolist(), j[open_].tolist(), gap[open_].tolist()):
            if g:
                both = f.tokens[a] & f.tokens[b]
                diff_a.append(" ".join(sorted(f.tokens[a] - both)))
                diff_b.append(" ".join(sorted(f.tokens[b] - both)))
            else:
                diff_a.append(f.distinct[a])
                diff_b.append(f.distinct[b])
        dist = ab[open_] + ba[open_] - 2 * lcs_of(diff_a, diff_b)
        two = 100.0 * (total[open_] - dist) / total[open_]
        best[open_] = np.maximum(best[open_], two)
    out[live] = best
    return out


def lcs_of(left, right):
    """LCS lengths of two lists of strings; each distinct string is encoded once."""
    seen = {}
    i = np.fromiter((seen.setdefault(s, len(seen)) for s in left), np.int64, len(left))
    j = np.fromiter((seen.setdefault(s, len(seen)) for s in right), np.int64, len(right))
    strings = list(seen)
    size = np.fromiter((len(s) for s in strings), np.int64, len(strings))
    short = size <= WORD
    out = np.zeros(len(left), dtype=np.int64)
    fit = np.nonzero(short[i] & short[j])[0]
    if len(fit):
        enc = Encoded([s if ok else "" for s, ok in zip(strings, short)])
        out[fit] = lcs(enc, i[fit], j[fit])
    for p in np.nonzero(~(short[i] & short[j]))[0]:
        out[p] = long_lcs(left[p], right[p])
    return out


# ------------------------------------------------------------------ pair scores


def score_pairs(f, i, j, full=False, floor=None, narrow=None):
    """Scores of the pairs ``(i, j)`` of one batch of values, one row per name in ``SCORES``.

    ``floor`` is a function of the scores that are cheap to get (ratio and token-sort ratio); it
    returns, per pair, the score below which the caller has no use for a result. Best scores that
    reach it are exact, others may be reported lower. ``narrow`` bounds, per pair, what windows that are narrower than
    the shorter value score. ``full`` adds the two edit measures and
    needs numbers on both sides for the number rules.
    """
    n = len(i)
    out = np.zeros((len(SCORES), n))
    if not n:
        return out
    fits = (f.size[i] <= WORD) & (f.size[j] <= WORD)
    short, long_ = np.nonzero(fits)[0], np.nonzero(~fits)[0]
    if len(short):
        a, b = i[short], j[short]
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        ea, eb = at[: len(a)], at[len(a) :]
        enc = Encoded([f.value[u] for u in used])
        out[0, short] = ratio(enc, ea, eb)
        differs = np.fromiter((f.sorted[u] != f.value[u] for u in used), bool, len(used))
        out[2, short] = out[0, short]
        moved = np.nonzero(differs[ea] | differs[eb])[0]
        if len(moved):
            sort_enc = Encoded([f.sorted[u] for u in used])
            out[2, short[moved]] = ratio(sort_enc, ea[moved], eb[moved])
    for p in long_:
        a_, b_ = f.value[i[p]], f.value[j[p]]
        out[0, p] = long_ratio(a_, b_)
        out[2, p] = long_ratio(f.sorted[i[p]], f.sorted[j[p]])
    least = np.full(n, -1.0) if floor is None else floor(np.maximum(out[0], out[2])) - 1e-9
    # no window beats the bound given by shared characters; a tie with ratio changes nothing
    bound = common_bound(f, f, i, j)
    needle = np.minimum(f.size[i], f.size[j])
    # a window has no longer common subsequence than the whole text
    most = np.minimum(bound, np.rint(out[0] * (f.size[i] + f.size[j]) / 200.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        ceiling = np.where(needle > 0, 200.0 * most / (needle + most), 100.0) + 1e-9
        if narrow is not None:
            ceiling = np.where(needle > 0, np.minimum(ceiling, np.maximum(100.0 * most / needle + 1e-9, narrow)), ceiling)
    wanted = (ceiling >= least) & (ceiling > out[0]) if floor is not None else np.ones(n, bool)
    if len(short):
        pick = np.nonzero(wanted[short])[0]
        if len(pick):
            low = None if floor is None else np.maximum(least, out[0])[short[pick]] - 1e-9
            out[1, short[pick]] = partial_ratio(enc, ea[pick], eb[pick], low)
    for p in long_[wanted[long_]]:
        low = 0.0 if floor is None else max(least[p], out[0, p]) - 1e-9
        out[1, p] = long_partial(f.value[i[p]], f.value[j[p]], low)
    if floor is not None:
        least = np.maximum(out[:3].max(axis=0), least)
    out[3, short] = token_set_ratio(f, i[short], j[short], least[short], bound[short], floor is not None)
    for p in long_:
        out[3, p] = long_token_set(f.tokens[i[p]], f.tokens[j[p]])
    if full:
        if len(short):
            out[4, short] = jaro_winkler(enc, ea, eb)
            out[5, short] = levenshtein_score(enc, ea, eb)
        for p in long_:
            a_, b_ = f.value[i[p]], f.value[j[p]]
            out[4, p] = long_jaro_winkler(a_, b_)
            out[5, p] = (1.0 - long_levenshtein(a_, b_) / max(len(a_), len(b_))) * 100.0
    out[6] = pattern_score(f, i, j, guarded=full)
    return out


def pair_score_frame(a: pd.Series, b: pd.Series, full: pd.Series) -> pd.DataFrame:
    """All scores of two columns of strings; repeated strings are encoded once."""
    seen = {}
    i = np.fromiter((seen.setdefault(v, len(seen)) for v in a), np.int64, len(a))
    j = np.fromiter((seen.setdefault(v, len(seen)) for v in b), np.int64, len(b))
    scores = score_pairs(Features(list(seen)), i, j, bool(full.iloc[0]) if len(full) else False)
    return pd.DataFrame(dict(zip(SCORES, scores)))


def pattern_ceiling(f, i, j):
    """The pattern score of each pair if all its numbers were within range of each other."""
    points = PATTERN_POINTS
    return (
        points["unit"] * (f.number_count[i] == f.number_count[j])
        + points["equal"] * (f.same[i] == f.same[j])
        + points["punctuation"] * (f.bare[i] == f.bare[j])
        + points["number_format"] * (f.digits[i] == f.digits[j])
    )


def ceilings(f, i, j, full=False, pattern=None, common=None, apart=False):
    """Upper bound of the best score of each pair, from lengths and bit sets alone.

    ``common``: characters that the values share at most, if known better; ``apart``: the bound of the ratio and its
    windows by itself, beside that of all other scores.

    Subsequence ratios are bounded by the characters both values can share. A token-set ratio is
    that, or one token set lies within the other (its bits do too), or it compares the shared
    tokens with one side, which then lacks at least one token on either side.
    """
    bound = common_bound(f, f, i, j).astype(np.float32)
    if common is not None:
        bound = np.minimum(bound, common)
    a, b = f.size[i], f.size[j]
    da, db = f.distinct_size[i], f.distinct_size[j]
    with np.errstate(divide="ignore", invalid="ignore"):
        over = np.minimum(a, b) + bound
        windows = np.where(over > 0, 200 * bound / over, 0)
        best = np.where(da + db > 0, 200 * bound / (da + db).astype(np.float32), 0)
        x, y = f.token_bits[i], f.token_bits[j]
        shared = (x & y) != 0
        within = shared & (((x & ~y) == 0) | ((y & ~x) == 0))
        rest = np.minimum(da - 1 - f.shortest[i], db - 1 - f.shortest[j])
        sect = np.maximum(np.minimum(bound, rest), 0)
        one = np.where(shared, 200 * sect / (sect + np.minimum(da, db)), 0)
        best = np.maximum(best, one)
        if full:
            jaro = (bound / np.maximum(a, 1) + bound / np.maximum(b, 1) + 1) / 3
            best = np.maximum(best, 100 * np.where(jaro > 0.7, jaro + 0.4 * (1 - jaro), jaro))
    # values without any token have equal (empty) token lists
    best[within | ((da == 0) & (db == 0))] = 100
    if pattern is None:
        pattern = pattern_ceiling(f, i, j)
    best = np.maximum(best, np.asarray(pattern, dtype=np.float32)) + np.float32(ROUNDING)
    windows = windows + np.float32(ROUNDING)
    return (best, windows) if apart else np.maximum(best, windows)


_SPACE = re.compile(r"\s")


class SharedCharacters:
    """Characters that queries and presets have in common, counted for whole blocks by matrix products.

    A value is a row of marks, one for each (character, occurrence). The product of two rows is what the values share
    with repetitions, in any order, which no common subsequence exceeds. Marks beyond SLOTS are folded, so that a
    product can only grow. White space counts as one character, as in joined tokens."""

    SLOTS = 512

    def __init__(self, queries, presets):
        slots = {}
        self.size = [np.fromiter((len(v) for v in side), np.int64, len(side)) for side in (queries, presets)]
        #: For both sides, from the left and from the right: the mark of each place.
        self.marks = [[self._marks(side, slots, step) for step in (1, -1)] for side in (queries, presets)]
        self.width = max(1, min(len(slots), self.SLOTS))
        self.whole = [self._rows(m[0], np.arange(len(m[0])), WORD) for m in self.marks]

    def _marks(self, values, slots, step):
        out = np.full((len(values), WORD), -1, dtype=np.int32)
        for row, value in enumerate(values):
            if len(value) <= WORD:
                seen = {}
                found = []
                for c in " ".join(_SPACE.split(value))[::step]:
                    k = seen[c] = seen.get(c, 0) + 1
                    found.append(slots.setdefault((c, k), len(slots)) % self.SLOTS)
                out[row, : len(found)] = found
        return out

    def _rows(self, marks, at, width):
        """Marks of the first ``width`` places."""
        rows = np.zeros((len(at), self.width), dtype=np.float32)
        for place in range(width):
            live = np.nonzero(marks[at, place] >= 0)[0]
            if not len(live):
                break
            rows[live, marks[at[live], place]] += 1
        return rows

    def common(self, q, p):
        """Shared characters of all pairs; no bound where a value is longer than a word."""
        found = self.whole[0][q] @ self.whole[1][p].T
        found[self.size[0][q] > WORD] = np.inf
        found[:, self.size[1][p] > WORD] = np.inf
        return found

    def windows(self, q, p, common, need):
        """Upper bounds of the ratio and all its windows, and of narrow windows; below ``need`` they may be too low.

        A window is as wide as the shorter value, or a start or end of the longer one that is narrower."""
        out = np.full((len(q), len(p)), np.inf, dtype=np.float32)
        narrow = out.copy()
        sizes = [self.size[0][q], self.size[1][p]]
        for a in np.unique(sizes[0][sizes[0] <= WORD]):
            rows = np.nonzero(sizes[0] == a)[0]
            low = float(need[rows].min())
            for b in np.unique(sizes[1][sizes[1] <= WORD]):
                cols = np.nonzero(sizes[1] == b)[0]
                short = int(min(a, b))
                best = np.zeros((len(rows), len(cols)), dtype=np.float32)
                first = max(1, int(np.ceil(low * short / max(200 - low, 1e-9) - 1e-6)))
                for side, at, size in ((0, q[rows], a), (1, p[cols], b)):
                    if size == max(a, b):
                        self._narrow(best, side, at, (p[cols], q[rows])[side], short, first)
                narrow[np.ix_(rows, cols)] = best
                out[np.ix_(rows, cols)] = np.maximum(best, common[np.ix_(rows, cols)] * np.float32(100 / max(short, 1)))
        return out + np.float32(ROUNDING), narrow + np.float32(ROUNDING)

    def _narrow(self, best, side, text, needle, short, first):
        whole = self.whole[1 - side][needle]
        for marks in self.marks[side]:
            part = self._rows(marks, text, first - 1)
            for width in range(first, short):
                part[np.arange(len(text)), marks[text, width - 1]] += 1
                shared = whole @ part.T if side else part @ whole.T
                np.maximum(best, np.minimum(shared, width) * np.float32(200 / (short + width)), out=best)


def candidates(f, i, j, threshold, full=False):
    """Mask of the pairs that may reach ``threshold``; a number or an array over the pairs."""
    return ceilings(f, i, j, full) >= threshold


def keep_best(q, p, score, kind, rank, k):
    """Positions of the ``k`` best hits per query: score descending, then lowest rank."""
    order = np.lexsort((rank[p], -score, q))
    group = q[order]
    start = np.r_[True, group[1:] != group[:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(len(group)), 0))
    return order[np.arange(len(group)) - first < k]


def best_in_block(queries, presets, rank, threshold, k, full=False, tile=1 << 17):
    """The ``k`` best presets per query of one bounded block: (query, preset, score, kind). ``threshold`` is a
    number, or one for each query.

    Trees find the pairs that may matter (see ``trees``). What they are not made for is compared pair by pair: values
    longer than a word or without tokens, small blocks, and queries that find too little for trees to pay."""
    queries, presets, rank = list(queries), list(presets), np.asarray(rank)
    need = np.array(np.broadcast_to(threshold, len(queries)), dtype=float)
    if full or len(presets) < TREES_FROM or not queries:
        return _best_by_parts(queries, presets, rank, need, k, full, tile)
    plain = [np.array([0 < len(v) <= WORD and not v.isspace() for v in side], dtype=bool) for side in (queries, presets)]
    asked, offered = plain[0] & (need > LEAST_ASKED), np.nonzero(plain[1])[0]
    found, left = _best_by_trees(queries, presets, rank, need, k, np.nonzero(asked)[0], offered)
    parts = [found]
    closed = asked.copy()
    closed[left] = False
    others = np.nonzero(~plain[1])[0]
    for q, p in ((np.nonzero(~closed)[0], np.arange(len(presets))), (np.nonzero(closed)[0], others)):
        if len(q) and len(p):
            got = _best_by_parts([queries[at] for at in q], [presets[at] for at in p], rank[p], need[q], k, full, tile)
            parts.append([q[got[0]], p[got[1]], *got[2:]])
    found = [np.concatenate(x) for x in zip(*parts, strict=True)]
    pick = keep_best(*found, rank, k)
    return [x[pick] for x in found]


def _best_by_parts(queries, presets, rank, need, k, full, tile):
    """Parts of presets one after the other; what a part has found raises what the next ones have to reach."""
    held = _no_hits()
    for q0 in range(0, len(queries), PART[0]):
        some, low = queries[q0 : q0 + PART[0]], need[q0 : q0 + PART[0]].copy()
        kept = _no_hits()
        for p0 in range(0, len(presets), PART[1]):
            got = _best_by_bounds(some, presets[p0 : p0 + PART[1]], rank[p0 : p0 + PART[1]], low, k, full, tile)
            kept = [np.concatenate([x, y]) for x, y in zip(kept, [got[0], got[1] + p0, *got[2:]], strict=True)]
            if p0 or p0 + PART[1] < len(presets):
                pick = keep_best(*kept, rank, k)
                kept = [x[pick] for x in kept]
                low = np.maximum(low, _kth_held(kept[0], kept[2], len(some), k))
        held = [np.concatenate([x, y]) for x, y in zip(held, [kept[0] + q0, *kept[1:]], strict=True)]
    return held


def _kth_held(q, score, nq, k):
    """Per query the least of its scores if it has ``k`` of them, else -1."""
    worst = np.full(nq, np.inf)
    np.minimum.at(worst, q, score)
    return np.where(np.bincount(q, minlength=nq) >= k, worst, -1.0)


def _best_by_trees(queries, presets, rank, need, k, asked, offered):
    """Hits of the queries ``asked`` among the presets ``offered``, and the queries that are left to other ways.

    High scores are asked for first: a query with ``k`` hits that reach them is done, and the others ask for less."""
    nq, held = len(queries), _no_hits()
    if len(offered) < TREES_FROM or not len(asked):
        return held, asked
    f = Features(queries + presets)
    try:
        index = trees.Index(f, nq, asked, offered, TREE_SHARE / 8)
    except trees.TooMany:
        return held, asked

    def ceiling(q, p):
        return ceilings(f, q, nq + p)

    open_, want = np.arange(len(asked)), ASKED_FIRST
    while len(open_):
        still = []
        for start in range(0, len(open_), trees.QUERIES):
            which = open_[start : start + trees.QUERIES]
            low = np.maximum(need[asked[which]], want)
            try:
                q, p, _ = index.pairs(which, low, int(len(which) * len(offered) * TREE_SHARE), ceiling)
            except trees.TooMany:
                return held, asked[np.concatenate([*still, open_[start:]])]
            least = np.full(nq, np.inf)
            least[asked[which]] = low
            got = _score_listed(f, nq, asked[q], p, least, rank, k)
            done = (low <= need[asked[which]]) | (np.bincount(got[0], minlength=nq)[asked[which]] >= k)
            keep = np.isin(got[0], asked[which[done]])
            held = [np.concatenate([x, y[keep]]) for x, y in zip(held, got, strict=True)]
            still.append(which[~done])
        open_, want = np.concatenate(still), want - ASKED_STEP
    return held, asked[:0]


def _score_listed(f, nq, q, p, least, rank, k, batch=1 << 17):
    """The ``k`` best of the listed pairs (in the order of queries) per query, none below ``least``."""
    kept = _no_hits()
    for start in range(0, len(q), batch):
        at_q, at_p = q[start : start + batch], p[start : start + batch]

        def floor(cheap, at_q=at_q):
            order = np.lexsort((-cheap, at_q))
            place = np.arange(len(order)) - np.searchsorted(at_q[order], at_q[order])
            kth = np.full(nq, -1.0)
            kth[at_q[order][place == k - 1]] = cheap[order][place == k - 1]
            return np.maximum(least, kth)[at_q]

        scores = score_pairs(f, at_q, nq + at_p, False, floor)
        kind, best = scores.argmax(axis=0), scores.max(axis=0)
        ok = best >= least[at_q]
        kept = [np.concatenate([x, y[ok]]) for x, y in zip(kept, (at_q, at_p, best, kind), strict=True)]
    pick = keep_best(*kept, rank, k)
    return [x[pick] for x in kept]


def _best_by_bounds(queries, presets, rank, threshold, k, full, tile):
    """``best_in_block`` by bounds of all pairs."""
    order = np.argsort(np.fromiter((len(v) for v in queries), np.int64, len(queries)), kind="stable")
    queries, threshold = [queries[at] for at in order], np.broadcast_to(threshold, len(order))[order]
    f = Features(queries + presets)
    nq, shared, tile_of = len(queries), SharedCharacters(queries, presets), {}

    def ceiling(i, j):
        q, p = i[:, 0], j[0]
        common = shared.common(q, p)
        rest, windows = ceilings(f, i, nq + j, full, common=common, apart=True)
        tile_of.update(last=(q, p, common, rest), narrow=None)
        return np.maximum(rest, windows)

    def tighter(need):
        q, p, common, rest = tile_of["last"]
        windows, tile_of["narrow"] = shared.windows(q, p, common, need)
        return np.maximum(rest, windows)

    def score(i, j, floor):
        q, p, _, _ = tile_of["last"]
        narrow = tile_of["narrow"]
        return score_pairs(f, i, nq + j, full, floor, None if narrow is None else narrow[i - q[0], j - p[0]])

    found = _best_by_tiles(nq, len(presets), rank, threshold, k, ceiling, score, tile, tighter)
    return [order[found[0]], *found[1:]]


def best_profiled_in_block(
    raw_q, smart_q, raw_p, smart_p, rank, case_sensitive, threshold, k, tile=1 << 17
):
    """The same with the scores of the per-key profile: subsequence and token scores of the smart
    normalized values, format scores of the raw values."""
    f = Features(list(smart_q) + list(smart_p))
    parts = Parts(list(raw_q) + list(raw_p), case_sensitive)
    nq = len(raw_q)

    def ceiling(i, j):
        form = np.maximum(parts.pattern(i, nq + j), parts.multiplier_ceiling(i, nq + j))
        return np.maximum(ceilings(f, i, nq + j, pattern=0), form)

    def score(i, j, floor):
        base = score_pairs(f, i, nq + j, False, floor)[:4]
        return np.vstack([base, parts.pattern(i, nq + j), parts.multiplier_unit(i, nq + j)])

    return _best_by_tiles(nq, len(raw_p), rank, threshold, k, ceiling, score, tile)


class Parts:
    """Format facts of raw values for the profile's scores."""

    def __init__(self, values, case_sensitive):
        letters = [re.findall(r"[a-zA-Z°]+", v) for v in values]
        parts = [
            re.findall(r"(\d+\.?\d*)\s*([mknupfMKNUPFGTgt]?)\s*([a-zA-Z°]*)", v) for v in values
        ]
        n = len(values)
        self.same = _ids(values if case_sensitive else (v.lower() for v in values))
        self.letters = _ids(" ".join(sorted(set(x))) for x in letters)
        counts = (len(re.findall(r"\d+\.?\d*\s*[mknupfMKNUPFGTgt]", v)) for v in values)
        self.scaled = np.fromiter(counts, np.int64, n)
        self.count = np.fromiter((len(x) for x in parts), np.int64, n)
        self.multipliers = _ids(repr([m for _, m, _ in x]) for x in parts)
        self.units = _ids(repr([u for _, _, u in x]) for x in parts)
        self.numbers = [[float(x) for x, _, _ in found] for found in parts]
        self.fits = np.fromiter((len(v) <= WORD for v in values), bool, n)
        widest = int(self.count[self.fits].max(initial=0))
        self.number = np.full((n, max(widest, 1)), np.nan)
        for row in np.nonzero(self.fits & (self.count > 0))[0]:
            self.number[row, : len(parts[row])] = self.numbers[row]

    def pattern(self, i, j):
        points = PROFILED_PATTERN_POINTS
        return (
            points["equal"] * (self.same[i] == self.same[j])
            + points["letters"] * (self.letters[i] == self.letters[j])
            + points["multipliers"] * (self.scaled[i] == self.scaled[j])
            + points["numbers"] * (self.count[i] == self.count[j])
        ).astype(float)

    def multiplier_ceiling(self, i, j):
        points = MULTIPLIER_UNIT_POINTS
        both = (self.count[i] > 0) & (self.count[j] > 0)
        return both * (
            points["multipliers"] * (self.multipliers[i] == self.multipliers[j])
            + points["units"] * (self.units[i] == self.units[j])
            + points["numbers"] * (self.count[i] == self.count[j])
        )

    def multiplier_unit(self, i, j):
        """0 unless both values have a number."""
        close = self.count[i] == self.count[j]
        fits = self.fits[i] & self.fits[j]
        for s in range(self.number.shape[1]):
            live = np.nonzero(close & fits & (self.count[i] > s))[0]
            if not len(live):
                break
            gap = np.abs(self.number[i[live], s] - self.number[j[live], s])
            close[live] = gap <= NUMBER_TOLERANCE
        for p in np.nonzero(close & ~fits)[0]:
            pairs = zip(self.numbers[i[p]], self.numbers[j[p]])
            close[p] = all(abs(a - b) <= NUMBER_TOLERANCE for a, b in pairs)
        lost = MULTIPLIER_UNIT_POINTS["numbers"] * (self.count[i] == self.count[j]) * ~close
        both = (self.count[i] > 0) & (self.count[j] > 0)
        return (self.multiplier_ceiling(i, j) - both * lost).astype(float)


def _best_by_tiles(nq, npre, rank, threshold, k, ceiling_of, scores_of, tile, tighter=None):
    """Visit the block tile by tile: bound all pairs, score the survivors, keep ``k`` per query.

    The most promising pairs of each query come first. Once a query has ``k`` hits, the worst of
    them is what any further pair has to reach. ``tighter`` bounds the last tile anew for what is needed by then.
    """
    held = _no_hits()
    wide = min(max(npre, 1), 4096)
    tall = max(1, tile // wide)
    for q0 in range(0, nq, tall):
        q = np.arange(q0, min(q0 + tall, nq))
        kept = _no_hits()
        need = np.array(np.broadcast_to(threshold, nq)[q], dtype=float)
        for p0 in range(0, npre, wide):
            p = np.arange(p0, min(p0 + wide, npre))
            ceiling = ceiling_of(q[:, None], p[None, :])
            if len(p) > 4 * SEEDS:
                first = max(SEEDS, len(p) // SEED_SHARE)
                seeds = np.argpartition(ceiling, len(p) - first, axis=1)[:, len(p) - first :]
                at_q, at_p = np.repeat(np.arange(len(q)), first), seeds.ravel()
                ok = ceiling[at_q, at_p] >= need[at_q]
                kept = _score_into(kept, q, p, at_q[ok], at_p[ok], need, rank, k, scores_of)
                ceiling[at_q, at_p] = -1
            if tighter is not None and np.count_nonzero(ceiling >= need[:, None]) > ceiling.size // 100:
                ceiling = np.minimum(ceiling, tighter(need))
            at_q, at_p = np.nonzero(ceiling >= need[:, None])
            kept = _score_into(kept, q, p, at_q, at_p, need, rank, k, scores_of)
        held = [np.concatenate([old, new]) for old, new in zip(held, kept)]
    return held


def _score_into(kept, q, p, at_q, at_p, need, rank, k, scores_of):
    """Score pairs, merge them with the kept hits and raise ``need`` where a query has ``k``."""
    if not len(at_q):
        return kept

    def floor(cheap):
        # k scores known to exist for a query: nothing below the k-th can be kept
        return np.maximum(need, _kth_best(at_q, at_p, cheap, (len(q), len(p)), k))[at_q]

    scores = scores_of(q[at_q], p[at_p], floor)
    kind, best = scores.argmax(axis=0), scores.max(axis=0)
    ok = best >= need[at_q]
    found = (q[at_q][ok], p[at_p][ok], best[ok], kind[ok])
    kept = [np.concatenate([old, new]) for old, new in zip(kept, found)]
    pick = keep_best(*kept, rank, k)
    kept = [x[pick] for x in kept]
    rows, size = np.unique(kept[0], return_counts=True)
    worst = np.full(len(need), np.inf)
    np.minimum.at(worst, kept[0] - q[0], kept[2])
    rows = rows[size == k] - q[0]
    need[rows] = np.maximum(need[rows], worst[rows])
    return kept


def _no_hits():
    return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]


def _kth_best(at_q, at_p, score, shape, k):
    """Per row of a tile, the k-th best of the given scores (-1 where there are fewer)."""
    if shape[1] < k or len(score) < k:
        return np.full(shape[0], -1.0)
    grid = np.full(shape, -1.0)
    grid[at_q, at_p] = score
    return np.partition(grid, shape[1] - k, axis=1)[:, shape[1] - k]


# ------------------------------------------------------------------ vectors


def matrix(column):
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def nearest_in_block(queries, presets, rank, threshold, k):
    """The ``k`` largest dot products (times 100) per query of one bounded block."""
    score = np.round(queries @ presets.T * 100.0, 6)
    cut = np.array(np.broadcast_to(threshold, len(queries)), dtype=float)
    if score.shape[1] > k:
        at = score.shape[1] - k
        cut = np.maximum(cut, np.partition(score, at, axis=1)[:, at])
    at_q, at_p = np.nonzero(score >= cut[:, None])
    value, kind = score[at_q, at_p], np.zeros(len(at_q), np.int64)
    pick = keep_best(at_q, at_p, value, kind, rank, k)
    return at_q[pick], at_p[pick], value[pick], kind[pick]


def better_in_block(queries, presets, rank, need, k):
    """As ``nearest_in_block`` where ``need``, one for each query, is known to rule out most pairs: only those that
    may reach it are rounded and compared."""
    score = queries @ presets.T
    score *= 100.0
    at_q, at_p = np.nonzero(score >= (need - 1e-6)[:, None])
    if len(at_q) > 8 * k * len(queries):
        return nearest_in_block(queries, presets, rank, need, k)
    value = np.round(score[at_q, at_p], 6)
    good = value >= need[at_q]
    at_q, at_p, value = at_q[good], at_p[good], value[good]
    kind = np.zeros(len(at_q), np.int64)
    pick = keep_best(at_q, at_p, value, kind, rank, k)
    return at_q[pick], at_p[pick], value[pick], kind[pick]
