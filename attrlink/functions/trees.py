"""Pairs of near texts out of prefix trees.

The values of one length, sorted, are the leaves of a tree; a node is a run of them with an equal start. A search goes
down from the root with many queries at once and keeps, for each (query, node), the bit-parallel state of the common
subsequence (see ``kernels.lcs``). The state says how much of the query, and of each of its starts, the start of the
values can match; with the places that are left this bounds the scores of all leaves below, and a node that can't reach
what the query needs is left with everything under it. Values that share a start share the steps for it.

All bounds are from above, so no pair that reaches its need is lost; what is returned may hold others and is scored
by the caller. Ratios and windows at the start of either text are bounded here; a tree of the values read backwards
bounds the windows at the ends.
"""

from __future__ import annotations

import numpy as np

WORD = 64
ONE, FULL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.array([(1 << n) - 1 for n in range(WORD + 1)], dtype=np.uint64)
#: Queries that go down a tree at once, and characters that trees tell apart.
QUERIES, ALPHABET = 512, 4096
#: Added so that rounding drops no pair.
EPSILON = 1e-6
#: Stands for a number of common characters that no pair can reach.
NEVER = 10 * WORD


class TooMany(Exception):
    """The search would take as long as looking at the pairs."""


class Tree:
    """Distinct values of one length: sorted rows, and for each depth where its nodes start and their children."""

    def __init__(self, values: list[str], rows: np.ndarray, alphabet: dict[str, int]):
        order = sorted(range(len(values)), key=values.__getitem__)
        self.rows, self.size = rows[order], len(values[0])
        flat = [alphabet[c] for at in order for c in values[at]]
        codes = np.array(flat, dtype=np.int32).reshape(len(values), self.size)
        differ = codes[1:] != codes[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), self.size)
        split = np.append(-1, first)
        self.starts = [np.nonzero(split < depth)[0] if depth else np.zeros(1, np.int64) for depth in range(self.size + 1)]
        self.children = [
            np.append(np.searchsorted(self.starts[d + 1], self.starts[d]), len(self.starts[d + 1])) for d in range(self.size)
        ]
        self.chars = [codes[self.starts[d + 1], d] for d in range(self.size)]
        #: For each place, which characters the values have there.
        self.places = np.zeros((len(alphabet), self.size), dtype=np.float32)
        for place in range(self.size):
            self.places[codes[:, place], place] = 1

    def leaves(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node its number of values, and their rows one after the other."""
        starts = self.starts[depth]
        ends = np.append(starts[1:], len(self.rows))
        count = ends[nodes] - starts[nodes]
        return count, self.rows[_runs(starts[nodes], count)]


def _runs(starts: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...``, ``count`` of them for each start."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - starts, count)


def forest(values: list[str], rows: np.ndarray, alphabet: dict[str, int]) -> list[Tree]:
    by_size: dict[int, list[int]] = {}
    for at, value in enumerate(values):
        by_size.setdefault(len(value), []).append(at)
    return [Tree([values[at] for at in members], rows[members], alphabet) for _, members in sorted(by_size.items())]


class Asked:
    """Queries over the alphabet of the values; characters that no value has match nothing and are left out."""

    def __init__(self, queries: list[str], alphabet: dict[str, int]):
        self.size = np.fromiter((len(q) for q in queries), np.int64, len(queries))
        codes = np.fromiter((alphabet.get(c, -1) for q in queries for c in q), np.int64, int(self.size.sum()))
        rows = np.repeat(np.arange(len(queries)), self.size)
        places = _runs(np.zeros(len(queries), np.int64), self.size)
        known = np.zeros((int(self.size.max(initial=0)) + 1, len(queries)), dtype=np.int64)
        known[places + 1, rows] = codes >= 0
        #: For each start of a query, how many of its characters are kept.
        self.kept = np.cumsum(known, axis=0)
        self.length = self.kept[-1]
        self.mask = np.zeros((len(queries), len(alphabet)), dtype=np.uint64)
        rows, places, codes = (x[codes >= 0] for x in (rows, places, codes))
        np.bitwise_or.at(self.mask, (rows, codes), ONE << self.kept[places, rows].astype(np.uint64))


def near(tree: Tree, asked: Asked, which: np.ndarray, need: np.ndarray, whole: bool, windows: bool, budget: int):
    """(query, row) pairs that may reach ``need``, and the number of nodes looked at.

    ``whole``: by the ratio and, with ``windows``, by windows as wide as the shorter text; ``windows`` alone: by
    windows at the start of one of the texts that are narrower. ``which`` are the queries, ``need`` is one for each."""
    m, n, length = tree.size, asked.size[which], asked.length[which]
    mask = asked.mask[which]

    def usable(mask):
        """From each place on, how many places of the values may have one of the characters of ``mask``."""
        places = np.zeros((m + 1, len(which)), dtype=np.int64)
        places[:m] = (((mask != 0).astype(np.float32) @ tree.places) > 0).T
        return np.cumsum(places[::-1], axis=0)[::-1]

    left = usable(mask)
    reach = lambda points: np.ceil(need * points / 200 - EPSILON).astype(np.int64)
    short = np.minimum(n, m)
    wanted = reach(2 * short if windows else n + m) if whole else np.full(len(which), NEVER)
    ours, theirs = {}, {}  # what a window of a width has to have in common
    if windows:
        for width in range(1, int(short.max(initial=0))):
            for side, other, fits in ((ours, m, (n >= m) & (width < m)), (theirs, n, (m >= n) & (width < n))):
                common = np.where(fits, reach(other + width), NEVER)
                common[common > width] = NEVER
                if (common < NEVER).any():
                    side[width] = common
    sizes = {width: asked.kept[width][which] for width in ours}
    lefts = {width: usable(mask & LOW[size][:, None]) for width, size in sizes.items()}

    def tests(depth):
        """(bits to count, count to have) for each query: one test for each way to reach the need."""
        rest = left[depth]

        def test(size, rest, common):
            rest = np.minimum(rest, size)
            return LOW[size - rest], common - rest

        yield test(length, rest, wanted)
        for width, common in theirs.items():
            if width >= depth:
                yield test(length, rest - left[width], common)
        for width, common in ours.items():
            yield test(sizes[width], lefts[width][depth], common)

    q, node, state = np.arange(len(which), dtype=np.int32), np.zeros(len(which), np.int32), np.full(len(which), FULL)
    seen, found = 0, []
    for depth in range(m + 1):
        if depth:
            children = tree.children[depth - 1]
            count = children[node + 1] - children[node]
            node = _runs(children[node], count).astype(np.int32)
            q, state = np.repeat(q, count), np.repeat(state, count)
            hit = state & mask[q, tree.chars[depth - 1][node]]
            state = (state + hit) | (state - hit)
        seen += len(q)
        if seen > budget:
            raise TooMany
        free = ~state
        if depth in theirs and depth < m:  # the start of the value is the window: all values below have it
            done = np.bitwise_count(free & LOW[length][q]) >= theirs[depth][q]
            if done.any():
                count, rows = tree.leaves(depth, node[done])
                seen += len(rows)
                found.append((np.repeat(q[done], count), rows))
                q, node, state, free = q[~done], node[~done], state[~done], free[~done]
        alive = np.zeros(len(q), dtype=bool)
        open_ = np.arange(len(q))
        for bits, common in tests(depth):
            if not len(open_):
                break
            if (common > WORD).all():
                continue
            at = q[open_]
            ok = np.bitwise_count(free[open_] & bits[at]) >= common[at]
            alive[open_[ok]] = True
            open_ = open_[~ok]
        q, node, state = q[alive], node[alive], state[alive]
        if not len(q):
            break
    else:
        count, rows = tree.leaves(m, node)
        found.append((np.repeat(q, count), rows))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), seen
    return which[np.concatenate([f[0] for f in found])], np.concatenate([f[1] for f in found]), seen


class Index:
    """Trees over values and their spellings; ``pairs`` finds what may reach a need."""

    def __init__(self, f, nq: int, q: np.ndarray, p: np.ndarray, shared: float):
        """``f``: features of queries and then presets; ``q`` and ``p``: which of each take part; ``shared``: the share of
        pairs that may share a token."""
        self.q, self.p = q, p
        self.forests = []
        same = all(f.sorted[at] == f.value[at] for at in (*q, *(nq + p)))
        forms = [(f.value, True, True, 1), (f.value, False, True, -1)]
        forms += [] if same else [(f.sorted, True, False, 1)]
        forms += [(f.distinct, True, False, 1)] if f.repeats[q].any() or f.repeats[nq + p].any() else []
        for values, whole, windows, step in forms:
            presets, queries = [values[nq + at][::step] for at in p], [values[at][::step] for at in q]
            alphabet = {c: n for n, c in enumerate(sorted(set().union(*presets)))}
            if len(alphabet) > ALPHABET:
                raise TooMany
            self.forests.append((forest(presets, p, alphabet), Asked(queries, alphabet), whole, windows))
        # equal spellings, and shared tokens
        self.equal = []
        for ids in (f.bare, f.same):
            order = np.argsort(ids[nq + p], kind="stable")
            keys = ids[nq + p][order]
            self.equal.append((p[order], np.searchsorted(keys, ids[q]), np.searchsorted(keys, ids[q], side="right")))
        holders: dict[str, list[int]] = {}
        for at in p.tolist():
            for token in f.tokens[nq + at]:
                holders.setdefault(token, []).append(at)
        self.holders = [[holders[t] for t in f.tokens[at] if t in holders] for at in q.tolist()]
        self.shared = np.fromiter((sum(map(len, h)) for h in self.holders), np.int64, len(q))
        if self.shared.sum() > len(q) * len(p) * shared:
            raise TooMany

    def pairs(self, which: np.ndarray, need: np.ndarray, budget: int, ceiling):
        """(place in ``q``, row) of the pairs that may reach ``need``, of the queries at the places ``which``, each once.

        ``ceiling`` bounds the scores of given pairs, which decides about those that share tokens."""
        found, seen = [], 0
        for trees, asked, whole, windows in self.forests:
            for tree in trees:
                q, p, n = near(tree, asked, which, need, whole, windows, budget - seen)
                seen += n
                found.append((q, p))
        for order, first, last in self.equal:
            count = (last - first)[which]
            seen += int(count.sum())
            if seen > budget:
                raise TooMany
            found.append((np.repeat(which, count), order[_runs(first[which], count)]))
        some = self.shared[which] > 0
        many = which[some]
        if len(many):
            rows = np.concatenate([np.array(h, np.int64) for at in many.tolist() for h in self.holders[at]])
            q = np.repeat(many, self.shared[many])
            ok = ceiling(self.q[q], rows) >= np.repeat(need[some], self.shared[many])
            found.append((q[ok], rows[ok]))
        q, p = (np.concatenate([f[side] for f in found]) for side in (0, 1))
        wide = int(self.p.max()) + 1
        both = np.unique(q * wide + p)
        return both // wide, both % wide, seen
