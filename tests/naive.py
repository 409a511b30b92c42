"""Plain definitions, one pair at a time, to hold the library against."""

import re


def common(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(prev[j - 1] + 1 if x == y else max(prev[j], row[-1]))
        prev = row
    return prev[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def partial(a, b):
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    if len(a) > len(b):
        a, b = b, a
    best = 0.0
    for s, t in [(a, b)] + ([(b, a)] if len(a) == len(b) else []):
        for start in range(1 - len(s), len(t)):
            window = t[max(start, 0) : start + len(s)]
            best = max(best, ratio(s, window))
    return best


def token_sort(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left = (both + " " + " ".join(sorted(x - y))).strip()
    right = (both + " " + " ".join(sorted(y - x))).strip()
    if both and (x <= y or y <= x):
        return 100.0
    best = ratio(left, right)
    return max(best, ratio(both, left), ratio(both, right)) if both else best


def pattern(a, b):
    nums = [[float(n) for n in re.findall(r"\d+\.?\d*", v)] for v in (a, b)]
    unit = len(nums[0]) == len(nums[1]) and all(
        q != 0 and 0.1 <= p / q <= 10 for p, q in zip(*nums)
    )
    bare = [re.sub(r"[^\w\s]", "", v).lower() for v in (a, b)]
    digits = [re.sub(r"[^\d.]", "", v) for v in (a, b)]
    return float(
        30 * unit + 20 * (a.lower() == b.lower()) + 15 * (bare[0] == bare[1])
        + 25 * (digits[0] == digits[1])
    )


def scores(a, b):
    return {
        "ratio": ratio(a, b),
        "partial_ratio": partial(a, b),
        "token_sort_ratio": token_sort(a, b),
        "token_set_ratio": token_set(a, b),
        "pattern": pattern(a, b),
    }


def normalize(v):
    return re.sub(r"[^\w\s\-.,()]", "", re.sub(r"\s+", " ", v.strip().lower()))


def cascade(inputs, presets, threshold=75.0, k=5, cross=True):
    """(input_id, rank, row_id, score, type) of the first three stages."""
    out = []
    known = [(r, (c, s, a), v, normalize(v)) for r, c, s, a, v in sorted(presets)]
    for i, c, s, a, v in inputs:
        if not v.strip():
            continue
        n, key = normalize(v), (c, s, a)
        same = [p for p in known if p[1] == key]
        exact = [p for p in same if p[3] == n]
        if exact:
            out.append((i, 1, exact[0][0], 100.0, "exact"))
            continue
        for pool in (same, known if cross else []):
            hits = []
            for row, _, _, m in pool:
                all_ = scores(n, m)
                best = max(all_.values())
                if best >= threshold:
                    hits.append((-best, row, max(all_, key=all_.get)))
            hits.sort(key=lambda h: h[:2])
            if hits:
                out += [(i, p, r, -b, t) for p, (b, r, t) in enumerate(hits[:k], 1)]
                break
    return out
