"""Pair scores as expressions: no Python in the plan, any length of value.

A common subsequence is counted bit-parallel (Hyyro 2004): the first value's characters become masks of positions, the second
is folded over them with one addition per word of 62 positions; longer values chain words by their carry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

#: Positions in a word; the sum of two words and a carry stays a positive 64-bit number.
WORD = 62
_FULL = (1 << WORD) - 1


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _let2(a: Column, b: Column, body) -> Column:
    return _let(a, lambda x: _let(b, lambda y: body(x, y)))


def _bit(place: Column) -> Column:
    return F.get(F.array(*(F.lit(1 << i) for i in range(WORD))), place)


def characters(value: Column) -> Column:
    """The characters (code points) of a text, in order."""
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def position_masks(chars: Column) -> Column:
    """map<character, array<long>>: where each character stands, WORD positions to a word."""
    words = F.sequence(F.lit(0), F.greatest(F.floor((F.size(chars) - 1) / WORD).cast("int"), F.lit(0)))

    def mask(char: Column) -> Column:
        def word(w: Column) -> Column:
            part = F.slice(chars, w * WORD + 1, WORD)
            hits = F.transform(part, lambda c, i: F.when(c == char, _bit(i)).otherwise(F.lit(0).cast("long")))
            return F.aggregate(hits, F.lit(0).cast("long"), lambda total, hit: total.bitwiseOR(hit))

        return F.transform(words, word)

    return _let(F.array_distinct(chars), lambda known: F.map_from_arrays(known, F.transform(known, mask)))


def common_characters(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of characters."""
    return _let(position_masks(a), lambda masks: _common(masks, F.size(a), b))


def _common(masks: Column, size: Column, b: Column) -> Column:
    """The same, from the masks of the first array and its ``size``."""
    words = F.greatest(F.ceil(size / WORD).cast("int"), F.lit(1))

    def step(state: Column, char: Column) -> Column:
        return _let(F.try_element_at(masks, char), lambda mask: F.when(mask.isNull(), state).otherwise(added(state, mask)))

    def added(state: Column, mask: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("words"))

        def word(done: Column, pair: Column) -> Column:
            kept = pair["v"].bitwiseAND(F.bitwise_not(pair["m"]))
            total = pair["v"] + pair["v"].bitwiseAND(pair["m"]) + done["carry"]
            new = total.bitwiseAND(F.lit(_FULL)).bitwiseOR(kept)
            return F.struct(F.shiftright(total, WORD).alias("carry"), F.concat(done["words"], F.array(new)).alias("words"))

        return F.aggregate(F.arrays_zip(state.alias("v"), mask.alias("m")), none, word, lambda done: done["words"])

    # a position of a that no longer has its bit is used
    final = F.aggregate(b, F.array_repeat(F.lit(_FULL), words), step)
    open_bits = F.transform(final, lambda v, w: F.bit_count(v.bitwiseAND(low_bits(size - w * WORD))))
    return size - F.aggregate(open_bits, F.lit(0), lambda total, n: total + n)


def low_bits(count: Column) -> Column:
    """The lowest ``count`` bits, none below 0 and at most a word."""
    return F.when(count >= WORD, F.lit(_FULL)).when(count <= 0, F.lit(0).cast("long")).otherwise(_bit(count.cast("int")) - 1)


def _ratio(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * common_characters(a, b) / total)


def ratio(a, b) -> Column:
    """Twice the longest common subsequence over both lengths, in percent; 100 for two empty texts."""
    return _let2(characters(X._col(a)), characters(X._col(b)), _ratio)


def _best_window(needle: Column, text: Column) -> Column:
    """Best ratio of ``needle`` against the windows of ``text`` of its length, also those that either end cuts."""
    n, m = F.size(needle), F.size(text)

    def search(masks: Column) -> Column:
        def step(best: Column, start: Column) -> Column:
            first = F.greatest(start, F.lit(1))
            width = F.least(start + n - 1, m) - first + 1
            # a later window that starts with a foreign character is never better than the next one
            foreign = (start > 1) & F.try_element_at(masks, F.get(text, first - 1)).isNull()
            hopeless = 200.0 * F.least(n, width) / (n + width) <= best
            found = 200.0 * _common(masks, n, F.slice(text, first, width)) / (n + width)
            return F.when(foreign | hopeless, best).otherwise(F.greatest(best, found))

        return F.aggregate(F.sequence(2 - n, m), F.lit(0.0), step)

    return _let(position_masks(needle), search)


def partial_ratio(a, b) -> Column:
    """Best ratio of the shorter value against the windows of the longer; either way round for equal lengths."""

    def compare(x: Column, y: Column) -> Column:
        n, m = F.size(x), F.size(y)
        return (
            F.when((n == 0) & (m == 0), 100.0).when((n == 0) | (m == 0), 0.0)
            .when(n < m, _best_window(x, y)).when(n > m, _best_window(y, x))
            .otherwise(F.greatest(_best_window(x, y), _best_window(y, x)))
        )

    return _let2(characters(X._col(a)), characters(X._col(b)), compare)


def token_sort_ratio(a, b) -> Column:
    """The ratio of the values with their words in order."""
    return ratio(X.sorted_tokens(a), X.sorted_tokens(b))


def _words(value: Column) -> Column:
    return F.array_sort(F.array_distinct(X.tokens(value)))


def token_set_ratio(a, b) -> Column:
    """Shared words against either side, or what differs of both sides against each other; 0 without words."""
    joined = lambda words: F.array_join(words, " ")
    size = lambda words: F.char_length(joined(words))

    def compare(x: Column, y: Column) -> Column:
        def parts(both: Column, only: Column) -> Column:
            left, right = F.get(only, F.lit(0)), F.get(only, F.lit(1))
            sect, gap = size(both), F.when(F.size(both) > 0, 1).otherwise(0)
            more_a, more_b = size(left), size(right)
            one = lambda more: 200.0 * sect / (2 * sect + gap + more)
            total = 2 * (sect + gap) + more_a + more_b
            apart = more_a + more_b - 2 * _let2(characters(joined(left)), characters(joined(right)), common_characters)
            two = 100.0 * (total - apart) / total
            return (
                F.when((gap == 1) & ((more_a == 0) | (more_b == 0)), 100.0)
                .when(gap == 1, F.greatest(one(more_a), one(more_b), two)).otherwise(two)
            )

        only = F.array(F.array_sort(F.array_except(x, y)), F.array_sort(F.array_except(y, x)))
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(_let2(F.array_intersect(x, y), only, parts))

    return _let2(_words(X._col(a)), _words(X._col(b)), compare)


def jaro_winkler(a, b) -> Column:
    """Jaro-Winkler in percent: prefix weight 0.1, at most 4 characters, above 0.7 only; 100 for two empty texts.

    The characters of ``a`` take the first free equal one of ``b`` within reach, one after the other; what is taken is
    a set of bits, WORD places to a word."""

    def compare(x: Column, y: Column) -> Column:
        n, m = F.size(x), F.size(y)
        reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
        none = F.struct(F.array_repeat(F.lit(0).cast("long"), F.ceil(m / WORD).cast("int")).alias("used"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("left"))

        def fold(masks: Column) -> Column:
            def step(s: Column, char: Column) -> Column:
                low, high = s["at"] - reach, s["at"] + reach + 1

                def free(mask: Column) -> Column:
                    # of each word the free equal places within reach
                    def word(p: Column, w: Column) -> Column:
                        window = low_bits(high - w * WORD).bitwiseAND(F.bitwise_not(low_bits(low - w * WORD)))
                        return p["m"].bitwiseAND(F.bitwise_not(p["u"])).bitwiseAND(window)

                    return F.transform(F.arrays_zip(mask.alias("m"), s["used"].alias("u")), word)

                def take(places: Column) -> Column:
                    first = F.array_position(F.transform(places, lambda p: p != 0), True)
                    taken = F.transform(s["used"], lambda u, w: F.when(
                        w + 1 == first, u.bitwiseOR(_let(F.get(places, w), lambda p: p.bitwiseAND(-p)))).otherwise(u))
                    return F.when(first > 0, F.struct(taken.alias("used"), (s["at"] + 1).alias("at"), F.concat(s["left"], F.array(char)).alias("left"))).otherwise(missed)

                missed = F.struct(s["used"].alias("used"), (s["at"] + 1).alias("at"), s["left"].alias("left"))
                return _let(F.try_element_at(masks, char), lambda mask: F.when(mask.isNull(), missed).otherwise(_let(free(mask), take)))

            return F.aggregate(x, none, step)

        def score(s: Column) -> Column:
            found = F.size(s["left"])
            taken = lambda i: F.get(s["used"], F.floor(i / WORD).cast("int")).bitwiseAND(_bit((i % WORD).cast("int"))) != 0
            right = F.filter(y, lambda c, i: taken(i))
            swaps = F.floor(F.size(F.filter(F.zip_with(s["left"], right, lambda p, q: p != q), lambda d: d)) / 2)
            jaro = (found / F.greatest(n, F.lit(1)) + found / F.greatest(m, F.lit(1)) + (found - swaps) / F.greatest(found, F.lit(1))) / 3.0
            same = F.zip_with(F.slice(x, 1, 4), F.slice(y, 1, 4), lambda p, q: F.coalesce(p == q, F.lit(False)))
            wrong = F.array_position(same, False)
            prefix = F.when(wrong > 0, wrong - 1).otherwise(F.size(same))
            return _let(F.when(found == 0, 0.0).otherwise(jaro), lambda j: 100.0 * F.when(j > 0.7, j + prefix * 0.1 * (1.0 - j)).otherwise(j))

        return F.when((n == 0) & (m == 0), 100.0).otherwise(_let(_let(position_masks(y), fold), score))

    return _let2(characters(X._col(a)), characters(X._col(b)), compare)


NATIVE = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "jaro_winkler": jaro_winkler}
