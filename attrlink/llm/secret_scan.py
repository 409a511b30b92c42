"""Secret scans by a trigram inverted index.

Each rule's regular expression is reduced to a Boolean query over the trigrams that every match must
hold (after Cox, "Regular expression matching with a trigram index", 2012). The index lists, for each
trigram that some rule asks for, the texts that hold it; it is written once to the shared folder.
Queries combine the lists: a text's lists are met in one aggregation as bits, and the Boolean query is
evaluated on the bits. Only the candidates of a rule are verified with the expression. Rules without
mandatory trigrams (runs of hex digits) verify every text. All steps are DataFrame functions.

Spans count code points, end exclusive. Null texts are empty; rows with equal doc_id and text are each
returned with equal spans; an empty table gives none. Very long texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre  # the standard library's own parser of expressions
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import ascii_lower, small


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Characters that the whole match, or the group if given, must have at least.
    least: int = 0
    group: int = 0


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base kinds of the contract first, then kinds with well-known public prefixes.
ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key") + ")"
RULES = (
    Rule("assign", ASSIGN + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chatbot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9_.=-]{20,}"),
    Rule("basic", r"[a-z]{3,6}://[A-Za-z0-9_.-]{1,64}:[^\x00-\x20@/:]{6,64}@"),
)
BASE = ("assign", "access", "hex")

# Boolean queries: ("all", [..]), ("any", [..]), ("has", trigram), ("true",)
TRUE = ("true",)
MOST_STRINGS = 64


def _both(a, b):
    if a == TRUE or a == b:
        return b
    return a if b == TRUE else ("all", a, b)


def _either(a, b):
    return TRUE if TRUE in (a, b) else a if a == b else ("any", a, b)


def _strings_query(strings: set[str]):
    """Texts that hold one of ``strings`` hold all trigrams of that one."""
    total = None
    for s in sorted(strings):
        need = TRUE
        for g in sorted({s[i : i + 3] for i in range(len(s) - 2)}):
            need = _both(need, ("has", g))
        total = need if total is None else _either(total, need)
    return TRUE if total is None else total


def _walk(parsed):
    """(query, exact strings or None) of a parsed expression, on lower-cased characters."""
    query, exact = TRUE, {""}

    def flush():
        nonlocal query, exact
        query, exact = _both(query, _strings_query(exact)), {""}

    for op, arg in parsed:
        part: set[str] | None = None
        inner = TRUE
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            inner, part = _walk(arg[3])
        elif op is sre.BRANCH:
            found = [_walk(x) for x in arg[1]]
            if all(s is not None for _, s in found):
                part = set().union(*(s for _, s in found))
            else:
                inner = found[0][0] if found[0][1] is None else _strings_query(found[0][1])
                for q, s in found[1:]:
                    inner = _either(inner, _both(q, _strings_query(s)) if s is not None else q)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            q, s = _walk(body)
            if low == 0 and high == 1 and s is not None:
                part = s | {""}
            elif low == high == 1:
                inner, part = q, s
            elif low:
                inner = _both(q, _strings_query(s)) if s is not None else q
        if part is not None and len(exact) * len(part) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in part}
        else:
            flush()
            query = _both(query, inner)
            if part is not None and len(part) <= MOST_STRINGS:
                exact = set(part)
            elif part is not None:
                query = _both(query, _strings_query(part))
    if query == TRUE and parsed and all(_is_exact(x) for x in parsed):
        return TRUE, exact
    return _both(query, _strings_query(exact)), None


def _is_exact(item) -> bool:
    op, arg = item
    if op is sre.LITERAL:
        return True
    if op is sre.IN:
        return all(o is sre.LITERAL for o, _ in arg)
    if op is sre.SUBPATTERN:
        return all(_is_exact(x) for x in arg[3])
    if op is sre.BRANCH:
        return all(_is_exact(x) for b in arg[1] for x in b)
    return op is sre.MAX_REPEAT and arg[0] == 0 and arg[1] == 1 and all(_is_exact(x) for x in arg[2])


def trigram_query(pattern: str):
    """The Boolean trigram query that every lower-cased text with a match satisfies."""
    query, exact = _walk(_parser.parse(pattern))
    return _both(query, _strings_query(exact)) if exact is not None else query


def trigrams(query) -> set[str]:
    if query[0] == "has":
        return {query[1]}
    return set().union(*(trigrams(x) for x in query[1:])) if query != TRUE else set()


def _holds(query, place: dict[str, int], words: str = "bits") -> Column:
    """The query over the bits of the aggregated lists (62 trigrams to a word)."""
    if query == TRUE:
        return F.lit(True)
    if query[0] == "has":
        i = place[query[1]]
        return F.col(f"{words}{i // 62}").bitwiseAND(F.lit(1 << (i % 62))) != 0
    a, b = _holds(query[1], place, words), _holds(query[2], place, words)
    return a & b if query[0] == "all" else a | b


def build_index(documents: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, rid) of the given trigrams: one row for each trigram that a text holds."""
    low = ascii_lower(F.col("text"))
    held = F.filter(
        F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull()
    )
    return stage(
        documents.where(F.length("text") >= 3).select(row_id().alias("rid"), low.alias("low"))
        .select("rid", F.explode(held).alias("gram")).select("gram", "rid"),
        "trigram-postings",
    )


def row_id() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def candidates(postings: DataFrame, rules: list[tuple[int, tuple]], grams: list[str]) -> DataFrame:
    """(rid, mask): the rules, as bits, whose Boolean query a text's lists satisfy."""
    place = {g: i for i, g in enumerate(grams)}
    words = len(grams) // 62 + 1
    met = postings.groupBy("rid").agg(
        *[
            F.bit_or(F.expr(f"if(gram div 62 = {w}, shiftleft(1L, gram % 62), 0L)")).alias(f"bits{w}")
            for w in range(words)
        ]
    )
    mask = F.lit(0)
    for i, query in rules:
        mask = mask + F.when(_holds(query, place), 1 << i).otherwise(0)
    return stage(met.select("rid", mask.alias("mask")).where("mask > 0"), "secret-candidates")


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join, first: Column) -> Column:
    """What ``join`` makes of ``first`` and all values up to each place; one more entry than ``values``.

    Appending copies an array, so the values go in blocks: of n values about the root of n are appended at a time."""

    def chain(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda done, x: F.concat(done, F.array(join(F.element_at(done, -1), x))))

    def whole(xs: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), width)
        blocks = F.transform(starts, lambda at: chain(F.slice(xs, at, width), first))
        return _let(blocks, lambda b: _let(
            chain(F.transform(b, lambda x: F.element_at(x, -1)), first),
            lambda before: F.concat(F.array(first), F.flatten(
                F.transform(b, lambda x, i: F.transform(F.slice(x, 2, F.size(x)), lambda v: join(F.get(before, i), v))))),
        ))

    return _let(values, whole)


def _spans(rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> of the rule's matches in ``text``, leftmost, not overlapping."""
    pattern, text = F.lit(rule.pattern), F.col("text")
    lengths = lambda texts: F.transform(texts, lambda x: F.char_length(x).cast("long"))
    zero = F.lit(0).cast("long")

    def place(sizes: Column) -> Column:
        judged = lengths(F.regexp_extract_all(text, pattern, rule.group)) if rule.group else sizes
        gaps = F.slice(lengths(F.split(text, rule.pattern, -1)), 1, F.size(sizes))
        steps = F.zip_with(gaps, sizes, lambda gap, size: gap + size)
        starts = lambda ends: F.zip_with(F.slice(ends, 2, F.size(sizes)), F.arrays_zip(sizes.alias("size"), judged.alias("judged")), lambda end, x: F.struct(
            (end - x["size"]).alias("start"), F.lit(number).alias("kind"), end.alias("end"), x["judged"].alias("judged")))
        kept = F.filter(starts(_running(steps, lambda a, b: a + b, zero)), lambda x: x["judged"] >= rule.least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    placed = _let(lengths(F.regexp_extract_all(text, pattern, 0)), place)
    return F.when(F.regexp_like(text, F.lit(_shortcut(rule))), placed).otherwise(F.array().cast(SPANS))


def _shortcut(rule: Rule) -> str:
    """A cheaper expression that any text with a kept match satisfies."""
    if not rule.group and rule.least and rule.pattern.endswith("+"):
        fixed = 0 if rule.pattern.startswith("[") else len(rule.pattern.split("[")[0])
        return f"{rule.pattern[:-1]}{{{rule.least - fixed},}}"
    return rule.pattern


def _narrowed(rule: Rule) -> Rule:
    """Rules of one run of characters: short runs can't be kept, so they need not be listed."""
    return rule if rule.group or not rule.least else Rule(rule.kind, _shortcut(rule), rule.least)


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``documents`` and ``secrets``, an array of (start, kind, end), by start."""
    queries = [(i, trigram_query(r.pattern)) for i, r in enumerate(rules)]
    indexed = [(i, q) for i, q in queries if q != TRUE]
    grams = sorted(set().union(*(trigrams(q) for _, q in indexed))) if indexed else []
    # names of ours that the caller's columns can't clash with
    plain = documents.withColumn("__rid", row_id())
    found = candidates(build_index(documents.select("doc_id", "text"), grams), indexed, grams)
    found = found.select(F.col("rid").alias("__rid"), F.col("mask").alias("__mask"))
    joined = plain.join(small(found), "__rid", "left")
    by_index = {i for i, _ in indexed}
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(_narrowed(rule), i)
        if i in by_index:
            hit = F.coalesce(F.col("__mask"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
            spans = F.when(hit, spans).otherwise(F.array().cast(SPANS))
        parts.append(F.coalesce(spans, F.array().cast(SPANS)))
    return joined.withColumn("secrets", F.array_sort(F.concat(*parts))).drop("__rid", "__mask")


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``documents`` with each secret of ``text`` (overlapping ones merged) replaced by ``mark``."""
    names = documents.columns
    found = scan(documents, rules)
    text = F.col("text")
    part = lambda start, end: text.substr((start + 1).cast("int"), (end - start).cast("int"))
    # ends so far: a span that starts before the last one is over belongs to the same mark
    over = _running(F.transform("secrets", lambda x: x["end"]), F.greatest, F.lit(0).cast("long"))

    count = F.size("secrets")
    width = F.greatest(F.ceil(F.sqrt(count)).cast("int"), F.lit(1))

    def pieces(ends: Column) -> Column:
        # a place in a text is found by walking up to it, so stretches of about the root of all marks are cut first
        def stretch(s: Column) -> Column:
            return _let(part(F.get(ends, s), F.get(ends, F.least(s + width, count))), lambda chunk: F.array_join(F.transform(
                F.slice("secrets", s + 1, width), lambda x, i: head(chunk, x, F.get(ends, s), F.get(ends, s + i))), ""))

        def head(chunk: Column, x: Column, base: Column, end: Column) -> Column:
            before = chunk.substr((end - base + 1).cast("int"), (x["start"] - end).cast("int"))
            return F.when((x["start"] >= end) & (x["end"] > end), F.concat(before, F.lit(mark))).otherwise("")

        heads = F.transform(F.sequence(F.lit(0), count - 1, width), stretch)
        return F.concat(F.array_join(heads, ""), part(F.element_at(ends, -1), F.char_length(text).cast("long")))

    clean = _let(over, pieces)
    return found.withColumn("text", F.when(F.size("secrets") > 0, clean).otherwise(F.col("text"))).select(*names)
