"""Chat formatting: a compiler for a small sandboxed template language.

``parse`` builds a syntax tree, ``fold`` joins constants and resolves constant branches, ``compile``
makes Python closures. A template sees only its messages: there is no attribute lookup beyond the
fields of a message, no calls and no Python names. The language:

    {{ expr }}    value, fields ``message.role`` / ``message.text``, string literals, ``a + b``,
                  filters ``expr | escape``, ``| trim``, ``| upper``, ``| lower``
    {% for message in messages %} ... {% endfor %}
    {% if expr == expr %} ... {% elif ... %} ... {% else %} ... {% endif %}  (also !=, and, or, not)
    {% generation %} ... {% endgeneration %}   text that the loss mask covers

Closures are generators over (text, under loss mask) pieces and read the messages one by one, so a
conversation of any length is rendered with one message in memory. ``escape`` puts a backslash before
each backslash and after the ``<`` of ``<|``, so no control string can appear inside a text, and
``unescape`` undoes it. Null roles and texts are empty; an empty table gives no rows; repeated turns
are ordered by role and text and all rendered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Turns between markers, every text escaped, the assistant's under the loss mask.
TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_start|>' + (message.role | escape) }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '<|im_end|>' }}\n"
    "{% endfor %}"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|(==|!=|[+|()]))")


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one tag; nodes are tuples."""

    def __init__(self, source: str, names: set[str]):
        self.tokens, self.names, at = [], names, 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append(m.group(0).strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        node = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()!r}")
        return node

    def either(self):
        node = self.both()
        while self.peek() == "or":
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.peek() == "and":
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self):
        if self.peek() == "not":
            self.take()
            return ("not", self.negated())
        node = self.sum()
        if self.peek() in ("==", "!="):
            return (self.take(), node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while self.peek() == "+":
            self.take()
            node = ("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.peek() == "|":
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def atom(self):
        token = self.take()
        if token == "(":
            node = self.either()
            if self.take() != ")":
                raise TemplateError("missing )")
            return node
        if token[0] in "'\"":
            return ("text", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1]))
        name, _, field = token.partition(".")
        if name in self.names and field in ("role", "text"):
            return ("field", field)
        raise TemplateError(f"no such value: {token!r}")


def parse(template: str):
    """The syntax tree: a list of nodes."""
    parts, at = [], 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            parts.append(("raw", template[at : m.start()]))
        parts.append(("value", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        parts.append(("raw", template[at:]))
    place = 0

    def block(names: set[str], ends: tuple[str, ...]):
        nonlocal place
        nodes = []
        while place < len(parts):
            kind, body = parts[place]
            place += 1
            if kind == "raw":
                nodes.append(("emit", ("text", body)))
            elif kind == "value":
                nodes.append(("emit", _Expression(body, names).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return nodes, word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*(\w+)\s+in\s+messages\s*", rest)
                    if not m or names:
                        raise TemplateError(f"not understood: {body!r}")
                    inner, _, _ = block({m[1]}, ("endfor",))
                    nodes.append(("for", inner))
                elif word == "generation":
                    inner, _, _ = block(names, ("endgeneration",))
                    nodes.append(("generation", inner))
                elif word == "if":
                    branches, test = [], _Expression(rest, names).whole()
                    while True:
                        inner, word, rest = block(names, ("elif", "else", "endif"))
                        branches.append((test, inner))
                        if word == "endif":
                            break
                        test = _Expression(rest, names).whole() if word == "elif" else ("true",)
                    nodes.append(("if", branches))
                else:
                    raise TemplateError(f"no such tag: {body!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, "", ""

    return block(set(), ())[0]


def _fold_value(node):
    kind = node[0]
    if kind in ("text", "field", "true", "false"):
        return node
    if kind == "filter":
        inner = _fold_value(node[2])
        return ("text", FILTERS[node[1]](inner[1])) if inner[0] == "text" else ("filter", node[1], inner)
    parts = [_fold_value(x) for x in node[1:]]
    known = [x[0] == "text" for x in parts]
    if kind == "+" and all(known):
        return ("text", parts[0][1] + parts[1][1])
    if kind in ("==", "!=") and all(known):
        return ("true",) if (parts[0][1] == parts[1][1]) == (kind == "==") else ("false",)
    if kind in ("and", "or", "not") and all(x[0] in ("true", "false", "text") for x in parts):
        truth = [x[0] == "true" or (x[0] == "text" and bool(x[1])) for x in parts]
        result = not truth[0] if kind == "not" else all(truth) if kind == "and" else any(truth)
        return ("true",) if result else ("false",)
    return (kind, *parts)


def fold(nodes):
    """Constants folded: neighbouring constant output is one piece, decided branches are gone."""
    out = []

    def add(node):
        if node[0] == "emit" and node[1][0] == "text":
            if not node[1][1]:
                return
            if out and out[-1][0] == "emit" and out[-1][1][0] == "text":
                node = ("emit", ("text", out.pop()[1][1] + node[1][1]))
        out.append(node)

    for node in nodes:
        if node[0] == "emit":
            add(("emit", _fold_value(node[1])))
        elif node[0] == "if":
            branches = []
            for test, inner in node[1]:
                test = _fold_value(test)
                if test[0] == "false" or test == ("text", ""):
                    continue
                branches.append((test, fold(inner)))
                if test[0] in ("true", "text"):
                    break
            if branches and branches[0][0][0] in ("true", "text"):
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                out.append(("if", branches))
        else:
            out.append((node[0], fold(node[1])))
    return out


def _value(node) -> Callable:
    kind = node[0]
    if kind == "text":
        return lambda m, t=node[1]: t
    if kind in ("true", "false"):
        return lambda m, t=kind == "true": t
    if kind == "field":
        return (lambda m: m[0]) if node[1] == "role" else (lambda m: m[1])
    if kind == "filter":
        return lambda m, f=FILTERS[node[1]], v=_value(node[2]): f(v(m))
    a = _value(node[1])
    if kind == "not":
        return lambda m: not a(m)
    b = _value(node[2])
    if kind == "+":
        return lambda m: a(m) + b(m)
    if kind == "==":
        return lambda m: a(m) == b(m)
    if kind == "!=":
        return lambda m: a(m) != b(m)
    return (lambda m: a(m) and b(m)) if kind == "and" else (lambda m: a(m) or b(m))


def _closure(nodes) -> Callable:
    steps = []
    for node in nodes:
        if node[0] == "emit":
            steps.append(lambda m, ms, g, v=_value(node[1]): iter(((v(m), g),)))
        elif node[0] == "generation":
            steps.append(lambda m, ms, g, c=_closure(node[1]): c(m, ms, True))
        elif node[0] == "for":
            steps.append(lambda m, ms, g, c=_closure(node[1]): (piece for x in ms for piece in c(x, (), g)))
        else:
            tests = [(_value(t), _closure(c)) for t, c in node[1]]
            steps.append(lambda m, ms, g, tests=tests: next((c(m, ms, g) for t, c in tests if t(m)), iter(())))

    def run(message, messages, generation):
        for step in steps:
            yield from step(message, messages, generation)

    return run


def compile_template(template: str) -> Callable[[Iterable[tuple[str, str]]], Iterator[tuple[str, bool]]]:
    """Messages (role, text) in, pieces (formatted text, under loss mask) out."""
    closure = _closure(fold(parse(template)))
    return lambda messages: closure(None, messages, False)


class Reader:
    """Reads formatted output back, piece by piece: turns, masked text, and their digests."""

    def __init__(self):
        self.open, self.turns, self.chars = "", 0, 0
        self.turn_hash, self.loss_hash, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0
        self.loss: list[str] = []

    def feed(self, piece: str, masked: bool) -> None:
        self.chars += len(piece)
        if masked:
            plain = unescape(piece)
            self.loss_chars += len(plain)
            self.loss_hash.update(plain.encode("utf-8", "surrogatepass"))
        self.open += piece
        while (end := self.open.find("<|im_end|>\n")) >= 0:
            head, self.open = self.open[:end], self.open[end + len("<|im_end|>\n") :]
            role, _, text = head.removeprefix("<|im_start|>").partition("\n")
            self.turns += 1
            self.turn_hash.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))


def _groups(batches: Iterator[pa.RecordBatch]):
    """(conv_id, messages) of rows sorted by conversation; messages must be read before the next."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def messages(key=key):
            nonlocal held
            while held is not None and held[0] == key:
                yield held[1], held[2]
                held = next(rows, None)

        yield key, messages()


def _ordered(conversations: DataFrame) -> DataFrame:
    """A partition holds whole conversations, rows in order; its rows stream through memory."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return (
        conversations.select("conv_id", "turn", empty("role"), empty("text"))
        .repartition(partitions(conversations.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )


def render(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted text, and the [start, end) spans of code points under the loss mask."""
    compile_template(template)  # errors show at once

    def run(batches):
        renderer = compile_template(template)
        for key, messages in _groups(batches):
            pieces, spans, at = [], [], 0
            for piece, masked in renderer(messages):
                if masked and piece:
                    spans.append({"start": at, "end": at + len(piece)})
                pieces.append(piece)
                at += len(piece)
            columns = [pa.array([key], pa.int64()), pa.array(["".join(pieces)]), pa.array([spans], _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "loss_spans"])

    return _ordered(conversations).mapInArrow(
        run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"
    )


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What reading the formatted output back gives, per conversation."""

    def run(batches):
        renderer = compile_template(template)
        out = []
        for key, messages in _groups(batches):
            r = Reader()
            for piece, masked in renderer(messages):
                r.feed(piece, masked)
            out.append((key, r.turns, r.turn_hash.hexdigest(), r.loss_chars, r.loss_hash.hexdigest(), r.chars))
            if len(out) >= 1000:
                yield _rows(out)
                out = []
        yield _rows(out)

    return _ordered(conversations).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_DIGESTS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _DIGESTS.types, strict=True)], schema=_DIGESTS)
