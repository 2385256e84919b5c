"""Secrets by assignment-aware lexing.

Three plain patterns give the base spans. Besides, texts that name something sensitive are lexed as source
or configuration: assignments, keyword arguments, mappings and `KEY=value` lines give pairs of a name and a
literal; a name that stands for an earlier literal hands it on, and adjacent or added parts count as one
value. A literal is reported by the sensitivity of its name and its own form.

Spans are in code points, the end exclusive. A null or empty text has no spans, and an empty table gives no
rows. Repeated rows keep a row each; spans that start together go by kind, then end. Other columns are not read.
Every step takes time in proportion to the text, however constants are chained; texts of any length are read
whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panewise.llm.common import by_size, in_batches

Span = tuple[str, int, int]

# The base patterns, least lengths and order of kinds.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST_VALUE, _LEAST_ACCESS, _LEAST_HEX = 12, 18, 16

#: The kind of the spans that the method adds.
LITERAL = "literal"

_HEX_MARKS = bytes(ord("x") if c in b"0123456789abcdef" else ord(" ") for c in range(256))
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[Span]:
    """By start, then by kind in the order of KINDS. Cheap tests keep patterns off texts that have no match."""
    spans: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST_VALUE]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST_ACCESS]
    if b"x" * _LEAST_HEX in text.encode("utf-8", "surrogatepass").translate(_HEX_MARKS):
        spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# Lexing -------------------------------------------------------------------------------------------

_LEXEMES = re.compile(
    r"""
    (?P<comment>(?:(?<![^\s;])\#|(?<!\S)//)[^\n]*+)
  | (?P<string>(?:(?<![A-Za-z0-9_$])(?:[bB]?[rR]\#{1,3}|u8|[bBrRfFuUtT]{1,2}|[LcsN]|raw|[$@]{1,2}))?
      (?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`))
  | (?P<name>[A-Za-z_$](?:[A-Za-z0-9_$]|[.-](?=[A-Za-z0-9_$]))*+)
  | (?P<becomes>:=|=>|=(?!=)|:(?![:/]))
  | (?P<join>\+)
  | (?P<line>\n)
  | (?P<other>[^\s"'`A-Za-z_$@\n:=+]++|[=:"'`@])
    """,
    re.X,
)
# A bare value: all that a line has after its first `=` or `:`, without blanks or quotes.
_BARE_LINE = re.compile(r"^[ \t]*+(?:export[ \t]++)?([A-Za-z_][A-Za-z0-9_.-]*+)[ \t]*+[:=][ \t]*+([^\s\"'`#;,]++)[ \t]*+\r?$", re.M)


_FILLED_IN = re.compile(r"\{[^{}]*+\}")


def _inside(m: re.Match) -> tuple[int, int]:
    """The span of a string without its prefix and quotes."""
    return m.start() + m[0].index(m[0][-1]) + 1, m.end() - 1


def _fixed(m: re.Match) -> list[tuple[int, int]]:
    """Spans of a string's own characters; what a format string fills in is none of them."""
    start, end = _inside(m)
    if not re.search("[fF$s]", m.string[m.start() : start - 1]):
        return [(start, end)]
    spans = []
    for hole in _FILLED_IN.finditer(m.string, start, end):
        spans.append((start, hole.start()))
        start = hole.end()
    return [*spans, (start, end)]


class _Type:
    """Follows what stands between `name:` and `=`: a type, if it is names and marks of types on one line."""

    def __init__(self) -> None:
        self.name: str | None = None
        self._depth = 0

    def open(self, name: str | None) -> None:
        self.name, self._depth = name, 0

    def read(self, kind: str, lexeme: str) -> None:
        if kind in ("line", "becomes", "join") or kind == "string" and not self._depth:
            self.name = None
        if kind == "other" and self.name:
            for c in lexeme:
                self._depth += (c in "[<(") - (c in "]>)")
                if self._depth < 0 or not self._depth and c not in "]>)|&*?!'":
                    self.name = None
                    break

    def target(self) -> str | None:
        return None if self._depth else self.name


#: Letters at both ends of a value by which it is told what stands across the seams of its parts.
_EDGE = 120


class Value:
    """A literal put together from parts: spans of the text, and other values, which are shared and never copied.

    What a score needs of its text is worked out from the parts, so a chain of constants costs what its lines
    do, however long the text is that they stand for.
    """

    def __init__(self, text: str, parts: list[tuple[int, int] | Value]):
        self.parts, self.size, self.letters, self.last = parts, 0, frozenset(), ""
        self.key = self.veto = self.opened = self.message = False
        self.head = self.tail = ""
        for part in parts:
            self._add(part if isinstance(part, Value) else _Leaf(text[part[0] : part[1]]))

    def _add(self, other: Value | _Leaf) -> None:
        across = self.tail[-_EDGE:] + other.head[:_EDGE]
        # A word at the edge of what is looked at may be half of one.
        from_start, to_end = self.size <= _EDGE, other.size <= _EDGE
        seam = len(self.tail[-_EDGE:])

        def met(pattern: re.Pattern) -> bool:
            return any(
                m.start() < seam < m.end() and (from_start or m.start() > 0) and (to_end or m.end() < len(across))
                for m in pattern.finditer(across)
            )

        self.key = self.key or other.key or met(_KEY_BEGINS)
        self.veto = self.veto or other.veto or self.opened and ">" in other.letters or met(_PLACEHOLDER)
        self.opened = self.opened or "<" in other.letters
        self.message = self.message or other.message or met(_MESSAGE_WORD)
        self.letters |= other.letters
        self.head = (self.head + other.head)[:_EDGE] if self.size < _EDGE else self.head
        self.tail = (self.tail + other.tail)[-_EDGE:]
        self.size += other.size
        self.last = other.last or self.last

    def spans(self, seen: set[int] | None = None) -> Iterator[tuple[int, int]]:
        """Each span once, in order; values in `seen` are left out, and added to it."""
        seen = set() if seen is None else seen
        given: set[tuple[int, int]] = set()
        stack = [self]
        while stack:
            part = stack.pop()
            if isinstance(part, tuple):
                if part not in given:
                    given.add(part)
                    yield part
            elif id(part) not in seen:
                seen.add(id(part))
                stack.extend(reversed(part.parts))


class _Leaf:
    """What a score needs of a piece of text."""

    def __init__(self, text: str):
        self.size, self.letters, self.last = len(text), frozenset(text), text.rstrip()[-1:]
        self.key, self.veto = bool(_KEY_BEGINS.search(text)), bool(_PLACEHOLDER.search(text))
        self.message = bool(_MESSAGE_WORD.search(text))
        self.head, self.tail = text[:_EDGE], text[-_EDGE:]


def name_literal_pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(name, spans of its literal's parts, each once), in order of place; constants are handed on by name."""
    for name, value in assignments(text):
        yield name, list(value.spans())


def assignments(text: str) -> Iterator[tuple[str, Value]]:
    """(name, value) of what is assigned, in order of place; constants are handed on by name.

    The target of `name: type = ...` is the name, that of `x["name"] = ...` the last string in the brackets.
    Forms that need more than the last name follow: calls, setters, blocks, elements and tuples.
    """
    constants: dict[str, Value] = {}
    lexemes = ((m.lastgroup, m) for m in _LEXEMES.finditer(text) if m.lastgroup != "comment")
    name = None  # what the next literal would be assigned to
    before: tuple[str, re.Match] | None = None
    parts: list[tuple[int, int] | Value] = []
    waiting = False  # a value may follow
    typed = _Type()

    def close() -> Iterator[tuple[str, Value]]:
        nonlocal name, parts, waiting
        if name and parts:
            constants[name] = Value(text, parts)
            yield name, constants[name]
        name, parts, waiting = None, [], False

    for kind, m in lexemes:
        if kind == "becomes":
            target, declared = before, typed.target() if m[0] == "=" else None
            if declared:
                parts = []  # a type that is called like a constant is no value
            yield from close()
            called = None
            if target and target[0] == "name":
                called = target[1][0]
            elif target and target[0] in ("string", "subscript"):
                a, b = _inside(target[1])
                called = text[a:b]
            typed.open(called if m[0] == ":" and target and target[0] != "string" else None)
            if declared or called:
                name, waiting = declared or called, True
        elif kind == "string" and name and waiting:
            parts += _fixed(m)
            waiting = False
        elif kind == "name" and name and waiting:
            if m[0] in constants:
                parts.append(constants[m[0]])
                waiting = False
            else:
                yield from close()
        elif kind == "join" and name and parts:
            waiting = True
        elif kind == "line" and name and (waiting or parts):
            if not waiting:
                yield from close()
        elif kind == "string" and name and parts and before and before[0] == "string":
            parts += _fixed(m)
        else:
            yield from close()
        if kind != "becomes":
            typed.read(kind, m[0])
        if kind == "other" and m[0] == "]" and before and before[0] == "string":
            before = ("subscript", before[1])
        elif kind == "other" and m[0] in "?!" and before and before[0] == "name" and text[m.end() : m.end() + 1] == ":":
            pass  # `name?: type`
        elif kind != "line":
            before = (kind, m)
    yield from close()
    for m in _BARE_LINE.finditer(text):
        yield m[1], Value(text, [m.span(2)])
    yield from _other_forms(text)


_STRING = r"""(?:"[^"\n]*+"|'[^'\n]*+')"""
# `name = f("literal")`, `name: Type = f("what", "literal")`.
_CALL = re.compile(
    rf"""\b([A-Za-z_]\w*+)[ \t]*+(?::[^=:\n"'(]{{0,80}}+)?[:=][ \t]*+(?:new[ \t]++)?([A-Za-z_][\w.:]*+)\([ \t]*+({_STRING})(?:[ \t]*+,[ \t]*+({_STRING}))?"""
)
_SETTER = re.compile(rf"\b(?:set|with|add|put)_?([A-Z]\w*+|[a-z]\w*+)\([ \t]*+({_STRING})[ \t]*+\)")
_BLOCK = re.compile(r"^[ \t]*+(?:-[ \t]++)?([A-Za-z_][\w.-]*+)[ \t]*+:[ \t]*+[|>][+-]?[ \t]*+\n((?:[ \t]++[^\s][^\n]*+(?:\n|\Z))++)", re.M)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:[ \t][^<>\n]{0,200}+)?>([^<>\n]++)</\1>")
_TUPLE = re.compile(
    rf"^[ \t]*+(\w++(?:[ \t]*+,[ \t]*+\w++)++)[ \t]*+:?=[ \t]*+({_STRING}(?:[ \t]*+,[ \t]*+{_STRING})++)", re.M
)
# Functions that give back the text they get; of others only a second literal, a default, is a value.
_GIVES_BACK = {"from", "new", "str", "string", "bytes", "secretstr", "secretbytes", "text", "literal", "b64decode", "base64decode", "tostring"}


def _other_forms(text: str) -> Iterator[tuple[str, Value]]:
    inside = lambda m, g: Value(text, [(m.start(g) + 1, m.end(g) - 1)])
    for m in _CALL.finditer(text):
        if m[4]:
            yield m[1], inside(m, 4)
        elif re.split(r"[.:]+", m[2])[-1].lower() in _GIVES_BACK:
            yield m[1], inside(m, 3)
    for m in _SETTER.finditer(text):
        yield m[1], inside(m, 2)
    for m in _BLOCK.finditer(text):
        lines = [(x.start() + m.start(2), x.end() + m.start(2)) for x in re.finditer(r"[^\s][^\n]*(?<!\s)", m[2])]
        yield m[1], Value(text, lines)
    for m in _ELEMENT.finditer(text):
        yield m[1], Value(text, [m.span(2)])
    for m in _TUPLE.finditer(text):
        names = re.findall(r"\w+", m[1])
        values = [x.span() for x in re.finditer(_STRING, m[2])]
        if len(names) == len(values):
            for name, (a, b) in zip(names, values):
                yield name, Value(text, [(m.start(2) + a + 1, m.start(2) + b - 1)])


_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# How sensitive a part of a name makes it; `key` and `auth` need a part that says what for.
_SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
    "credentials": 3, "pass": 2, "bearer": 2, "auth": 1, "key": 1, "api": 1, "access": 1, "private": 1, "signing": 1,
    "encryption": 1, "client": 1, "master": 1, "session": 1,
}
# Without one part of 2 or more, or two of 1, in the text, no name in it is sensitive.
_STEMS = tuple(p for p, n in _SENSITIVE.items() if n >= 2), tuple(p for p, n in _SENSITIVE.items() if n == 1)
# Parts that say a name holds something about a secret instead of one.
_HARMLESS = {"id", "name", "url", "uri", "path", "file", "length", "len", "size", "type", "count", "field", "prompt", "hint", "header", "public", "expiry", "ttl", "timeout", "policy", "label", "regex", "pattern"}
_PLACEHOLDER = re.compile(r"example|changeme|change_me|placeholder|your[_-]|dummy|sample|redacted|\*{3}|x{4}|\.{3}|<[^>]*+>|\$\{|\{\{|%\(", re.I)


def name_score(name: str) -> int:
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    if not parts or parts[-1] in _HARMLESS:
        return 0
    return sum(_SENSITIVE.get(p, 0) for p in set(parts))


# What a sentence shown to a reader has, and a pass phrase hasn't.
_MESSAGE_WORD = re.compile(r"\b(?:please|enter|your|must|invalid|incorrect|required|forgot|cannot|should|password|token|secret|credentials?)\b", re.I)
_MESSAGE_ENDS = frozenset(".!?:")
_KEY_BEGINS = re.compile(r"-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY(?: BLOCK)?-----")
_KEY_ENDS = "-----END "


def literal_score(value: str | Value, sensitive: int = 0) -> int:
    """0 to 4 by length and mix of characters; below 0 for what can't be a secret.

    A private key scores 4. Other values with white space may be pass phrases if their name scores 3 or more;
    they lose 1, and 3 more if they read like a message.
    """
    v = Value(value, [(0, len(value))]) if isinstance(value, str) else value
    if v.key:
        return 4
    blank = any(c.isspace() for c in v.letters)
    if v.size < 8 or blank and sensitive < 3 or v.veto:
        return -9
    lower, upper, digit = (any(a <= c <= b for c in v.letters) for a, b in ("az", "AZ", "09"))
    other = any(not (c.isascii() and c.isalnum()) for c in v.letters)
    kinds, distinct = lower + upper + digit + other, len(v.letters)
    form = (distinct >= 6) + (kinds >= 2) + (kinds >= 3 or v.size >= 20) + (distinct >= 12)
    return form - blank - 3 * (blank and (v.message or v.last in _MESSAGE_ENDS))


def key_blocks(text: str) -> list[Span]:
    """Private keys from their first to their last mark, whatever stands around them."""
    spans, at = [], 0
    while m := _KEY_BEGINS.search(text, at):
        end = text.find(_KEY_ENDS, m.end())
        if end < 0:
            break
        close = text.find("-----", end + len(_KEY_ENDS), end + 80)
        at = close + 5 if close >= 0 else end + len(_KEY_ENDS)
        spans.append((LITERAL, m.start(), at))
    return spans


def literal_spans(text: str, least: int = 5) -> list[Span]:
    """Parts of literals whose name and form together reach `least`; names alone must reach 2. Besides, all
    private keys with both marks, but for those inside such a literal."""
    blocks = key_blocks(text) if "PRIVATE KEY" in text else []
    lower = text.lower()
    strong, weak = _STEMS
    named = any(s in lower for s in strong) or sum(s in lower for s in weak) >= 2
    if not named or not any(c in text for c in "=:(<"):
        return blocks
    found, seen = set(), set()
    for name, value in assignments(text):
        sensitive = name_score(name)
        if sensitive >= 2 and sensitive + literal_score(value, sensitive) >= least:
            found.update((LITERAL, a, b) for a, b in value.spans(seen) if b > a)
    spans, reach = [], 0
    for s in sorted({*found, *blocks}, key=lambda s: (s[1], -s[2])):
        if s in found or s[2] > reach:
            spans.append(s)
        reach = max(reach, s[2])
    return spans


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans; all spans by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, LITERAL))}
    every = sorted({*base, *literal_spans(text)}, key=lambda s: (s[1], order[s[0]], s[2]))
    return base, every


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with one mark in place of each stretch that spans cover, overlapping ones together."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


# Over tables --------------------------------------------------------------------------------------

_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(find_spans: Callable):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            base, every = [], []
            for text in batch.column("text").to_pylist():
                b, e = find_spans(text)
                base.append([{"kind": k, "start": s, "end": t} for k, s, t in b])
                every.append([{"kind": k, "start": s, "end": t} for k, s, t in e])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(base, _SPAN), pa.array(every, _SPAN)], names=["id", "base", "spans"]
            )

    return scan


def scan_spans(docs: DataFrame, find_spans: Callable, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, base, spans` per row, each a list of (kind, start, end), from a function of a text."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int>>"
    return in_batches(rows, _scan(find_spans), f"id {kind}, base {span}, spans {span}").withColumnRenamed("id", id)


def find_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id, base, spans` per row; read and answered in place, without a shuffle."""
    return scan_spans(docs, find, id, text)


def spans_text(spans: str):
    """A column of spans as `kind:start:end`, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def digest_columns(found: DataFrame, kinds: tuple[str, ...], id: str = "doc_id") -> DataFrame:
    """`id, n_<kind>..., base_sha256, spans`: counts and digest of the base spans, and all spans as text."""
    counts = [_count(kind).alias(f"n_{kind}") for kind in kinds]
    return found.select(
        id, *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", size: str | None = "n_chars") -> DataFrame:
    """The documents with every span in `text` replaced; a column `size` of code points follows it.

    All other columns are handed through as they are, whatever their names; the order of columns stays.
    """
    columns = docs.columns
    resized = size if size in columns and size != text else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, text):
            old = batch.column(columns.index(text)).to_pylist()
            new = [t if not t else redacted(t, find(t)[1], mark) for t in old]
            arrays = list(batch.columns)
            arrays[columns.index(text)] = pa.array(new, batch.schema.field(columns.index(text)).type)
            if resized:
                at = columns.index(resized)
                sizes = [n if a == b else len(b) for n, a, b in zip(arrays[at].to_pylist(), old, new)]
                arrays[at] = pa.array(sizes, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return in_batches(docs, clean, docs.schema)
