"""Secrets by linking the parts of a credential that stand close together.

Base kinds are reported wherever they match: ``assign`` (a keyword given a value of 8 or
more characters), ``access`` (an access key id) and ``hex`` (32 or more hex digits).
Weak kinds say little alone: ``identifier`` (a user or client name), ``blob`` (a long mixed
token) and ``endpoint`` (an address). An interval join inside a scope (lines between blank
lines) links parts at most ``REACH`` characters apart, and a weak part is reported only when
what completes it is in reach:

- an identifier needs a secret (``assign``, ``hex`` or ``blob``),
- a blob needs an identifier (``access`` or ``identifier``),
- an endpoint needs both.

The name of a secret key (``secret_access_key``, ``SecretAccessKey``) is no identifier, nor is
a bare ``access_key`` with a blob as its value; these values are blobs. A blob that is the
whole value of an identifier belongs to that.

Positions are code points, ends exclusive. NULL text counts as empty and has no spans.
Every row is scanned alone and whole, so repeated rows and ids give repeated answers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracktally.llm.common import add_columns, exact, texts_of

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "blob", "endpoint")
BASE_KINDS = KINDS[:3]
REACH = 300
MASK = "[SECRET]"

ANY_CASE = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ANY_CASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HEX_SHAPE = bytes(104 if x in b"0123456789abcdef" else 46 for x in range(256))
IDENTIFIER = re.compile(
    r"""(?:access_?key_?id|(?P<bare>(?<!secret)(?<!secret[_.-])access_?key)|client_?id|user(?:_?name|_?id)?|login|account)"""
    r"""["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9._@+-]{3,})""",
    ANY_CASE,
)
IDENTIFIER_WORDS = (b"accesskey", b"access_key", b"client", b"user", b"login", b"account")
BLOB = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(
    r"""(?:https?|ftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s"'<>]+"""
    r"""|(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::\d+)?""",
    ANY_CASE,
)
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
BLANK_LINES = re.compile(r"\n[ \t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str, data: bytes, lower: bytes) -> list[Span]:
    found: list[Span] = []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in data:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"h" * 32 in data.translate(HEX_SHAPE):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def mixed(token: str) -> bool:
    """Lower and upper case and digits, and many different characters."""
    return (
        any(c.isdigit() for c in token)
        and any("a" <= c <= "z" for c in token)
        and any("A" <= c <= "Z" for c in token)
        and 2 * len(set(token)) >= min(len(token), 40)
    )


class Intervals:
    """Sorted disjoint spans that answer whether any of them meets an interval."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((s, e) for _, s, e in spans)
        self.starts, self.ends = [s for s, _ in ordered], []
        for _, e in ordered:
            self.ends.append(max(e, self.ends[-1]) if self.ends else e)

    def meet(self, low: int, high: int) -> bool:
        i = bisect_right(self.ends, low)
        return i < len(self.starts) and self.starts[i] < high


def identifier_parts(text: str) -> tuple[list[Span], dict[int, int]]:
    """Identifiers, and the start of the whole name by the end of each one's value."""
    found: list[Span] = []
    names: dict[int, int] = {}
    for m in IDENTIFIER.finditer(text):
        if m["bare"] and (key := BLOB.match(text, m.start("value"))) and mixed(key[0]):
            continue  # the secret half of a pair
        found.append(("identifier", *m.span()))
        at = m.start()
        while at and text[at - 1] in NAME_CHARS:
            at -= 1
        names[m.end()] = at
    return found, names


def linked_spans(text: str) -> list[Span]:
    """All spans of one text: base kinds, and weak kinds that found their complement."""
    data = text.encode()
    lower = data.lower()
    base = base_spans(text, data, lower)
    identifiers = [s for s in base if s[0] == "access"]
    weak_ids: list[Span] = []
    names: dict[int, int] = {}
    if any(w in lower for w in IDENTIFIER_WORDS):
        weak_ids, names = identifier_parts(text)
        identifiers = identifiers + weak_ids
    found = list(base)
    if identifiers:
        taken = Intervals(base)
        blobs = [
            ("blob", *m.span())
            for m in BLOB.finditer(text)
            if mixed(m[0]) and not m.start() >= names.get(m.end(), m.end()) and not taken.meet(m.start(), m.end())
        ]
        secrets = blobs + [s for s in base if s[0] in ("assign", "hex")]
        if secrets:
            endpoints = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
            cuts = [m.start() for m in BLANK_LINES.finditer(text)]
            by_id, by_secret = Intervals(identifiers), Intervals(secrets)

            def near(part: Span, others: Intervals) -> bool:
                i = bisect_left(cuts, part[1])
                low = max(part[1] - REACH, cuts[i - 1] if i else 0)
                high = min(part[2] + REACH, cuts[i] if i < len(cuts) else len(text))
                return others.meet(low, high)

            found += [p for p in weak_ids if near(p, by_secret)]
            found += [p for p in blobs if near(p, by_id)]
            found += [p for p in endpoints if near(p, by_id) and near(p, by_secret)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row with ``secrets``: its spans by start, then kind.

    An input column ``secrets`` is replaced; all others stay.
    """

    def make():
        def run(column):
            return [[[{"kind": k, "start": s, "end": e} for k, s, e in linked_spans(t)] for t in texts_of(column)]]

        return run

    return add_columns(docs, [text], "secrets array<struct<kind: string, start: long, end: long>>", make)


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """Each row with every reported span of its text masked; NULL stays NULL.

    Overlapping spans become one mask. Other columns and their order stay.
    """

    def make():
        def run(column):
            made = []
            for t in column.to_pylist():
                spans = linked_spans(t) if t else []
                if spans:
                    parts, at = [], 0
                    for _, start, end in spans:
                        if start >= at:
                            parts += [t[at:start], mask]
                        at = max(at, end)
                    t = "".join(parts) + t[at:]
                made.append(t)
            return [made]

        return run

    return add_columns(docs, [text], f"`{text}` string", make).select([exact(c) for c in docs.columns])


def spans_text(spans) -> F.Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
