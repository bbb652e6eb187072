"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample.

Words are runs without ASCII white space (space, tab to carriage return). NULL and
empty texts have no words and are rejected. Equal texts always get equal verdicts, so
ties and repeated rows need no care; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracktally.llm.common import add_columns, exact, texts_of

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
#: Letters (any byte above ASCII counts as one) become "a", white space stays, the rest ".".
SHAPE = bytes(0x61 if x in LETTERS or x > 127 else x if x in WHITE else 0x2E for x in range(256))
#: Words of a window, and multipliers that make one number of their hashes.
WINDOW = 8
MIX = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(WINDOW)], dtype=np.uint64)
#: Documents whose text times the rules. They order the rules and decide nothing else.
SAMPLE_DOCS = 400


class Statistics:
    """Counts of one text, each made when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.data = text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.data) - len(self.data.translate(None, WHITE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n <= WINDOW:
            return 0
        hashes = np.fromiter(map(hash, self.words), np.int64, n).view(np.uint64)
        starts = n - WINDOW + 1
        windows = np.zeros(starts, np.uint64)
        for i in range(WINDOW):
            windows += hashes[i : i + starts] * MIX[i]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return 0
        again = np.zeros(starts, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        edges = np.zeros(n + 1, np.int64)
        edges[:starts] += again
        edges[WINDOW:] -= again
        return int((np.cumsum(edges) > 0).sum())

    @cached_property
    def n_upper(self) -> int:
        return len(self.data) - len(self.data.translate(None, UPPER))

    @cached_property
    def n_letters(self) -> int:
        return len(self.data) - len(self.data.translate(None, LETTERS))

    @cached_property
    def n_bare_words(self) -> int:
        return sum(b"a" not in w for w in self.data.translate(SHAPE).split())


Rule = Callable[[Statistics], bool]

#: What a text is rejected for. A text goes when any rule holds, so the order is free.
RULES: dict[str, Rule] = {
    "few_words": lambda s: s.n_words < 20,
    "repeated_passages": lambda s: 100 * s.n_repeat_words > 30 * s.n_words,
    "symbols": lambda s: 10 * s.n_symbols > s.n_words,
    "upper_case": lambda s: 2 * s.n_upper > s.n_letters,
    "bare_words": lambda s: 5 * s.n_bare_words > s.n_words,
    "word_length": lambda s: s.word_chars > 12 * s.n_words or s.word_chars < 2 * s.n_words,
    "exclamations": lambda s: 2 * s.text.count("!") > s.n_words,
    "repeated_lines": lambda s: 2 * s.n_dup_lines > len(s.lines),
}
BASE = ("few_words", "repeated_passages")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def sample_rules(
    docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text", sample: int = SAMPLE_DOCS
) -> list[tuple[dict[str, float], dict[str, bool]]]:
    """Seconds and verdicts of every rule on some ``sample`` documents."""
    names = list(rules)
    spread = docs.select(exact(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).limit(sample)

    def make():
        def run(column):
            seconds, verdicts = [], []
            for t in texts_of(column):
                took, said = [], []
                for name in names:
                    stats = Statistics(t)  # anew, so that no rule profits from another's work
                    began = time.perf_counter()
                    said.append(bool(rules[name](stats)))
                    took.append(time.perf_counter() - began)
                seconds.append(took)
                verdicts.append(said)
            return [seconds, verdicts]

        return run

    found = add_columns(spread, ["text"], "seconds array<double>, verdicts array<boolean>", make)
    return [
        (dict(zip(names, r.seconds, strict=True)), dict(zip(names, r.verdicts, strict=True)))
        for r in found.select("seconds", "verdicts").collect()
    ]


def order_rules(measured: list[tuple[dict[str, float], dict[str, bool]]], names: list[str]) -> list[str]:
    """Next comes the rule that rejects most for its cost among what the earlier ones kept."""
    left, order, rest = list(range(len(measured))), [], list(names)
    cost = {n: sum(m[0][n] for m in measured) / max(1, len(measured)) + 1e-9 for n in names}
    while rest:
        gain = {n: (sum(measured[i][1][n] for i in left) + 1e-3) / cost[n] for n in rest}
        best = max(rest, key=lambda n: gain[n])
        order.append(best)
        rest.remove(best)
        left = [i for i in left if not measured[i][1][best]]
    return order


def quality_cascade(
    docs: DataFrame,
    rules: dict[str, Rule] = RULES,
    text: str = "text",
    order: list[str] | None = None,
    counts: bool = False,
) -> DataFrame:
    """Each row with ``kept`` and ``failed_rule``, the first of the cascade that held.

    ``kept`` does not depend on the order, ``failed_rule`` does. With ``counts`` the
    statistics of the base rules are added, for which nothing can be skipped. Columns of
    these names are replaced. NULL text counts as empty.
    """
    order = order or order_rules(sample_rules(docs, rules, text), list(rules))
    fields = "failed_rule string, kept boolean"
    if counts:
        fields = "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, " + fields

    def make():
        cascade = [(name, rules[name]) for name in order]

        def run(column):
            made: list[list] = [[] for _ in range(2 + counts * (len(COUNTS) + 1))]
            for t in texts_of(column):
                stats = Statistics(t)
                failed = next((name for name, rule in cascade if rule(stats)), None)
                row = [failed, failed is None]
                if counts:
                    row = [*(getattr(stats, c) for c in COUNTS), any(rules[b](stats) for b in BASE if b in rules), *row]
                for column_, value in zip(made, row, strict=True):
                    column_.append(value)
            return made

        return run

    return add_columns(docs, [text], fields, make)
