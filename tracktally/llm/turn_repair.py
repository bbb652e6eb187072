"""Conversation structure repair by an auction shortest-path algorithm.

A conversation is in order if the initials of its roles read ``(s?(ua)+)?``. Its turns and the
states of that grammar (start, after system, after user, after assistant) span a lattice with
integer costs: keep a turn 0, give it the role user or assistant 2, delete it 3, insert an
empty turn 2, and 1 more for a truncated turn that stays. Blank and duplicate turns must go.

Nodes have prices, at first feasible ones: no price exceeds an arc's cost plus the price
behind it. From its last node a path is extended along an arc that meets this with equality;
if there is none the price rises to the least that fits and the path is contracted. Sources go
back through the lattice ``WINDOW`` turns at a time, so a path never contracts further. The
converged prices are an optimal dual solution: all cheapest repairs run along tight arcs, and
the one whose letters (D, I, K, R) are least is traced from those that lead to the end.

Turns are ordered by range over all partitions and cut into pieces of at most ``PIECE`` turns,
so a conversation of any length is many rows. For one of several pieces, each piece gives its
cheapest costs from state to state (16 numbers) and then, with the costs from its end onward
known, the state each entering state leads to; only these go through one task a conversation.

NULL turns come first. Turns of equal number are ordered by role, then text. NULL roles and
texts are one space, so such a text is blank. A turn of an empty role can't be kept. Rows of a
NULL conversation are one conversation. Equal rows are duplicates of their first. An empty table
has no conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracktally.llm.common import add_columns, exact, saved, slices
from tracktally.session import task_count

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the grammar's next user or assistant turn leads to, and the role of a state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What inserting the missing end costs after the last turn of a conversation.
ENDS = (0, 4, 2, 0)
NEVER = 1 << 40
WINDOW = 8
PIECE = 1_000
PIECE_CHARS = 1_000_000

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = ("su", "ua", "au")
INK = re.compile(r"[^\x20\x09-\x0D]")
LAST_INK = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


@lru_cache(maxsize=4096)
def turn_arcs(initial: str, fault: int) -> tuple:
    """For each state the arcs of a turn in letter order: letter, cost, turns on, next state."""
    made = []
    for state in range(4):
        arcs = [("D", 3, 1, state), ("I", 2, 0, NEXT[state])]
        if fault not in (BLANK, DUPLICATE):
            more = int(fault == TRUNCATED)
            if initial == "s" and state == START:
                arcs.append(("K", more, 1, SYSTEM))
            elif initial in "ua" and initial and ROLES[NEXT[state]][0] == initial:
                arcs.append(("K", more, 1, NEXT[state]))
            arcs.append(("R", 2 + more, 1, NEXT[state]))
        made.append(tuple(arcs))
    return tuple(made)


class Lattice:
    """Nodes 4 * turn + state of one piece; the last four are its exits, at the prices given."""

    def __init__(self, initials: list[str], faults: list[int], exits: tuple[int, ...]):
        self.turns = n = len(initials)
        self.price = [NEVER] * (4 * n) + list(exits)
        self.out: list[list] = [[] for _ in range(4 * n)]
        for top in range(n, 0, -WINDOW):
            low = max(0, top - WINDOW)
            self.open_layers(initials, faults, low, top)
            for source in range(4 * low, 4 * low + 4):
                if self.price[source] < NEVER:
                    self.auction(source, 4 * top)

    def open_layers(self, initials: list[str], faults: list[int], low: int, top: int) -> None:
        """Arcs to nodes from which an exit can be reached; the least price beyond is feasible."""
        price, floor = self.price, min(self.price[4 * top : 4 * top + 4])
        for k in range(top - 1, low - 1, -1):
            arcs = turn_arcs(initials[k], faults[k])
            open_ = [any(on and price[4 * k + 4 + q] < NEVER for _, _, on, q in arcs[state]) for state in range(4)]
            round_ = open_[USER] or open_[ASSISTANT]
            for state in range(4):
                if open_[state] or round_:
                    price[4 * k + state] = floor
            for state in range(4):
                if price[4 * k + state] < NEVER:
                    ends = [(letter, cost, 4 * (k + on) + q) for letter, cost, on, q in arcs[state]]
                    self.out[4 * k + state] = [arc for arc in ends if price[arc[2]] < NEVER]

    def auction(self, source: int, goal: int) -> None:
        """Raise prices until a path of tight arcs leads from the source to a node from goal on."""
        price, out, path = self.price, self.out, [source]
        while path[-1] < goal:
            i = path[-1]
            best, to = min((cost + price[j], j) for _, cost, j in out[i])
            if price[i] < best:
                price[i] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)

    def tight(self, i: int) -> list:
        return [(letter, cost, j) for letter, cost, j in self.out[i] if self.price[i] == cost + self.price[j]]

    def leading(self) -> list[bool]:
        """Nodes from which tight arcs lead to an exit."""
        lead = [False] * (4 * self.turns) + [p < NEVER for p in self.price[4 * self.turns :]]
        for k in range(self.turns - 1, -1, -1):
            for state in (USER, ASSISTANT, USER, SYSTEM, START):
                i = 4 * k + state
                lead[i] = lead[i] or any(lead[j] for _, _, j in self.tight(i))
        return lead

    def trace(self, state: int, lead: list[bool]) -> tuple[str, int, int]:
        """Letters, cost and exit state of the least of the cheapest paths from a first state."""
        letters, total, i = [], 0, state
        while i < 4 * self.turns:
            letter, cost, i = next(arc for arc in self.tight(i) if lead[arc[2]])
            letters.append(letter)
            total += cost
        return "".join(letters), total, i - 4 * self.turns


def apply_edits(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired turns of a piece that is entered in a state."""
    made, at = [], 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            made.append((ROLES[state], ""))
            continue
        if letter != "D":
            state = SYSTEM if letter == "K" and roles[at][:1] == "s" else NEXT[state]
            made.append((roles[at] if letter == "K" else ROLES[state], texts[at]))
        at += 1
    return made


def initials_of(roles: list[str]) -> list[str]:
    return [r[:1] for r in roles]


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with faults put in by the CRC of conversation and turn."""
    spelled = lambda c: F.coalesce(exact(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(spelled(conv), F.lit(":"), spelled(turn)).cast("binary")) % 20
    made = rows.select(
        exact(conv).alias("conv"), exact(turn).alias("turn"), spelled(role).alias("role"), spelled(text).alias("text"), lot.alias("lot")
    ).where("lot != 0")
    put = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return made.select(
        "conv",
        "turn",
        F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        put.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("lot") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv, turn, role, text, seen`` sorted over all partitions; seen: said at an earlier turn."""
    keyed = turns.withColumn("said", F.sha2("text", 256))
    first = keyed.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("said").alias("s")).agg(
        F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("at_null")
    )
    later = F.col("turn").isNotNull() & (F.col("at_null") | (F.col("turn") > F.col("first")))
    marked = keyed.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")))
    chosen = marked.select("conv", "turn", "role", "text", later.alias("seen"))
    order = ["conv", "turn", "role", F.substring("text", 1, 64)]
    return chosen.repartitionByRange(task_count(turns.sparkSession), *order).sortWithinPartitions("conv", "turn", "role", "text")


def cut_pieces(ordered: DataFrame, piece: int) -> DataFrame:
    """``conv, seq, roles, texts, faults``: runs of turns; seq orders the pieces of a conversation."""
    kind = ordered.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL("seq long, roles array<string>, texts array<string>, faults array<int>")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        held: list = []
        size, last = 0, None

        def flush():
            nonlocal held, size, seq
            row = [held[0][0], seq, [h[1] for h in held], [h[2] for h in held], [h[3] for h in held]]
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in slices(batches):
            for row in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "seen")), strict=True):
                conv, _, role, text, seen = row
                if held and (held[0][0] != conv or len(held) >= piece or size > PIECE_CHARS):
                    yield flush()
                if not INK.search(text):
                    fault = BLANK
                elif seen or row[:4] == last:
                    fault = DUPLICATE
                else:
                    fault = FINE if LAST_INK.search(text)[0] in ".!?" else TRUNCATED
                held.append((conv, role, text, fault))
                size += len(text)
                last = row[:4]
        if held:
            yield flush()

    return ordered.mapInArrow(run, schema)


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def entered(pieces: DataFrame) -> DataFrame:
    """``conv, seq, enter, exits`` of the pieces of conversations that have several."""
    kind = pieces.schema["conv"].dataType
    several = pieces.groupBy(F.col("conv").alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
    parts = saved(pieces.join(several, same("conv", "c"), "left_semi"), "turns-parts")

    def costs():
        def run(roles, faults):
            made = []
            for who, what in zip(roles.to_pylist(), faults.to_pylist(), strict=True):
                table = [0] * 16
                for x in range(4):
                    one = Lattice(initials_of(who), what, tuple(0 if q == x else NEVER for q in range(4)))
                    for e in range(4):
                        table[4 * e + x] = one.price[e]
                made.append(table)
            return [made]

        return run

    def backward(rows: pd.DataFrame) -> pd.DataFrame:
        rows, beyond, made = rows.sort_values("seq", ascending=False), ENDS, []
        for table in rows["costs"]:
            made.append(list(beyond))
            beyond = tuple(min(min(int(table[4 * e + x]) + beyond[x] for x in range(4)), NEVER) for e in range(4))
        return pd.DataFrame({"conv": rows["conv"], "seq": rows["seq"], "exits": made})

    def leads():
        def run(roles, faults, exits):
            made = []
            for who, what, price in zip(roles.to_pylist(), faults.to_pylist(), exits.to_pylist(), strict=True):
                lattice = Lattice(initials_of(who), what, tuple(price))
                lead = lattice.leading()
                made.append([lattice.trace(e, lead)[2] if lead[e] else -1 for e in range(4)])
            return [made]

        return run

    def forward(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, made = rows.sort_values("seq"), START, []
        for to in rows["leads"]:
            made.append(state)
            state = int(to[state])
        return pd.DataFrame({"conv": rows["conv"], "seq": rows["seq"], "enter": made})

    schema = lambda more: T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(f"seq long, {more}")])
    table = add_columns(parts, ["roles", "faults"], "costs array<long>", costs).select("conv", "seq", "costs")
    exits = saved(table.groupBy("conv").applyInPandas(backward, schema("exits array<long>")), "turns-exits")
    there = parts.join(exits.drop("conv"), "seq")
    led = add_columns(there, ["roles", "faults", "exits"], "leads array<int>", leads).select("conv", "seq", "leads")
    enter = led.groupBy("conv").applyInPandas(forward, schema("enter int"))
    return exits.select("seq", "exits").join(enter.select("seq", "enter"), "seq")


def repair_turns(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each piece of a conversation, from ``conv, turn, role, text``.

    ``conv, seq`` (orders the pieces), ``blank, duplicate, truncated, illegal`` (counts inside
    the piece), ``first, last`` (initials of its roles), ``cost, audit`` and the repaired turns
    ``roles, texts``. The last piece has what is inserted at the end.
    """
    pieces = saved(cut_pieces(ordered_turns(turns), piece), "turns-pieces")
    last = pieces.groupBy("conv").agg(F.max("seq").alias("seq"), F.lit(True).alias("final")).drop("conv")
    placed = pieces.join(last, "seq", "left").join(entered(pieces), "seq", "left")

    def make():
        def run(roles, texts, faults, exits, enter, final):
            made: list[list] = [[] for _ in range(10)]
            for who, said, what, price, state, at_end in zip(*(c.to_pylist() for c in (roles, texts, faults, exits, enter, final)), strict=True):
                state = state or START
                begins = initials_of(who)
                lattice = Lattice(begins, what, tuple(price or ENDS))
                audit, cost, out = lattice.trace(state, lattice.leading())
                turns = apply_edits(audit, state, who, said)
                if at_end:
                    for _ in range(ENDS[out] // 2):
                        audit, cost, out = audit + "I", cost + 2, NEXT[out]
                        turns.append((ROLES[out], ""))
                illegal = sum(a + b not in LEGAL for a, b in zip(begins, begins[1:]))
                row = (what.count(BLANK), what.count(DUPLICATE), what.count(TRUNCATED), illegal, begins[0], begins[-1], cost, audit)
                for column, x in zip(made, (*row, [r for r, _ in turns], [t for _, t in turns]), strict=True):
                    column.append(x)
            return made

        return run

    fields = (
        "blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, audit string,"
        " fixed_roles array<string>, fixed_texts array<string>"
    )
    done = add_columns(placed, ["roles", "texts", "faults", "exits", "enter", "final"], fields, make)
    kept = ("blank", "duplicate", "truncated", "illegal", "first", "last", "cost", "audit")
    return done.select("conv", "seq", *kept, F.col("fixed_roles").alias("roles"), F.col("fixed_texts").alias("texts"))


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """``conv, seq, at, role, text``: the repaired turns, in order by seq and at."""
    turn = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))
    return repaired.select("conv", "seq", F.posexplode(turn).alias("at", "turn")).select("conv", "seq", "at", "turn.role", "turn.text")


def summarise(repaired: DataFrame) -> DataFrame:
    """One row for each conversation with repaired turns: counts, cost, audit and the digest.

    A digest needs a conversation's turns in order: the pieces of one pass through one task,
    one at a time, and nothing but running values is kept.
    """
    kind = repaired.schema["conv"].dataType
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType(
        [T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in counts), *T.StructType.fromDDL("audit string, repaired_sha256 string")]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = []
        conv, sums, audits, digest, last, empty, begun = None, [0] * 5, [], hashlib.sha256(), "", True, False

        def close():
            made.append([conv, *sums, "".join(audits), digest.hexdigest()])

        def flush():
            columns = zip(*made) if made else [[] for _ in arrow]
            batch = pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)
            made.clear()
            return batch

        for batch in slices(batches):
            for row in batch.to_pylist():
                if not begun or row["conv"] != conv:
                    if begun:
                        close()
                    conv, sums, audits, digest, last, empty, begun = row["conv"], [0] * 5, [], hashlib.sha256(), None, True, True
                sums = [a + row[c] for a, c in zip(sums, counts, strict=True)]
                if last is not None and last + row["first"] not in LEGAL:
                    sums[3] += 1
                last = row["last"]
                audits.append(row["audit"])
                for role, text in zip(row["roles"], row["texts"], strict=True):
                    digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                    empty = False
            yield flush()
        if begun:
            close()
            yield flush()

    return repaired.repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(run, schema)


def audit_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece: int = PIECE
) -> DataFrame:
    """``conv, gaps`` and what `summarise` gives for every conversation of ``rows``, damaged first."""
    turns = saved(damage(rows, conv, turn, role, text), "turns-damaged")
    gaps = (
        turns.where("turn is not null")
        .select("conv", "turn")
        .distinct()
        .groupBy(F.col("conv").alias("g"))
        .agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    )
    found = summarise(repair_turns(turns, piece)).withColumnRenamed("conv", "f")
    every = rows.select(exact(conv).alias("conv")).distinct()
    joined = every.join(gaps, same("conv", "g"), "left").join(found, same("conv", "f"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select(
        "conv",
        *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
