"""Near-duplicate documents by DartMinHash, banded joining and exact checks.

A text is the multiset of its shingles (five words, lower case), a weighted set. Darts fall
as a Poisson process on weight x time: slabs of the weight axis are [0, 1), [1, 2), [2, 4),
..., cells along the time axis hold one dart on average, and the darts of a cell follow from
the hash of (shingle, slab, cell). Each dart has a weight, a time and a signature
coordinate; those inside the text's weights before a time limit count, and the earliest at a
coordinate is its entry. Two texts agree at a coordinate with the probability of their
weighted Jaccard similarity, and a signature costs about as many darts as it has entries
times the log of that, however many shingles there are.

Bands of entries give candidate groups. No group is expanded into all its pairs: members
are compared with the group's leader, the one that shares most with others; those below the
threshold with the leader among them, for ``ROUNDS`` rounds. Links that leaders can't show remain where a group's members
are in different classes; those members meet by their rarest shingles, first leaders of
classes in rounds, then all pairs of different classes that sizes and places of a common
shingle allow. So every such link is found; pairs of one class are not compared.

Equal texts (after lower-casing and white space) are one class from the start, told apart by
64 hash bits, and go on as one. Texts under five words have one shingle, the whole text; NULL
and empty texts have none, are equal to each other and like no other. Rows of one id with
different texts are different members. A class has the name of its smallest id, which classes
can share where ids repeat or are NULL; its smallest node, ``cls``, is its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracktally.llm.common import add_columns, chunks, exact, saved, texts_of

SHINGLE = 5
SIMILAR = 0.8
#: 36 bands of 9 entries meet with probability 0.994 at 0.8, 0.9999 at 0.85.
BANDS, ROWS = 36, 9
#: Entries expected empty at first: COORDINATES * exp(-SURE); such texts get more darts.
SURE = 3.0
#: Rounds of comparing the members of band groups with leaders.
ROUNDS = 2
#: Rounds without a merge after which the leaders of rare shingles are done.
IDLE = 2
#: Members of a key that the others face in one task, when what rounds left over is compared.
BLOCK = 1_000
#: What a text's darts take, in characters of text, when texts are grouped into steps.
DART_CHARS = 4_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: P(Poisson(1) <= n); a cell has at most as many darts as there are entries.
POISSON = np.cumsum(1.0 / np.cumprod(np.r_[1.0, np.arange(1.0, 15.0)])) / np.e


def spread(x: np.ndarray) -> np.ndarray:
    """Hash values spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """The upper 53 bits as a number in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and count of every distinct shingle, by text and hash."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.array([w for ws in words for w in ws], dtype=object)
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    n = len(hashed)
    window = np.zeros(n, np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # words of the text from here on
    for i in range(SHINGLE):
        part = np.zeros(n, np.uint64)
        part[: max(0, n - i)] = hashed[i:] * MIX[i]
        window += np.where(left > i, part, np.uint64(0))  # a short text's words and no more
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.r_[True, owner[1:] != owner[:-1]] if n else np.zeros(0, bool)
    kept = (left >= SHINGLE) | first  # the first stands for all of a short text
    owner, window = owner[kept], spread(window[kept])
    order = np.lexsort((window, owner))
    owner, window = owner[order], window[order]
    if not len(owner):
        return owner, window, np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (window[1:] != window[:-1])])
    return owner[start], window[start], np.diff(np.r_[start, len(owner)])


def throw(n: int, owner: np.ndarray, mark: np.ndarray, count: np.ndarray, limit: np.ndarray, k: int) -> np.ndarray:
    """Earliest dart times, ``n`` texts by ``k`` coordinates; infinite where no dart fell.

    ``limit`` is the time up to which each text's darts are looked at.
    """
    earliest = np.full(n * k, np.inf)
    slab = 0
    while len(owner):
        low, width = (0.0, 1.0) if slab == 0 else (float(1 << (slab - 1)), float(1 << (slab - 1)))
        cells = np.floor(limit[owner] * width).astype(np.int64) + 1
        at = np.repeat(np.arange(len(owner)), cells)
        number = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        named = spread(mark[at] + np.full(1, slab, np.uint64) * MIX[1] + number.astype(np.uint64) * MIX[0])
        darts = np.searchsorted(POISSON, unit(named), "right")
        many = np.repeat(np.arange(len(at)), darts)
        which = np.arange(len(many)) - np.repeat(np.cumsum(darts) - darts, darts)
        one = spread(named[many] + (which.astype(np.uint64) + np.uint64(1)) * MIX[2])
        own = at[many]
        weight = low + width * unit(one * MIX[3])
        time = (number[many] + unit(spread(one + MIX[4]))) / width
        inside = (weight < count[own]) & (time < limit[owner[own]])
        key = owner[own[inside]] * k + (spread(one[inside] ^ MIX[2]) % np.uint64(k)).astype(np.int64)
        np.minimum.at(earliest, key, time[inside])
        more = count > low + width
        owner, mark, count = owner[more], mark[more], count[more]
        slab += 1
    return earliest.reshape(n, k)


def signatures(texts: list[str], k: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash entries of each text as 64-bit numbers; rows without words are all zero."""
    owner, mark, count = shingles(texts)
    weight = np.bincount(owner, count, len(texts)) if len(owner) else np.zeros(len(texts))
    limit = np.divide(k * (np.log(k) + SURE), weight, out=np.zeros(len(texts)), where=weight > 0)
    found = throw(len(texts), owner, mark, count, limit, k)
    while (short := np.flatnonzero(np.isinf(found).any(1) & (weight > 0))).size:
        limit[short] *= 2
        new = np.full(len(texts), -1)
        new[short] = np.arange(len(short))
        own = new[owner] >= 0
        found[short] = throw(len(short), new[owner[own]], mark[own], count[own], limit[short], k)
    found[weight == 0] = 0.0
    return found.view(np.uint64)


def similarity(a: list[str], b: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of texts, pair by pair."""
    made = []
    for start, end in chunks([len(x) + len(y) for x, y in zip(a, b, strict=True)]):
        n = end - start
        owner, mark, count = shingles(a[start:end] + b[start:end])
        pair = owner % n
        order = np.lexsort((mark, pair))
        pair, mark, count = pair[order], mark[order], count[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (mark[1:] == mark[:-1])) if len(pair) else np.zeros(0, np.int64)
        common = np.bincount(pair[same], np.minimum(count[same], count[same + 1]), n)
        total = np.bincount(pair, count, n) if len(pair) else np.zeros(n)
        made.append(np.divide(common, total - common, out=np.zeros(n), where=total > common))
    return np.concatenate(made) if made else np.zeros(0)


def text_node(text: Column) -> Column:
    """64 bits that stand for a text, upper and lower case and white space aside."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))))


def band_keys(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Each row with ``keys``, one number for each band of its text's signature."""

    def make():
        def run(column):
            made: list = []
            texts = texts_of(column)
            for start, end in chunks([len(t) + DART_CHARS for t in texts], 1_000_000):
                entries = signatures(texts[start:end], bands * rows).reshape(end - start, bands, rows)
                key = np.zeros((end - start, bands), np.uint64)
                for i in range(rows):
                    key = spread(key * MIX[0] + entries[:, :, i])
                key = spread(key + np.arange(bands, dtype=np.uint64) * MIX[3])
                empty = (entries == 0).all((1, 2))
                made += [[] if e else x for e, x in zip(empty, key.view(np.int64).tolist(), strict=True)]
            return [made]

        return run

    return add_columns(docs, ["text"], "keys array<long>", make)


def shared_groups(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``grp, id`` rows of the band keys that more than one text has, and the id's ``rank``.

    The rank is how many rows an id's groups have: the centre of a cluster has most.
    """
    each = saved(keyed.groupBy("node").agg(F.first("keys").alias("keys")), "dart-nodes")
    each = each.select(F.col("node").alias("id"), F.explode("keys").alias("grp"))
    shared = each.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = saved(each.join(shared, "grp").select("id", "grp", "n"), "dart-groups")
    return rows, saved(rows.groupBy("id").agg(F.sum("n").alias("rank")), "dart-ranks")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` rows with ``sim``. Texts are fetched by id, never for all pairs at once."""

    def make():
        return lambda left, right: [similarity(texts_of(left), texts_of(right)).tolist()]

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("right"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    return add_columns(both, ["left", "right"], "sim double", make).select("a", "b", "sim")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, cls``: the smallest id that links lead to.

    Each round takes the smallest class among neighbours and then the class of that class;
    links of one class drop out. Rounds grow with the log of a chain's length.
    """
    both = saved(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dart-links")
    state = saved(nodes.select("id", F.col("id").alias("cls")), "dart-classes")
    while True:
        near = (
            both.join(state.select(F.col("id").alias("b"), F.col("cls").alias("other")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("other").alias("other"))
        )
        # a class follows the smallest class that any of its members is linked to
        moved = (
            state.join(near, "id")
            .where(F.col("other") < F.col("cls"))
            .groupBy(F.col("cls").alias("id"))
            .agg(F.min("other").alias("to"))
        )
        moved = saved(moved, "dart-moves")
        if moved.isEmpty():
            return state
        hop = saved(
            moved.alias("m")
            .join(moved.alias("n"), F.col("m.to") == F.col("n.id"), "left")
            .select(F.col("m.id").alias("cls"), F.coalesce("n.to", "m.to").alias("to")),
            "dart-hops",
        )
        state = saved(state.join(hop, "cls", "left").select("id", F.coalesce("to", "cls").alias("cls")), "dart-classes")


def elements(texts: list[str]) -> list[np.ndarray]:
    """Shingles of each text with their repeats told apart: a set as large as the multiset."""
    made: list[np.ndarray] = []
    for start, end in chunks([len(t) for t in texts]):
        owner, mark, count = shingles(texts[start:end])
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        one = spread(np.repeat(mark, count) + which.astype(np.uint64) * MIX[1])
        sizes = np.bincount(owner, count, end - start).astype(np.int64) if len(owner) else np.zeros(end - start, np.int64)
        made += np.split(one.view(np.int64), np.cumsum(sizes)[:-1])
    return made


def early_elements(apart: DataFrame, least: float) -> DataFrame:
    """``key, id, n, at`` from ``id, text``: the rare elements by which close texts meet.

    With its elements in order of how rare they are, a text that reaches ``least`` with
    another shares one of its first n - ceil(least * n) + 1 with that one's first, and from
    the first common element on both have enough left for the overlap needed. Sizes that allow
    it share a cell of one of two shifted grids, which is part of the key.
    """

    def make():
        return lambda column: [[x.tolist() for x in elements(texts_of(column))]]

    listed = saved(add_columns(apart, ["text"], "e array<long>", make).select("id", "e"), "dart-elements")
    each = listed.select("id", F.size("e").alias("n"), F.explode("e").alias("e"))
    often = each.groupBy("e").agg(F.count(F.lit(1)).alias("often"))
    ordered = (
        each.join(often, "e")
        .groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("often", "e"))).getField("e").alias("e"))  # one text's
    )
    first = F.slice("e", F.lit(1), F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1)
    reach = F.floor(-F.log(F.col("n").cast("double")) / F.log(F.lit(least)) * (1 - 1e-9))
    cells = F.array(*(F.xxhash64("e", F.lit(grid), F.floor((reach + grid) / 2)) for grid in (0, 1)))
    early = ordered.select("id", "n", F.posexplode(first).alias("at", "e"))
    return saved(early.select("id", "n", "at", F.explode(cells).alias("key")), "dart-early")


def facing_leaders(early: DataFrame, classes: DataFrame, least: float, number: int) -> DataFrame:
    """``a, b`` pairs of this round: at each key one class leads, and a member of it faces one of each other class.

    Rows grow with the classes at a key, never with their pairs; which class leads and which
    members stand for classes changes from round to round.
    """
    member = F.struct(F.xxhash64("id", F.lit(number)).alias("lot"), "id", "n", "at")
    kinds = saved(early.join(classes, "id").groupBy("key", "cls").agg(F.min(member).alias("one")), "dart-kinds")
    turn = F.struct(F.xxhash64("key", "cls", F.lit(number)).alias("lot"), F.col("cls").alias("lead"), F.col("one").alias("head"))
    leads = kinds.groupBy("key").agg(F.min(turn).alias("turn"), F.count(F.lit(1)).alias("many")).where("many > 1")
    left = F.least(F.expr("one.n - one.at"), F.expr("turn.head.n - turn.head.at"))
    enough = left * (1 + least) >= least * (F.expr("one.n") + F.expr("turn.head.n")) - 1e-6
    return (
        kinds.join(leads, "key")
        .where((F.col("cls") != F.expr("turn.lead")) & enough)
        .select(F.expr("least(one.id, turn.head.id)").alias("a"), F.expr("greatest(one.id, turn.head.id)").alias("b"))
        .distinct()
    )


def open_pairs(early: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``a, b``: all pairs of different classes that may reach ``least``, each once.

    At a key the members of its largest class do not meet each other: the others meet all
    members, dealt out in blocks of ``BLOCK``. Work grows with those others times the members.
    """
    member = early.join(classes, "id")
    kinds = member.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("many"))
    split = (
        kinds.groupBy("key")
        .agg(F.max_by("cls", F.struct("many", "cls")).alias("home"), F.sum("many").alias("m"), F.count(F.lit(1)).alias("kinds"))
        .where("kinds > 1")
        .select("key", "home", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    )
    here = saved(member.join(split, "key").select("key", "blocks", "id", "n", "at", "cls", (F.col("cls") != F.col("home")).alias("out")), "dart-here")
    right = here.select("key", F.expr("pmod(xxhash64(id), blocks)").cast("int").alias("block"), F.struct("id", "n", "at", "cls").alias("y"))
    left = here.where("out").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.struct("id", "n", "at", "cls").alias("x"))
    enough = F.least(F.expr("x.n - x.at"), F.expr("y.n - y.at")) * (1 + least) >= least * (F.expr("x.n + y.n")) - 1e-6
    met = (left.key == right.key) & (left.block == right.block) & (F.col("x.cls") != F.col("y.cls")) & enough
    return left.join(right, met).select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")).distinct()


def leader_rounds(texts: DataFrame, classes: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Links between different classes of ``id, cls``, by rounds in which classes merge.

    The rounds end when ``IDLE`` of them running merged nothing; classes that merged never meet
    again. What may be left between different classes then is compared in full.
    """
    early = early_elements(texts.join(classes, "id").select("id", "text"), least)
    made, number, idle = known.where(F.lit(False)), 0, 0
    while idle < IDLE:
        pairs = facing_leaders(early, classes, least, number).join(known, ["a", "b"], "left_anti")
        fresh = saved(compared(pairs, texts), "dart-compared")
        known, number = known.unionAll(fresh), number + 1
        links = fresh.where(F.col("sim") >= least)
        if links.isEmpty():
            idle += 1
            continue
        idle, made = 0, made.unionAll(links)
        side = lambda c: classes.select(F.col("id").alias(c), F.col("cls").alias(f"{c}_cls"))
        ends = saved(links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct(), "dart-ends")
        nodes = ends.select(F.col("a").alias("id")).unionAll(ends.select(F.col("b").alias("id"))).distinct()
        moved = components(nodes, ends).select(F.col("id").alias("cls"), F.col("cls").alias("to"))
        classes = saved(classes.join(moved, "cls", "left").select("id", F.coalesce("to", "cls").alias("cls")), "dart-contracted")
    rest = open_pairs(early, classes, least).join(known, ["a", "b"], "left_anti")
    return made.unionAll(saved(compared(rest, texts), "dart-rest").where(F.col("sim") >= least))


def verified_links(groups: DataFrame, ranks: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a, b`` links of at least ``least`` among the members of each group."""
    member = saved(groups.select("grp", "id").join(ranks, "id"), "dart-members")
    known = None  # pairs that were compared, with their similarity
    open_ = member
    for _ in range(ROUNDS):
        lead = open_.groupBy("grp").agg(F.min(F.struct(-F.col("rank"), F.col("id"))).getField("id").alias("lead"))
        led = saved(open_.join(lead, "grp").where(F.col("id") != F.col("lead")).select("grp", "id", "rank", "lead"), "dart-led")
        if led.isEmpty():
            break
        pairs = led.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        fresh = saved(compared(pairs, texts), "dart-compared")
        known = fresh if known is None else known.unionAll(fresh)
        judged = led.join(known, (F.least("lead", "id") == F.col("a")) & (F.greatest("lead", "id") == F.col("b")))
        open_ = saved(judged.where(F.col("sim") < least).select("grp", "id", "rank"), "dart-open")
    if known is None:
        return groups.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    known = saved(known, "dart-known")
    # links that leaders did not show: between members of different classes
    classes = components(groups.select("id").distinct(), known.where(F.col("sim") >= least))
    classed = member.join(classes, "id")
    split = classed.groupBy("grp").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    apart = saved(classed.join(split.select("grp"), "grp", "left_semi").select("id", "cls").distinct(), "dart-apart")
    late = leader_rounds(texts, apart, known, least)
    return known.where(F.col("sim") >= least).unionAll(late).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least: float = SIMILAR,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``id, node, class_id, cls`` of every row; the class is named by its smallest id.

    ``node`` stands for the row's text, ``cls`` is the smallest node of the class: it tells
    apart classes whose smallest ids are equal or NULL. Texts are read twice: for the signatures, and again
    for the few that share a band with another.
    """
    noded = docs.select(exact(id).alias("id"), text_node(exact(text)).alias("node"), exact(text).alias("text"))
    keyed = saved(band_keys(noded, bands, rows).select("id", "node", "keys"), "dart-keys")
    groups, ranks = shared_groups(keyed.select("node", "keys"))
    texts = noded.select("node", "text").join(ranks.select(F.col("id").alias("node")), "node", "left_semi")
    texts = saved(texts.groupBy("node").agg(F.max("text").alias("text")).withColumnRenamed("node", "id"), "dart-texts")
    links = verified_links(groups, ranks, texts, least)
    classes = components(ranks.select("id"), links)
    first = keyed.groupBy("node").agg(F.min("id").alias("least"))
    named = first.join(classes.withColumnRenamed("id", "node"), "node", "left").withColumn("cls", F.coalesce("cls", "node"))
    smallest = named.groupBy("cls").agg(F.min("least").alias("class_id"))
    final = named.join(smallest, "cls").select("node", "class_id", "cls")
    return keyed.select("id", "node").join(final, "node").select(F.col("id").alias(id), "node", "class_id", "cls")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row of each class: that of its smallest id, and of equal such rows only one.

    Classes are told apart by ``cls``, so rows of other texts under one id or without an id
    stay. All columns of ``docs`` stay.
    """
    classes = near_duplicates(docs, id, text, least)
    own = classes.where(F.col("class_id").eqNullSafe(exact(id)))
    leaders = own.groupBy("cls").agg(F.min("node").alias("__node"), F.min("class_id").alias("__id"))
    leaders = saved(leaders.select("__id", "__node"), "dart-leaders")
    kept = docs.withColumn("__own", text_node(exact(text))).join(
        leaders, exact(id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__node"))
    )
    return kept.dropDuplicates(["__id", "__node"]).select([exact(c) for c in docs.columns])
