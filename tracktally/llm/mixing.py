"""Mixing sources to target weights by exact cuts in a hash-random order.

Every row gets a random key by hashing its id; the keys are dealt into ranges (cells). The
words of each (source, cell) are summed, running sums over the cells find the range in which
a source's budget ends, and only that range's rows are sorted and summed row by row to find
the exact cut. What is kept of a source is then a comparison of each row with its source's
cut, so the texts never move. A budget above the source's size repeats whole epochs first.

Sizes are counts of words (runs without ASCII white space); NULL text has none. A NULL
source is a source of its own, last in the order. Rows of one id and size share a cut
evenly, rounded down. The table of sources has one row per source of the mixture and is
ranked in one task; all else is spread by (source, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracktally.llm.common import exact, saved

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating, and the most of a source's size.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Ranges of the random keys within a source.
CELL_BITS = 12
KEY_BITS = 60


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(identity: Column, seed: int) -> Column:
    """60 hash bits of (seed, id) as a long."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size`` rows with ``target``: shares by weight, none above ``most`` times its size.

    The shares are those of filling by weight until the sources that are full drop out: in
    order of size per weight, the first source that its share does not fill ends the full ones.
    """
    ranked = sizes.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    upto = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = ranked.select(
        "source",
        "source_size",
        "weight",
        F.row_number().over(by_room).alias("step"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * most).alias("left"),
        F.sum("weight").over(onward).alias("sharing"),
    ).withColumn("open", F.col("left") * F.col("weight") <= F.col("source_size") * F.col("sharing") * most)
    first = F.min(F.when(F.col("open"), F.struct("step", "left", "sharing"))).over(whole)
    return stepped.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("step") < F.col("first.step"), F.col("source_size") * most)
        .otherwise(F.col("first.left") * F.col("weight") / F.col("first.sharing"))
        .cast("double")
        .alias("target"),
    )


def source_cuts(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source from rows of ``source, key, size``.

    ``epochs`` whole takes, then all rows before ``(cut_key, cut_size)``, then ``share``
    words of each row at the cut. ``keyed`` is read twice.
    """
    cell = F.shiftright("key", KEY_BITS - CELL_BITS)
    cells = keyed.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    budget = F.floor(F.col("target") + 0.5)
    plans = source_targets(sizes, weights, most).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("epochs"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0).alias("rest"),
    )
    plans = saved(plans, "mix-plans")
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ending = (
        placed.alias("c")
        .join(plans.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("c.source").alias("source"), "cell", (F.col("rest") - F.col("before")).alias("rest"))
    )
    ending = saved(ending, "mix-cells")
    rows = (
        keyed.withColumn("cell", cell)
        .alias("k")
        .join(ending.alias("e"), F.col("k.source").eqNullSafe(F.col("e.source")) & (F.col("k.cell") == F.col("e.cell")))
        .groupBy(F.col("k.source").alias("source"), "key", "size", "rest")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    along = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        rows.withColumn("room", F.col("rest") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(along), F.lit(0)))
        .where((F.col("room") >= 0) & (F.col("room") < F.col("size") * F.col("n")))
        .select("source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.floor(F.col("room") / F.col("n")).alias("share"))
    )
    return plans.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select(
        "p.*", "cut_key", "cut_size", "share"
    ).drop("rest")


def taken_words(key: Column, size: Column) -> Column:
    """Words taken of a row that stands beside its source's row of ``source_cuts``."""
    at = F.struct(key.alias("a"), size.alias("b"))
    cut = F.struct(F.col("cut_key").alias("a"), F.col("cut_size").alias("b"))
    extra = F.when(F.col("cut_key").isNull() | (at > cut), F.lit(0)).when(at < cut, size).otherwise(F.least(size, F.col("share")))
    return (F.col("epochs") * size + extra).cast("long")


def mix_sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """``id, size, source_size, target, taken`` of every row; the texts are read once."""
    keyed = saved(
        docs.select(
            exact(id).alias("id"),
            exact(source).alias("source"),
            n_words(exact(text)).alias("size"),
            random_key(exact(id), seed).alias("key"),
        ),
        "mix-keys",
    )
    cuts = saved(source_cuts(keyed.select("source", "key", "size")), "mix-cuts")
    return (
        keyed.alias("k")
        .join(cuts.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source")))
        .select(F.col("id").alias(id), "size", "source_size", "target", taken_words(F.col("key"), F.col("size")).alias("taken"))
    )


def mix_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """The mix itself: rows of ``docs`` repeated as often as they are taken, others gone.

    A row that the budget cuts comes once more with only its first words, so a source's
    words add up to its budget. All columns stay; only that text is shortened.
    """
    size, key = n_words(exact(text)), random_key(exact(id), seed)
    keyed = saved(docs.select(exact(source).alias("source"), size.alias("size"), key.alias("key")), "mix-keys")
    cuts = saved(source_cuts(keyed), "mix-cuts").select(
        F.col("source").alias("__source"), "epochs", "cut_key", "cut_size", "share"
    )
    row = docs.select(F.struct(*[exact(c) for c in docs.columns]).alias("row"), exact(source).alias("__s"), size.alias("__size"), key.alias("__key"))
    taken = row.join(cuts, F.col("__s").eqNullSafe(F.col("__source"))).select(
        "row", "__size", taken_words(F.col("__key"), F.col("__size")).alias("__taken")
    )
    copies = taken.where(F.col("__taken") > 0).select(
        "row",
        "__size",
        "__taken",
        F.explode(F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")).cast("int"))).alias("__copy"),
    )
    part = F.least(F.col("__size"), F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")).cast("int")
    pieces = F.regexp_extract_all(F.col("row").getField(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(part < F.col("__size"), F.array_join(F.slice(pieces, F.lit(1), part), "")).otherwise(F.col("row").getField(text))
    return copies.select(*[(cut if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
