"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the smallest hash among its inner s-mers stands at
its first or last place. Whether it is one depends on the k-mer alone, so an edit moves no
anchor beyond k characters from it. A text of under ``2 * K - S - 1`` code points may have
none, so all its ``SHORT``-mers are anchors too. A fingerprint is every
anchor of the text in order, so it grows with the text: 40 bits of hash, then the distance
from the place before in bytes of seven bits, all as base64 (about 8 letters for each 8 or
9 code points). Equal texts have equal fingerprints, and ``anchors_in`` reads them again. Likeness matches all anchors of two texts, each
with one of the other at most. The ``SKETCH`` smallest hashes are a coarse digest beside it.

NULL text counts as empty and has the empty fingerprint, which is like itself only. Texts are
hashed many at a time; a very long one is a step of its own. Ids must be whole numbers or
NULL; other types are refused.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracktally.llm.common import add_columns, chunks, exact, slices, texts_of

#: Length of the anchors and of their inner strings.
K, S = 24, 8
#: Length of the pieces that are anchors in texts too short to be sure of any other.
SHORT = 4
#: Anchor hashes in the coarse digest.
SKETCH = 64
#: An anchor of a fingerprint; of the hash the ``HASH_BYTES`` highest bytes are kept.
MARK = np.dtype([("place", "<u4"), ("hash", "<u8")])
HASH_BYTES = 5
BASE = 0x9E3779B97F4A7C15
#: Ranges of ids dealt out for each shuffle partition.
RANGES_EACH = 4
LEAST_ID = -(1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    """The hash values spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mers(codes: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of the ``length`` codes from each place on, by doubling."""
    made, size, rest = None, 0, length
    power, width, level = BASE, 1, codes
    while rest:
        if rest & 1:
            if made is None:
                made, size = level, width
            else:
                n = max(0, len(codes) - size - width + 1)
                made = made[:n] * np.uint64(power) + level[size : size + n]
                size += width
        rest >>= 1
        if rest:
            n = max(0, len(codes) - 2 * width + 1)
            level = level[:n] * np.uint64(power) + level[width : width + n]
            power = power * power % (1 << 64)
            width *= 2
    return made


def anchors_of(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of every anchor of some texts, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # codes of the text from here on
    inner = mixed(mers(codes, s))
    n = max(0, len(codes) - k + 1)
    low, width, span = inner, 1, k - s + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    edge = (inner[:n] == low) | (inner[k - s : k - s + n] == low)
    at = np.flatnonzero(edge & (left[:n] >= k))
    hashes = mixed(mers(codes, k)[at] ^ np.uint64(k))
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra_at, extra = [], []
        for i in short:
            own = codes[ends[i] - sizes[i] : ends[i]]
            found = mers(own, min(SHORT, len(own)))
            extra_at.append(ends[i] - sizes[i] + np.arange(len(found)))
            extra.append(mixed(found ^ np.uint64(SHORT)))
        at, hashes = np.concatenate([at, *extra_at]), np.concatenate([hashes, *extra])
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
    own = owner[at] if len(at) else np.zeros(0, np.int64)
    return own, at - (ends - sizes)[own] if len(at) else at, hashes


def marks_of(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors as by ``anchors_of``, and the pieces of texts that are not sure to have one.

    A short text has its pieces whether or not an anchor fell in it, so that it can be
    compared with its edited form. No other text without an anchor goes without them.
    """
    own, at, hashes = anchors_of(texts, k, s)
    sizes = np.array([len(t) for t in texts], np.int64)
    bare = np.bincount(own, minlength=len(texts)) == 0
    short = np.flatnonzero((sizes > 0) & (bare | (sizes >= k) & (sizes < 2 * k - s - 1)))
    if not len(short):
        return own, at, hashes
    owns, places, found = [own], [at], [hashes]
    for i in short:
        codes = np.frombuffer(texts[i].encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        pieces = mers(codes, min(SHORT, len(codes)))
        owns.append(np.full(len(pieces), i))
        places.append(np.arange(len(pieces)))
        found.append(mixed(pieces ^ np.uint64(SHORT)))
    own, at, hashes = np.concatenate(owns), np.concatenate(places), np.concatenate(found)
    order = np.lexsort((at, own))
    return own[order], at[order], hashes[order]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """All anchors of each text, place and hash, by place."""
    made: list[np.ndarray] = []
    for start, end in chunks([len(t) for t in texts]):
        own, at, hashes = marks_of(texts[start:end])
        marks = np.empty(len(own), MARK)
        marks["place"], marks["hash"] = at, hashes >> np.uint64(64 - 8 * HASH_BYTES)
        cuts = np.searchsorted(own, np.arange(end - start + 1))
        made += [marks[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return made


def matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both texts of the anchors they share: of equal ones the first with the first, and so on."""
    hashes, places = np.concatenate([a["hash"], b["hash"]]), np.concatenate([a["place"], b["place"]])
    if not len(hashes):
        return places, places
    order = np.argsort(hashes, kind="stable")  # of equal hashes those of a come first
    hashes, places = hashes[order], places[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    theirs = np.add.reduceat((order >= len(a)).astype(np.int64), starts)
    ours = np.diff(np.r_[starts, len(hashes)]) - theirs
    both = np.minimum(ours, theirs)
    nth = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    return places[np.repeat(starts, both) + nth], places[np.repeat(starts + ours, both) + nth]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of matched anchors among all of both; two empty ones are alike."""
    same = len(matched(a, b)[0])
    return same / (len(a) + len(b) - same) if len(a) or len(b) else 1.0


def spelled(sketches: list[np.ndarray]) -> list[str]:
    """The fingerprints of some sketches."""
    every = np.concatenate([np.empty(0, MARK), *sketches])
    sizes = np.array([len(x) for x in sketches], np.int64)
    ends = np.cumsum(sizes)
    place, hashes = every["place"].astype(np.int64), every["hash"]
    gap = np.diff(place, prepend=0)
    firsts = (ends - sizes)[sizes > 0]
    gap[firsts] = place[firsts]
    width = 1 + sum((gap >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    edges = np.r_[0, np.cumsum(HASH_BYTES + width)]
    out = np.zeros(edges[-1], np.uint8)
    for i in range(HASH_BYTES):
        out[edges[:-1] + i] = hashes >> np.uint64(8 * (HASH_BYTES - 1 - i)) & np.uint64(255)
    for i in range(5):
        some = np.flatnonzero(width > i)
        out[edges[some] + HASH_BYTES + i] = gap[some] >> 7 * i & 127 | (width[some] > i + 1) * 128
    raw = out.tobytes()
    return [base64.b64encode(raw[edges[e - n] : edges[e]]).decode() for e, n in zip(ends, sizes, strict=True)]


def anchors_in(fingerprint: str) -> np.ndarray:
    """The sketch that a fingerprint spells."""
    raw, at, place, found = base64.b64decode(fingerprint), 0, 0, []
    while at < len(raw):
        hashed = int.from_bytes(raw[at : at + HASH_BYTES])
        at += HASH_BYTES
        shift = 0
        while True:
            place += (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                break
        found.append((place, hashed))
    return np.array(found, MARK)


def digest(sketch: np.ndarray, size: int = SKETCH) -> str:
    """The ``size`` smallest distinct anchor hashes (32 bits), eight digits each."""
    return np.unique(sketch["hash"] >> np.uint64(8 * HASH_BYTES - 32))[:size].astype(">u4").tobytes().hex()


def find_anchors(docs: DataFrame, text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Each row with ``anchors``: place and hash of all its anchors, for positional matching."""

    def make():
        def run(column):
            texts, made = texts_of(column), []
            for start, end in chunks([len(t) for t in texts]):
                part: list[list] = [[] for _ in range(end - start)]
                for i, at, h in zip(*(x.tolist() for x in marks_of(texts[start:end], k, s)), strict=True):
                    part[i].append({"place": at, "hash": h - (1 << 63)})
                made += part
            return [made]

        return run

    return add_columns(docs, [text], "anchors array<struct<place: int, hash: long>>", make)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row with ``fingerprint``, all its anchors, and ``digest``, its smallest hashes."""

    def make():
        def run(column):
            marks = sketches(texts_of(column))
            return [spelled(marks), [digest(x) for x in marks]]

        return run

    return add_columns(docs, [text], "fingerprint string, digest string", make)


def half_edited(text: str, following: str) -> str:
    """The last half replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_starts(rows: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where ranges of about equal numbers of rows begin, by ``at`` and ``sub``, in order.

    The third array tells whether all rows of that ``at`` begin a range; else those of that
    ``sub`` do. At most twice ``ranges`` of them come to the driver.
    """
    steps = [i / ranges for i in range(1, ranges)]
    bounds = rows.agg(F.min("at").alias("least"), F.percentile_approx("at", steps, max(10_000, 10 * ranges)).alias("cuts")).first()
    if bounds.least is None:
        return np.zeros(1, np.int64), np.full(1, LEAST_ID), np.ones(1, bool)
    filled = Counter(bounds.cuts or ())
    filled[bounds.least] += 1
    starts = {(at, LEAST_ID, True) for at, times in filled.items() if times == 1}
    crowded = {at: times for at, times in filled.items() if times > 1}
    if crowded:
        parts = F.create_map(*(F.lit(x) for pair in crowded.items() for x in pair))
        # a part is a stretch of hashes, so that parts follow each other in the order of rows
        part = F.floor((F.shiftright("sub", 33) + (1 << 30)) * parts[F.col("at")] / (1 << 31))
        lows = rows.where(F.col("at").isin(list(crowded))).groupBy("at", part.alias("part")).agg(F.min("sub").alias("sub"))
        starts |= {(r.at, r.sub, False) for r in lows.collect()}
    ats, subs, whole = zip(*sorted(starts), strict=True)
    return np.array(ats, np.int64), np.array(subs, np.int64), np.array(whole)


def fingerprint_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints and digests of every text and of its half-edited form, and their likeness.

    A row's next is the one of the next id (a NULL id comes first, rows of one id stand by
    the hash of their text), the first after the last. Ids are cut into ranges at ids that
    occur, found by approximate quantiles; an id that fills several quantiles is cut further
    by the hash of the text, so only rows that agree in id and text stay together. Each range
    is a task's stream of sorted rows. The first rows of a range are also sent to the end of
    the range before, so neighbours meet without any order over the whole table. Each text
    moves once.
    """
    if not isinstance(docs.schema[id].dataType, T.IntegralType):
        raise TypeError(f"{id} must be a column of whole numbers, not {docs.schema[id].dataType.simpleString()}")
    narrow = docs.select(
        F.coalesce(exact(id).cast("long"), F.lit(LEAST_ID)).alias("at"),
        F.xxhash64(exact(text)).alias("sub"),
        exact(id).alias("id"),
        exact(text).alias("text"),
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begins, begin_subs, whole = range_starts(narrow, n * RANGES_EACH)
    last = len(begins) - 1

    @F.pandas_udf("range int, first boolean")
    def dealt_to(ids: pd.Series, subs: pd.Series) -> pd.DataFrame:
        ids, subs = ids.to_numpy(), subs.to_numpy()
        order = np.lexsort((np.r_[np.zeros(len(begins)), np.ones(len(ids))], np.r_[begin_subs, subs], np.r_[begins, ids]))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(order < len(begins)) - 1
        place = place[len(begins) :]
        first = (begins[place] == ids) & (whole[place] | (begin_subs[place] == subs))
        return pd.DataFrame({"range": place.astype(np.int32), "first": first})

    place = F.col("place.range")
    here = F.struct(place.alias("range"), F.lit(0).alias("tail"))
    before = F.struct(F.when(place == 0, F.lit(last)).otherwise(place - 1).alias("range"), F.lit(1).alias("tail"))
    copies = F.when(F.col("place.first"), F.array(here, before)).otherwise(F.array(here))
    dealt = (
        narrow.withColumn("place", dealt_to("at", "sub"))
        .withColumn("copy", F.explode(copies))
        .select("copy.range", "copy.tail", "at", "sub", "id", "text")
        .repartition(n, "range")
        .sortWithinPartitions("range", "tail", "at", "sub", "text")
    )
    schema = T.StructType([
        T.StructField(id, docs.schema[id].dataType),
        *T.StructType.fromDDL(
            "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, digest string, edited_digest string"
        ),
    ])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # the last row seen: it waits for its next

        for batch in slices(batches):
            columns = [batch.column(i).to_pylist() for i in (0, 1, 4, 5)]
            rows = [(r, tail, i, t or "") for r, tail, i, t in zip(*columns, strict=True)]
            for start, end in chunks([len(r[3]) for r in rows]):
                part = waiting + rows[start:end]
                waiting = part[-1:]
                pairs = [(i, i + 1) for i in range(len(part) - 1) if part[i][0] == part[i + 1][0] and not part[i][1]]
                if not pairs:
                    continue
                used = sorted({i for pair in pairs for i in pair})
                own = dict(zip(used, sketches([part[i][3] for i in used]), strict=True))
                edited = [half_edited(part[i][3], part[j][3]) for i, j in pairs]
                changed = sketches(edited)
                prints = dict(zip(used, spelled([own[i] for i in used]), strict=True))
                made = [
                    [part[i][2] for i, _ in pairs],
                    [len(part[i][3]) for i, _ in pairs],
                    [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                    [prints[i] for i, _ in pairs],
                    spelled(changed),
                    [likeness(own[i], x) for (i, _), x in zip(pairs, changed, strict=True)],
                    [likeness(own[i], own[j]) for i, j in pairs],
                    [digest(own[i]) for i, _ in pairs],
                    [digest(x) for x in changed],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[0], batch.schema.field(4).type), pa.array(made[1], pa.int64())]
                    + [pa.array(x, pa.string()) for x in made[2:5]]
                    + [pa.array(x, pa.float64()) for x in made[5:7]]
                    + [pa.array(x, pa.string()) for x in made[7:]],
                    names=names,
                )

    return dealt.mapInArrow(run, schema)

