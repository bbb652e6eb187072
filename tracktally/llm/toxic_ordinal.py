"""Severity of toxic language by cumulative-link ordinal regression.

Grades 0 to 3 share one weight vector over sparse text features and differ by ordered
thresholds: P(grade > k) is the logistic of w.x - t_k. The expected severity is the sum of
these over k. Features are words and word beginnings, hashed to ``DIMENSIONS`` places; a
value is the root of the count, lowered for long texts. Only features that stand out between
the classes take part.

Labels say only toxic or not. The grades above 0 are the thirds of the toxic rows by the
linear score of a first fit with two grades. Weights are learnt on the driver from at most
``SAMPLE_PER_CLASS`` labelled rows of each class, those of the smallest id and text hashes
(equal rows once). Of these only the features that stand out come to the driver. The fit is
corrected for the classes' shares among all labels; scoring covers every row and whole texts.

NULL text counts as empty: it has no features and the score of a text without any. Without
rows of one class every score is 0. Equal texts have equal scores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracktally.llm.common import add_columns, exact, saved, texts_of
from tracktally.llm.quality_rda import held_out

DIMENSIONS = 1 << 18
SAMPLE_PER_CLASS = 3_000
GRADES = 4
PREFIXES = (4, 5, 6, 7, 8)
#: Texts of more words have their values lowered by the root of the ratio.
USUAL_WORDS = 20
#: A feature takes part if its shares of the classes' texts differ by so many standard errors.
STANDS_OUT = 3.0
LEAST_TEXTS = 3
PENALTY = 2e-5
STEPS = 150
#: ASCII that is no letter separates words.
SEPARATE = bytes(x if x > 127 or 97 <= x <= 122 else 32 for x in range(256))
#: Words whose weight a task remembers.
CACHE_WORDS = 400_000


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(SEPARATE).split()


def places(word: bytes) -> list[int]:
    """Where the features of a word are hashed to."""
    spelled = word.decode(errors="replace")
    named = {b"=" + word, *(b"^" + spelled[:n].encode() for n in PREFIXES if len(spelled) >= n)}
    return [zlib.crc32(f) % DIMENSIONS for f in sorted(named)]


def sparse(text: str) -> tuple[list[int], list[float]]:
    """Places and values of one text, the places ascending."""
    words, counts = words_of(text), {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    at: dict[int, int] = {}
    for w, n in counts.items():
        for p in places(w):
            at[p] = at.get(p, 0) + n
    size = max(1.0, len(words) / USUAL_WORDS) ** 0.5
    return sorted(at), [at[p] ** 0.5 / size for p in sorted(at)]


def standing_out(found: DataFrame, n0: int, n1: int) -> np.ndarray:
    """Places worth a weight, at most ``DIMENSIONS``, ascending.

    Texts are counted by place in the tasks; only places that stand out come to the driver.
    """
    counts = found.select("y", F.explode("at").alias("place")).groupBy("place").agg(F.sum("y").alias("k1"), F.count(F.lit(1)).alias("k"))
    p, p1, p0 = F.col("k") / (n0 + n1), F.col("k1") / n1, (F.col("k") - F.col("k1")) / n0
    error = F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    good = counts.where((F.abs(p1 - p0) > STANDS_OUT * error) & (F.col("k") >= LEAST_TEXTS))
    return np.sort(good.select("place").toArrow()["place"].to_numpy())


@dataclass(frozen=True)
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return logistic(linear[:, None] - self.thresholds[None, :])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit_ordinal(row: np.ndarray, at: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> Ordinal:
    """Cumulative-link fit by Adam over all given rows; entries are (row, place, value).

    The first threshold is free and the gaps to the next are exponentials, so they stay
    ordered. Each grade's rows weigh as much as any other side of 0 as a whole.
    """
    n = len(grade)
    places, at = np.unique(at, return_inverse=True)
    share = np.where(grade > 0, (grade > 0).sum(), (grade == 0).sum())
    weight = 0.5 / share
    free = np.zeros(len(places) + grades - 1)
    mean, square = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, STEPS + 1):
        w, t = free[: len(places)], np.cumsum(np.r_[free[len(places)], np.exp(free[len(places) + 1 :])])
        edges = np.r_[-np.inf, t, np.inf]
        linear = np.bincount(row, value * w[at], n)
        high, low = logistic(edges[grade + 1] - linear), logistic(edges[grade] - linear)
        mass = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / mass * weight, low * (1 - low) / mass * weight
        g_w = np.bincount(at, value * (d_high - d_low)[row], len(places)) + PENALTY * w
        g_t = np.array([d_low[grade == k + 1].sum() - d_high[grade == k].sum() for k in range(grades - 1)])
        tail = np.cumsum(g_t[::-1])[::-1]
        gradient = np.r_[g_w, tail[:1], tail[1:] * np.exp(free[len(places) + 1 :])]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        free = free - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(DIMENSIONS)
    weights[places] = free[: len(places)]
    return Ordinal(weights, np.cumsum(np.r_[free[len(places)], np.exp(free[len(places) + 1 :])]))


def sample_of(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """``id, digest, y, text`` of at most ``sample`` rows of each class, and the classes' label counts.

    They are the first by hash of id, hash of text and id, so equal rows count once however often
    an id repeats in either table. The places of the last ones are found on hashes alone.
    """
    known = labels.where(exact(label).isin(0, 1) & ~held_out(exact(id))).select(exact(id).alias("known"), exact(label).cast("int").alias("y"))
    totals = {r.y: r["count"] for r in known.groupBy("y").count().collect()}

    def first(rows: DataFrame, *order) -> DataFrame:
        parts = [rows.where(F.col("y") == y).orderBy(*order).limit(sample) for y in (0, 1)]
        return parts[0].unionAll(parts[1])

    # at most 2 * sample rows
    chosen = first(known.distinct(), F.xxhash64("known"), "known")
    narrow = docs.select(exact(id).alias("id"), exact(text).alias("text"))
    texts = narrow.join(F.broadcast(chosen), F.col("id") == F.col("known")).select(
        "id", "y", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("digest"), "text"
    )
    ends = first(texts.select("y", "h", "digest", "id").distinct(), "h", "digest", "id")
    last = ends.groupBy("y").agg(F.max(F.struct("h", "digest", "id")).alias("last"))
    inside = texts.join(F.broadcast(last.withColumnRenamed("y", "of")), F.col("y") == F.col("of")).where(F.struct("h", "digest", "id") <= F.col("last"))
    return inside.select("id", "digest", "y", "text").dropDuplicates(["id", "digest", "y"]), totals


def learn(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, sample: int) -> Ordinal | None:
    chosen, totals = sample_of(docs, labels, id, text, label, sample)
    if not (totals.get(0) and totals.get(1)):
        return None

    def make():
        def run(column):
            both = [sparse(t) for t in texts_of(column)]
            return [[b[0] for b in both], [b[1] for b in both]]

        return run

    found = saved(add_columns(chosen, ["text"], "at array<int>, value array<float>", make).drop("text"), "toxic-sample")
    n = {r.y: r["count"] for r in found.groupBy("y").count().collect()}
    if not (n.get(0) and n.get(1)):
        return None
    kept = standing_out(found, n[0], n[1])

    def thin():
        def run(at, value):
            rows = [[], []]
            for a, v in zip(at.to_numpy(zero_copy_only=False), value.to_numpy(zero_copy_only=False), strict=True):
                good = np.isin(a, kept)
                rows[0].append(a[good])
                rows[1].append(v[good])
            return rows

        return run

    table = add_columns(found, ["at", "value"], "place array<int>, worth array<float>", thin).select("id", "digest", "y", "place", "worth").toArrow()
    table = table.sort_by([("id", "ascending"), ("y", "ascending"), ("digest", "ascending")]).combine_chunks()
    y, at = table["y"].to_numpy(), table["place"].combine_chunks()
    row = np.repeat(np.arange(len(y)), at.value_lengths().to_numpy(zero_copy_only=False))
    at, value = at.flatten().to_numpy(), table["worth"].combine_chunks().flatten().to_numpy().astype(float)
    first = fit_ordinal(row, at, value, y, 2)
    linear = np.bincount(row, value * first.weights[at], len(y))
    toxic = linear[y == 1]
    grade = np.where(y == 1, 1 + np.searchsorted(np.quantile(toxic, [1 / 3, 2 / 3]), linear), 0)
    model = fit_ordinal(row, at, value, grade, GRADES)
    # the fit's odds of toxic were 1
    return Ordinal(model.weights, model.thresholds - np.log(totals[1] / totals[0]) / 2)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_PER_CLASS
) -> DataFrame:
    """``id, held_out, score, severity, grade, predicted`` of every row.

    ``score`` is P(grade > 0), ``severity`` the expected grade, ``grade`` the likeliest one,
    ``predicted`` 1 where the score is 0.5 or more.
    """
    model = learn(docs, labels, id, text, label, sample)
    shared = None if model is None else docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def make():
        weights, thresholds = (None, None) if shared is None else shared.value
        known: dict[bytes, list[int]] = {}

        def weighed(word: bytes) -> list[int]:
            """Those places of a word that have a weight; most words have none."""
            if (found := known.get(word)) is None:
                found = [p for p in places(word) if weights[p]]
                if len(known) < CACHE_WORDS:
                    known[word] = found
            return found

        def linear_score(text: str) -> float:
            words, at = words_of(text), {}
            for found in filter(None, map(weighed, words)):
                for p in found:
                    at[p] = at.get(p, 0) + 1
            return sum(weights[p] * n**0.5 for p, n in at.items()) / max(1.0, len(words) / USUAL_WORDS) ** 0.5

        def run(column):
            texts = texts_of(column)
            if weights is None:
                return [[0.0] * len(texts), [0.0] * len(texts), [0] * len(texts)]
            above = logistic(np.array([linear_score(t) for t in texts])[:, None] - thresholds[None, :])
            masses = -np.diff(np.c_[np.ones(len(texts)), above, np.zeros(len(texts))], axis=1)
            return [np.round(above[:, 0], 9).tolist(), np.round(above.sum(1), 9).tolist(), masses.argmax(1).tolist()]

        return run

    narrow = docs.select(exact(id).alias("id"), exact(text).alias("text"))
    return add_columns(narrow, ["text"], "score double, severity double, grade int", make).select(
        F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score", "severity", "grade", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
