"""Document quality by regularised quadratic discriminant analysis.

Every text becomes a short vector of transformed statistics (logs of counts and rates). For
each class the mean and covariance come from sums over all labelled rows, gathered as one
small row of moments per task; covariances are shrunk towards their pooled form and towards
a multiple of the identity. The score is the logistic of the difference of the two Gaussian
log densities, from Mahalanobis distances by Cholesky factors that are made once.

Texts that are NULL count as empty and are scored like all others. Labels of ids without a
document and NULL labels teach nothing; an id with several labels counts with each. With no
row of one of the classes every score is 0.5. Equal texts have equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracktally.llm.common import add_columns, exact, saved, texts_of
from tracktally.llm.quality_rules import Statistics

#: Shares of the pooled covariance and of the identity in each class covariance.
POOL = 0.1
RIDGE = 0.02
#: Log-density differences are divided by this, as the statistics are not independent.
TEMPER = 4.0
#: Least variance, for classes of a few equal rows.
FLOOR = 1e-6

DIGITS = b"0123456789"
ENDS = b".,;:?!"
FEATURES = (
    "words", "word_length", "symbols", "exclamations", "upper", "bare", "digits", "ends", "repeated_lines",
    "repeated_words", "distinct", "lines", "longest",
)


def features(text: str) -> list[float]:
    """The transformed statistics of one text."""
    s = Statistics(text)
    n, size, letters = max(1, s.n_words), max(1, len(s.data)), max(1, s.n_letters)
    count = lambda chars: len(s.data) - len(s.data.translate(None, chars))
    root = np.sqrt
    return [
        np.log1p(s.n_words) / 4,
        np.log1p(s.word_chars / n),
        root(s.n_symbols / n),
        root(count(b"!") / n),
        root(s.n_upper / letters),
        root(s.n_bare_words / n),
        root(count(DIGITS) / size),
        root(count(ENDS) / n),
        root(s.n_dup_lines / max(1, len(s.lines))),
        root(s.n_repeat_words / n),
        # distinct words fall with the length of any text; that part is taken out
        np.log(len(set(s.words)) + 1.0) - 0.85 * np.log(n + 1.0),
        np.log1p(len(s.lines)) - np.log1p(s.n_words / 40),
        np.log1p(max(map(len, s.words), default=0)) / 2,
    ]


def vectors(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row with ``features``, an array of doubles."""

    def make():
        return lambda column: [[features(t) for t in texts_of(column)]]

    return add_columns(docs, [text], "features array<double>", make)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log densities' constants of classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [
            self.constants[c] - 0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(1) for c in (0, 1)
        ]
        odds = (density[1] - density[0]) / TEMPER + self.prior
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -40.0, 40.0)))


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``features`` for each ``label`` 0 and 1."""
    d = len(FEATURES)

    def make():
        def run(label, column):
            y = np.array(label.to_pylist())
            x = np.array(column.to_pylist(), float).reshape(-1, d)
            made = [[] for _ in range(len(y))]
            for c in (0, 1):
                if (rows := np.flatnonzero(y == c)).size:
                    part = x[rows]
                    made[rows[0]] = [float(len(rows)), *part.sum(0).tolist(), *(part.T @ part).ravel().tolist()]
            return [made]

        return run

    parts = add_columns(labelled.select("label", "features"), ["label", "features"], "moments array<double>", make)
    sums = (
        parts.where(F.size("moments") > 0)
        .select("label", F.posexplode("moments").alias("at", "value"))
        .groupBy("label", "at")
        .agg(F.sum("value").alias("value"))
        .collect()  # 2 * (1 + d + d * d) numbers
    )
    found = {}
    for c in (0, 1):
        values = np.zeros(1 + d + d * d)
        for r in sums:
            if r.label == c:
                values[r.at] = r.value
        found[c] = (values[0], values[1 : d + 1], values[d + 1 :].reshape(d, d))
    return found


def fit(labelled: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Discriminant | None:
    """The discriminant of rows with ``label`` and ``features``; None without both classes."""
    moments = class_moments(labelled)
    if not all(moments[c][0] for c in (0, 1)):
        return None
    means = np.array([moments[c][1] / moments[c][0] for c in (0, 1)])
    scatter = [moments[c][2] - moments[c][0] * np.outer(means[c], means[c]) for c in (0, 1)]
    total = moments[0][0] + moments[1][0]
    pooled = (scatter[0] + scatter[1]) / total
    whiten, constants = [], []
    for c in (0, 1):
        own = (1 - pool) * scatter[c] / moments[c][0] + pool * pooled
        own = (1 - ridge) * own + (ridge * np.trace(pooled) / len(pooled) + FLOOR) * np.eye(len(pooled))
        factor = np.linalg.cholesky(own)
        whiten.append(np.linalg.inv(factor))
        constants.append(-np.log(np.diag(factor)).sum())
    prior = float(np.log(moments[1][0] / moments[0][0]))
    return Discriminant(means, np.array(whiten), np.array(constants), prior)


def held_out(id: Column) -> Column:
    """Rows whose labels are never learnt from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def score_quality(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7
) -> DataFrame:
    """``id, held_out, score, predicted`` of every row; the texts are read once."""
    made = saved(vectors(docs.select(exact(id).alias("id"), exact(text).alias("text")), "text").select("id", "features"), "rda-features")
    known = labels.where(exact(label).isin(0, 1) & ~held_out(exact(id))).select(
        exact(id).alias("known"), exact(label).cast("int").alias("label")
    )
    model = fit(made.join(known, F.col("id") == F.col("known")).select("label", "features"))

    def make():
        def run(column):
            x = np.array(column.to_pylist(), float).reshape(-1, len(FEATURES))
            score = np.full(len(x), 0.5) if model is None else model.scores(x)
            return [np.round(score, 9).tolist()]

        return run

    return add_columns(made, ["features"], "score double", make).select(
        F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
