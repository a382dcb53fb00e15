"""Quality by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; unlabelled rows are web text as it comes. The class prior is
estimated from the two samples, and a logistic model over binned measurements of the text minimises the non-negative
unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). Labels of quality 0 are never
used. Measurements come from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.rules import measures
from quillon.session import ship, stored

#: Rows of each sample the model is fitted on, about (drawn by a hash of the id), and bins a measurement.
ROWS, BINS = 8000, 12
#: Steps of the fit, their size, and the weight decay.
STEPS, RATE, DECAY = 600, 0.05, 1e-4

NAMES = (
    "log_words", "repeat", "symbols", "dup_lines", "upper", "word_chars", "distinct", "digits", "letters", "marks",
    "beyond_ascii", "longest", "line_words", "bangs", "entropy",
)


def features(text: str | None) -> tuple[float, ...]:
    text = text or ""
    n, chars, symbols, dup, repeat, lines, upper, letters = measures(text)
    data = text.encode("utf-8")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    parts = data.split()
    p = counts[counts > 0] / size
    distinct = len(set(parts))
    return (
        np.log1p(n), repeat / max(1, n), symbols / max(1, n), dup / max(1, lines), upper / max(1, letters), chars / max(1, n),
        distinct / max(1, n) ** 0.8, counts[48:58].sum() / size, letters / size, (counts[33:48].sum() + counts[58:65].sum()) / size,
        counts[128:].sum() / size, np.log1p(max(map(len, parts), default=0)), n / max(1, lines), counts[33] / max(1, n), float(-(p * np.log(p)).sum()),
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [[float(x) for x in features(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], ["doc_id", "x"])


class Model:
    """Additive over bins: a weight for each bin of each measurement."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    @staticmethod
    def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") + j * BINS for j, e in enumerate(edges)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[self.binned(x, self.edges)].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, size: int, risk) -> tuple[np.ndarray, float]:
    """Adam over full batches; risk(zp, zu) gives the gradients with respect to both."""
    w, b = np.zeros(size + 1), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, STEPS + 1):
        gp, gu = risk(w[p].sum(1) + b, w[u].sum(1) + b)
        g = np.bincount(p.ravel(), np.repeat(gp, p.shape[1]), size + 1) + np.bincount(u.ravel(), np.repeat(gu, u.shape[1]), size + 1)
        g[size] = gp.sum() + gu.sum()
        g[:size] += DECAY * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w[:size] -= step[:size]
        b -= step[size]
    return w[:size], b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the two samples' masses above a score, over
    scores that leave enough positives for the ratio to be sure, with a margin of two standard errors."""
    best = 1.0
    for t in np.quantile(sp, np.linspace(0.0, 0.7, 71)):
        a, b = (su >= t).mean(), (sp >= t).mean()
        error = np.sqrt(a * (1 - a) / len(su) + b * (1 - b) / len(sp))
        best = min(best, (a + 2 * error) / max(b, 1e-9))
    return float(np.clip(best, 0.02, 0.98))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of positives' and unlabelled rows' log-odds, and the direction of a step for each. Where
    the negative part is below 0, that is an overfit: the step undoes it, and the risk counts it as 0."""
    sp, su = _sigmoid(zp), _sigmoid(zu)
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    if negative >= 0:
        return positive + negative, -prior * (1 - sp) / len(zp) - prior * sp / len(zp), su / len(zu)
    return positive, prior * sp / len(zp), -su / len(zu)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Non-negative PU fit of rows of measurements; the prior is estimated where it isn't given."""
    both = np.concatenate([positive, unlabelled])
    edges = []
    for j in range(both.shape[1]):
        e = np.unique(np.concatenate([np.quantile(both[:, j], np.linspace(0.02, 0.98, (BINS - 1) // 2)), np.quantile(unlabelled[:, j], [0.005, 0.05, 0.1, 0.9, 0.95, 0.995])]))
        edges.append(e[: BINS - 1])
    size = BINS * both.shape[1]
    p, u = Model.binned(positive, edges), Model.binned(unlabelled, edges)
    if prior is None:

        def plain(zp, zu):
            return -_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)

        w, b = _descend(p, u, size, plain)
        prior = class_prior(_sigmoid(w[p].sum(1) + b), _sigmoid(w[u].sum(1) + b))

    w, b = _descend(p, u, size, lambda zp, zu: risk(zp, zu, prior)[1:])
    return Model(edges, w, b, prior)


def fit(measured: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = ROWS) -> Model | None:
    """From measured (doc_id, x) and labels (doc_id, quality): positives and unlabelled rows for which `learn` (over
    doc_id) holds, about `rows` of each. None without positives."""
    ok = learn if learn is not None else F.lit(True)
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where(ok).distinct()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    n_good, n_all = good.count(), measured.where(ok).count()
    if not n_good:
        return None
    some = good.where(draw < int((1 << 30) * min(1.0, rows / n_good)))
    p = measured.join(F.broadcast(some.select(F.col("doc_id").alias("l_id"))), F.col("doc_id") == F.col("l_id")).select("doc_id", "x").toPandas()
    other = F.pmod(F.xxhash64(F.lit("web"), "doc_id"), F.lit(1 << 30))
    u = measured.where(ok).where(other < int((1 << 30) * min(1.0, rows / max(1, n_all)))).select("doc_id", "x").toPandas()
    if not len(p) or not len(u):
        return None
    p, u = (np.stack(t.sort_values("doc_id")["x"].to_numpy()) for t in (p, u))
    return train(p, u)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and x, the measurements of each text, written to the shared folder: texts are read once."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_run, "doc_id long, x array<double>"), "quality")


def score(measured: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score, the chance of quality 1 (the prior 0.5 for all without a model)."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(x):
        import pandas as pd

        return pd.Series(shared.value.scores(np.stack(x.to_numpy())) if shared.value is not None and len(x) else np.full(len(x), 0.5))

    return measured.select("doc_id", of("x").alias("score"))


def quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = ROWS) -> DataFrame:
    """doc_id, score of every text of docs. Null and empty texts are scored as empty; texts of any length are
    read whole; repeated rows are rows; labels without a document and documents without a label are fine; an empty table gives no rows."""
    measured = measure(docs)
    return score(measured, fit(measured, labels, learn, rows))
