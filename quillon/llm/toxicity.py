"""Toxicity as a severity grade, by cumulative-link ordinal regression over sparse text features.

Words that mark toxic rows are found by counts over a bounded sample of labelled rows; a text's features are the
rates of those words and whether they occur. Labels tell clean rows, grade 0, from toxic ones; those get the grades 1
to 3 by how sure rows that they weren't learned from are of them: the sample is halved by its ids, each half is
regressed on its labels alone, and the other half's toxic rows are ranked by the log-odds it gives them, by terciles.
One weight vector serves all thresholds: P(grade > k) = sigmoid(w x - t_k) with t_0 <= t_1 <= t_2; the output is the
expected grade.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import ship, stored

#: Labelled rows of each class that the fit reads, about (drawn by a hash of the id). All else is bounded by them.
ROWS = 6000
#: A marked word occurs in so many sampled toxic rows, and in one of so many at least, and so many times oftener than in clean rows.
LEAST, SHARE, TIMES = 2, 500, 8.0
GRADES = 4
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(y, w) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in set(tokens(t))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["toxic", "word"])


class Model:
    def __init__(self, words: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.words = {w: i for i, w in enumerate(words)}
        self.weights, self.cuts = weights, cuts

    def features(self, text: str | None) -> dict[int, float]:
        """Sparse: for each marked word its presence and, after all of those, its occurrences by the root of the length; last the share of marked words."""
        found = tokens(text)
        get, size, out = self.words.get, len(self.words), {}
        hits = [i for i in map(get, found) if i is not None]
        for i in hits:
            out[i] = 1.0
            out[size + i] = out.get(size + i, 0.0) + 1 / max(1, len(found)) ** 0.5
        if hits:
            out[2 * size] = np.log1p(100 * len(hits) / len(found))
        return out

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2."""
        z = sum(self.weights[i] * v for i, v in self.features(text).items())
        return 1 / (1 + np.exp(np.clip(self.cuts - z, -30, 30)))


def train(model: Model, rows: list[tuple[dict[int, float], int]], steps: int = 800, rate: float = 0.05, decay: float = 1e-3, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Maximum likelihood of the cumulative-link model by Adam, up to the largest grade among the rows; cuts stay in
    order as sums of exponentials. weights: how many rows a clean and a toxic one stand for, so that the base rate is
    that of all rows, not of the sample."""
    size = 2 * len(model.words) + 1
    r = np.array([k for k, (x, _) in enumerate(rows) for _ in x], np.int64)
    c = np.array([i for x, _ in rows for i in x], np.int64)
    v = np.array([a for x, _ in rows for a in x.values()], np.float64)
    y = np.array([g for _, g in rows])
    each = np.where(y > 0, weights[1], weights[0])
    each = each / each.sum()
    k = max(1, int(y.max(initial=0)))
    w, free = np.zeros(size), np.concatenate([[1.0], np.zeros(k - 1)])
    m, s = np.zeros(size + k), np.zeros(size + k)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        z = np.bincount(r, w[c] * v, len(y)) if len(r) else np.zeros(len(y))
        up = np.concatenate([np.ones((len(y), 1)), sig(z[:, None] - cuts), np.zeros((len(y), 1))], 1)  # P(grade >= g)
        d = up * (1 - up)
        at = np.arange(len(y))
        mass = np.maximum(up[at, y] - up[at, y + 1], 1e-9)
        gz = -(d[at, y] - d[at, y + 1]) / mass * each
        gc = np.zeros(k)
        for j in range(k):
            gc[j] = (((y == j + 1) * d[at, y] / mass - (y == j) * d[at, y + 1] / mass) * each).sum()
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([np.bincount(c, gz[r] * v, size) + decay * w, [tail[0]], tail[1:] * np.exp(free[1:])])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, free = w - step[:size], free - step[size:]
    model.weights, model.cuts = w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
    return model


def _graded(words: list[str], rows: list[tuple[dict[int, float], int]], halves: np.ndarray, weights: tuple[float, float]) -> list[tuple[dict[int, float], int]]:
    """rows (features, toxic) with grades for toxic; halves: which half each row is in."""
    odds = np.zeros(len(rows))
    for half in (0, 1):
        learned = [r for r, h in zip(rows, halves, strict=True) if h != half]
        own = np.flatnonzero(halves == half)
        if len({y for _, y in learned}) == 2:
            model = train(Model(words, np.zeros(0), np.zeros(0)), learned, weights=weights)
            odds[own] = [sum(model.weights[i] * v for i, v in rows[k][0].items()) - model.cuts[0] for k in own]
    toxic = np.array([y > 0 for _, y in rows])
    cuts = np.quantile(odds[toxic], [1 / 3, 2 / 3])
    return [(x, 1 + int(np.searchsorted(cuts, o)) if y else 0) for (x, y), o in zip(rows, odds, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, least: int = LEAST, share: int = SHARE, times: float = TIMES) -> Model | None:
    """From labelled rows (doc_id, toxic), about `rows` of each class; None unless both classes are there. A word marks
    by `least`, `share` and `times` as their defaults say."""
    ship(docs.sparkSession)
    own = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("l_toxic"))
    sizes = {r["l_toxic"]: r["n"] for r in own.groupBy("l_toxic").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "l_id"), F.lit(1 << 30))
    rate: Column = F.when(F.col("l_toxic") == 1, F.lit(int((1 << 30) * min(1.0, rows / sizes[1])))).otherwise(F.lit(int((1 << 30) * min(1.0, rows / sizes[0]))))
    some = own.where(draw < rate)  # bounded by `rows`
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stored(texts.join(F.broadcast(some), F.col("doc_id") == F.col("l_id")).select(F.col("l_toxic").alias("toxic"), "text", "doc_id"), "toxicity-sample")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(n) != {0, 1}:
        return None
    seen = sample.select("toxic", "text").mapInArrow(_distinct, "toxic int, word string").groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    ratio = ((F.col("bad") + 0.5) / n[1]) / ((F.col("good") + 0.5) / n[0])
    words = sorted(r["word"] for r in seen.where((F.col("bad") >= max(least, n[1] // share)) & (ratio >= times)).select("word").collect())
    model = Model(words, np.zeros(0), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("map<int,double>")
    def sparse(texts):
        import pandas as pd

        return pd.Series([shared.value.features(t) for t in texts], dtype=object)

    got = sample.select("toxic", "doc_id", sparse("text").alias("x")).orderBy("doc_id").collect()
    halves = np.array([crc32(str(r["doc_id"]).encode()) % 2 for r in got])
    weights = (max(1.0, sizes[0] / rows), max(1.0, sizes[1] / rows))
    return train(model, _graded(words, [(r["x"], r["toxic"]) for r in got], halves, weights), weights=weights)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), grade (the likeliest), p_toxic, toxic (p_toxic >= 0.5) for every row.

    Null and empty texts have no words and get the model's base severity; texts of any length are read whole; repeated
    rows are rows; without labels of both classes every severity is 0; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    @F.pandas_udf("struct<severity:double,grade:int,p_toxic:double>")
    def graded(texts):
        import pandas as pd

        out = []
        for t in texts:
            if shared.value is None:
                out.append((0.0, 0, 0.0))
                continue
            up = shared.value.above(t)
            mass = -np.diff(np.concatenate([[1.0], up, [0.0]]))
            out.append((float(up.sum()), int(mass.argmax()), float(up[0])))
        return pd.DataFrame(out, columns=["severity", "grade", "p_toxic"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    found = texts.withColumn("_t", graded("_text"))
    return found.select("doc_id", "_t.severity", "_t.grade", "_t.p_toxic", (F.col("_t.p_toxic") >= 0.5).alias("toxic"))
