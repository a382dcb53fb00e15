"""Language identification by multilingual mixture inference.

Each language has a smoothed model of hashed byte trigrams, counted over the labelled rows. A document is a mixture:
expectation-maximisation finds the languages' proportions from the trigrams' likelihoods. From all languages that have
a proportion, the smallest is left out again and again, and proportions are found anew; of these sets, and of each
language alone, the one whose penalised likelihood (half the log of the trigrams for each language more) is best is
the document's. Letters are code points of category L.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import ship

#: Buckets of trigrams, and rows a language is learned from, about (rows are drawn by a hash of their id).
BUCKETS, ROWS = 1 << 14, 4000
#: Rounds of expectation-maximisation at most, and the change of a proportion below which it ends.
ROUNDS, SETTLED = 20, 1e-3
#: Proportion below which a language is left out at once.
LEAST = 1e-4
UND = "und"


_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall(text.lower())
    if "".join(found).isalpha():
        return found
    # signs of numbers, such as fractions, are word characters too, but no letters
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams in use, with counts; letters are in lower case, all else is one blank."""
    raw = np.frombuffer((" " + " ".join(_words(text)) + " ").encode("utf-8"), np.uint8).astype(np.uint32)
    if len(raw) < 3:  # no letter
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    counts = np.bincount((key * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used, counts[used]


def infer(used: np.ndarray, counts: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Proportions of the languages (rows of `model`, probabilities of buckets); 0 for those left out."""
    like = model[:, used]
    n = counts.sum()

    def settle(which: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        part = like[which]
        share = np.full(len(which), 1 / len(which))
        for _ in range(rounds if len(which) > 1 else 1):
            joint = share @ part
            new = share * (part @ (counts / joint)) / n
            moved = np.abs(new - share).max()
            share = new
            if moved < SETTLED:
                break
        return share, float(counts @ np.log(share @ part))

    alone = np.log(like) @ counts
    best, share, which = alone.max(), np.ones(1), np.array([int(alone.argmax())])
    chosen = np.arange(len(model))
    while len(chosen) > 1:
        got, fit = settle(chosen, ROUNDS)
        if (got >= LEAST).all():
            fit -= 0.5 * (len(chosen) - 1) * np.log(max(n, 2))
            if fit > best:
                best, share, which = fit, got, chosen
            chosen = np.delete(chosen, np.argmin(got))
        else:  # no proportion to speak of
            chosen = chosen[got >= LEAST]
    out = np.zeros(len(model))
    out[which] = share / share.sum()
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            used, n = grams(text)
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))[used] += n
    for lang, n in total.items():
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(n[used])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, learn: Column | None = None, rows: int = ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their models, from rows with text, lang and `learn`. Counts (languages times BUCKETS) come to the driver."""
    ship(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where("lang is not null and text is not null")
    if learn is not None:
        known = known.where(learn)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30))
    take = F.lit(False)
    for lang, n in sizes.items():
        take = take | ((F.col("lang") == lang) & (draw < int((1 << 30) * min(1.0, rows / n))))
    got = known.where(take).select("lang", "text").mapInArrow(_counts, "lang string, bucket long, n long")
    counts = got.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    model = np.full((len(langs), BUCKETS), 0.5)
    at = {lang: i for i, lang in enumerate(langs)}
    np.add.at(model, (counts["lang"].map(at).to_numpy(np.int64), counts["bucket"].to_numpy(np.int64)), counts["n"].to_numpy(np.float64))
    return langs, model / model.sum(1, keepdims=True)


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred, score (the share of lang_pred) and shares (a map of all languages found).

    Null texts and texts without a letter are `und` with score 0, as are all texts where no language was learned; ties
    go to the language first in order. Texts of any length are read whole; repeated rows are rows; an empty table
    gives none.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    @F.pandas_udf("struct<lang_pred:string,score:double,shares:map<string,double>>")
    def mixture(texts):
        import pandas as pd

        names, table = shared.value
        out = []
        for text in texts:
            used, n = grams(text) if text and names else ((), ())
            if not len(used):
                out.append((UND, 0.0, {}))
                continue
            share = infer(used, n, table)
            best = int(share.argmax())
            out.append((names[best], float(share[best]), {names[i]: float(share[i]) for i in np.flatnonzero(share)}))
        return pd.DataFrame(out, columns=["lang_pred", "score", "shares"])

    found = docs.withColumn("_mix", mixture(F.col("text").cast("string")))
    return found.select(*keep, "_mix.lang_pred", "_mix.score", "_mix.shares")


def accepted(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """docs without those whose language can't be told (`und`); mixtures stay, however their languages are shared, and
    where no language could be learned, all docs. Learns from text and lang of docs themselves; all columns stay."""
    langs, model = fit(docs, rows=rows)
    if not langs:
        return docs
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").alias("text"))
    found = predict(whole, langs, model, keep=("_row",))
    return found.where(F.col("lang_pred") != UND).select("_row.*")
