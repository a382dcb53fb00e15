"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; the runner writes each result as
Parquet and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontam, langid, packing, secrets, simhash
from quillon.session import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (operator 10); learns from the text and lang of docs.

    Null and empty texts and texts without a letter go, as their language can't be told; mixtures stay; where no row has
    a lang, all stay. Each row is judged by its own text, repeated or not; an empty table stays empty.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (operator 4): of the smallest doc_id, a null counting as the largest, and
    of ties the smallest hash of the text; of rows that repeat both, any one.

    Rows are judged by their texts: rows of one doc_id with other texts are in other groups. Null, empty and blank texts
    are one group; an empty table stays empty.
    """
    return simhash.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate (operator 8).

    Null and empty texts have no words and stay; rows are judged by their own texts, repeated or not; an empty benchmark
    removes nothing, and an empty table stays empty.
    """
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced (operator 6) and n_chars, where a text changed, counted anew.

    Null and empty texts stay as they are, repeated rows change alike, and an empty table stays empty.
    """
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences (operator 9).

    Null and empty texts are a piece of the end id alone; rows of one doc_id are documents of their own; an empty table
    gives no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Trained and tokenising stages aren't expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
