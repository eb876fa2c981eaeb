"""The corpus pipeline: five stages applied in order to ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that its predecessor kept, and all but
the last return the columns of ``documents``.  Columns that a table brings beyond those are carried along.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import decontaminate, mixing, ngram_join, pii, toxicity
from graphloom.llm._session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It is trained on the labelled part of the whole table."""
    return toxicity.without_toxic(docs, toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group stays, the one of the smallest id; default thresholds (five words, 0.8).

    Rows are told apart by a number of their own, so a shared or missing id never takes another text along."""
    return ngram_join.without_near_copies(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text.  Rows are matched by text, so those without an id are redacted too."""
    out = pii.redact(docs, pii.pii_spans(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's tokens, rate and domain posteriors; documents whose rate is zero go.  The classifier learns from the
    labelled documents that are left.

    Documents without an id share one rate, as rows that share an id do (see ``mixing.mix``).  A column of the documents that
    has the name of an added one gives way to it."""
    rates = mixing.mix(docs, _table(spark, sf_dir, "labels")).where("rate > 0")
    added = [c for c in rates.columns if c != "doc_id"]
    rates = stage(rates.select(F.col("doc_id").alias("key"), F.struct(*added).alias("mix")), "pipeline-rates")
    found = docs.select(F.struct("*").alias("doc")).join(rates, F.col("doc.doc_id").eqNullSafe(F.col("key")))
    return found.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in added], "mix.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("mixing", mixed),
]
#: SQL cannot express the trained and iterative stages; tests/llm/test_pipeline.py restates the pipeline plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
