"""Corpus pipeline: quality, near-duplicates, secrets, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the last return the
columns of ``docs``; run() writes each result as Parquet in the shared folder and reads it again.

In every stage null ids and texts are kept as they are (a null text counts as empty), repeated rows are rows of their
own unless the stage says otherwise, extra columns pass through whatever their names, texts are read whole, and an
empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import mixing, packing, quality, secrets, simhash
from lodestrata.llm.common import discard, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's labelled rows, rejects go. Equal texts get equal decisions;
    without labels of both kinds all stay or all go, by the share of label 1."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, null ids last; of rows with equal ids, one. Empty texts
    are one group."""
    return simhash.first_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are cut out of the texts; every document stays. A null source is one unnamed owner;
    equal texts are cut alike; n_chars follows the cut text."""
    return secrets.redact(docs, owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights; each document stays once at least. A null source is one unnamed
    source; ties of rows are settled by their number."""
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; an empty text has its end token alone, repeated rows are packed each."""
    return packing.pack(docs, key=F.col("doc_id"), text=F.col("text"), tokenizer=packing.public_tokenizer)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: A fitted model decides the first stage, so SQL can't express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
