"""A training corpus from raw documents: five stages, each one operator over all rows left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm._shared import discard, durable_table
from tidegauge.llm.bpe import encode_documents
from tidegauge.llm.lines import remove_later_matches
from tidegauge.llm.mixing import mix
from tidegauge.llm.queries import table
from tidegauge.llm.simhash import keep_first
from tidegauge.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models call toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go."""
    return remove_later_matches(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as nonnegative rates fitted to the target weights of the domains ask."""
    return mix(docs, table(spark, sf_dir, "labels"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's tokens, beside its columns."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Kneser-Ney models, fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each kept as a table before the next reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable_table(docs, f"pipeline-{name.replace(' ', '-')}")
            if before is not None:
                discard(before)
            before = docs
    return docs
