"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import ranked, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.mixing import document_rates

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return document_rates(docs.select("doc_id", "text"), labels)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.lattice import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.lines import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.toxicity import score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.secrets import secrets_digest

    return secrets_digest(table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.substrings import passages

    return passages(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.simhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.ranked import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegauge.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_substrings": op2_substrings,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_topk": op6_topk,
    "op7_embeddings": op7_embeddings,
    "op8_warc": op8_warc,
    "op9_lines": op9_lines,
    "op10_toxicity": op10_toxicity,
    "op11_ranked": op11_ranked,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_resample": op13_resample,
}

ORACLES: dict[str, str] = {
    "op8_warc": warc.ORACLE,
    "op11_ranked": ranked.ORACLE,
}
