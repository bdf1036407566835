"""From documents to training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept and returns the columns of ``docs``, the last one pieces of sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.ngram_join import ngram_dedup
from tessera.llm.packing import pack, tokenizer_path
from tessera.llm.pii import KEY, surrogate_pii
from tessera.llm.quality import CUT, fit, score
from tessera.llm.shared import saved
from tessera.llm.suffix_dedup import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ranking = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, ranking, keep=docs.columns).filter(F.col("score") >= CUT).drop("score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = ngram_dedup(docs, carry=others)
    values = {c: F.col(f"carry.`{c}`") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*[values[c].alias(c) for c in docs.columns])


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that a document with a smaller id has, too, are cut out."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix_dedup(docs, carry=others, as_text=True)
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(f"carry.`{c}`") for c in others}
    return out.select(*[values[c].alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates."""
    out = surrogate_pii(docs, KEY, keep=[c for c in docs.columns if c != "text"]).drop("entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", substrings),
    ("PII surrogates", personal_data),
    ("power-of-two packing", packing),
]

#: Learned scores, radix order, keyed surrogates and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
