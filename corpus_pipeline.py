"""A corpus pipeline over the training-data operators: quality rules, line dedup, near-duplicates,
benchmark decontamination, token ids.

Each stage takes what the one before it kept and returns the columns of documents; the last returns
doc_id, n_tokens and ids. Defined cases: a null text counts as an empty one, which the quality rules
reject; rows of null id lose no lines, and are the last choice of a group of near-duplicates; of
repeated rows one stays, by the near-duplicate stage; rows of equal id and other texts are separate;
a text that lost all its lines stays as an empty text, such texts are near-duplicates of each other,
and one stays; ties go to the least id, then to the least hash of the text; an empty table gives an
empty table; columns may have any names; a very long text is worked on whole, in memory of some 50
times its bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bpe, decontaminate, line_dedup, repetition, simhash
from recordloom.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("encode", encode),
]

#: The stages can't be said in SQL (suffix arrays, alignments, hashes); tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
