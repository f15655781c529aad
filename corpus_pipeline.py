"""The training-corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, source mix.

Defined cases, in all stages: an empty table gives an empty table; nulls in any column stay nulls; columns that a stage does
not need are carried along under any name; a very long text is worked on whole. Each stage states what it does with null
and empty texts, repeated rows and empty side tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textsieve.llm import decontaminate, mixing, neardup, secrets, toxicity
from textsieve.llm.common import Workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts score as texts without a toxic segment; repeated rows share
    a fate; without labels of both kinds all documents stay, with a warning."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; of each group the document with the smallest id stays.

    Null, empty and blank texts are no one's duplicates and stay; of rows that repeat in full one stays; a null id counts
    as the largest.
    """
    return neardup.keep_one(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that consist of them by more than half go.

    Null and empty texts stay as they are, as does everything if the benchmark is empty.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are replaced; widely copied examples stay. Null and empty texts stay; a null source counts
    as one owner; repeated rows are changed alike."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as the stages left it, with how many of its words the mix takes: a row for each, 0 for null and empty
    texts (a null text is empty); a null source is one more source; repeated rows are documents of their own."""
    return mixing.mixed_texts(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]
#: Model scores and confirmed candidate search can't be put in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again. The rows have the cleaned texts."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
