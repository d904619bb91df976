"""A training corpus from raw documents: reject toxic texts, keep one of each group of near-duplicates, drop benchmark
passages, mix sources along a curriculum, and write token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import stage, table
from revlens.llm.decontaminate import decontaminate
from revlens.llm.mixing import take_mix
from revlens.llm.near_dup import deduplicate
from revlens.llm.token_files import token_output
from revlens.llm.toxicity import toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; null and empty texts stay, copies share a verdict, all columns are handed on."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), score_col="__toxic_score", predicted_col="__toxic")
    return scored.filter(F.col("__toxic") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: one row of each group stays, as deduplicate() tells; rows without words stay, identical ones once."""
    return deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item; null and empty texts stay, copies go together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in training order; rows without words as often as all of their source, null sources are one source."""
    return take_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of docs, read back from the token files; null and empty texts have the end id alone."""
    return token_output(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Kernel scores and similarity components can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
