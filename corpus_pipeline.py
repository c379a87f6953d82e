"""From raw documents to token counts: quality, near-duplicates, decontamination, personal data, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan.llm import bpe, decontaminate, near_dups, pii, quality
from lurescan.llm.queries import table, vocabulary
from lurescan.plans.storage import stable


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers of low quality and of toxicity reject go."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("_keep").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return near_dups.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become [KIND]; n_chars follows."""
    return pii.masked(docs, length="n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of token counts and checksums per document."""
    return bpe.encode(docs, vocabulary(), with_ids=False)


STAGES = [
    ("quality", keep_good),
    ("near_dups", keep_one_copy),
    ("decontaminate", drop_benchmark),
    ("pii", mask_personal),
    ("bpe", encode),
]

#: the classifiers, the field and the vocabulary are no SQL; tests/llm compares with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
