"""A training corpus from raw documents: the stages in order, each over all that the one before kept.

Language ID drops documents without a language (no letter, or a score near
chance). Exact dedup keeps one row of each class of texts equal but for white
space. SimHash near-dedup keeps one row of each component. Decontamination drops
documents that hold a benchmark item. Mixing returns the documents that the mix
takes, with how often and how many words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callflow.llm import decontaminate, exact_dedup, language, mixing, simhash
from callflow.llm.shared import stored

#: Score below which a language is no better than a guess.
LEAST_SCORE = 0.3
#: Stages run Python code, so there is no SQL for them; tests hold the result against a plain version.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fit(docs.where(~language.held_out(docs["doc_id"]))), LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.unique(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).where("copies > 0")


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents below ``sf_dir``; each result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
