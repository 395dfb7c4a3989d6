"""A training corpus from ``documents`` in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns each
document of the mix, whole, with its number of copies and the words they take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm import decontaminate, mixing, near_copies, pii, quality
from tallyfield.llm.store import land, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the highest grade reaches ``quality.MINIMUM``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.grade_of_labels())
    return quality.keep(docs, model)


def keep_first_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by op7's SimHash links and by a similarity of ``near_copies.SIMILAR`` or more."""
    return near_copies.keep_first_of_both(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, whole, their copies and the words they take."""
    return mixing.take(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", keep_first_copy),
    ("decontamination", drop_benchmark),
    ("pii", redact_personal),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
