"""From raw documents to a mixed training corpus: each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleroom.llm import language, leaks, lines, mixing, simhash
from saleroom.llm.tokens import table
from saleroom.session import scratch_path


def named_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model names with enough confidence."""
    return language.accepted(docs, language.learned_from(docs, allowed=language.training_rows()))


def without_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; n_chars follows the text. No document goes."""
    edited = lines.without_templates(docs, counts=False)
    return edited.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints within 4 bits over 4-word shingles: the one with the smallest id."""
    return simhash.one_of_each(docs, n=simhash.SHINGLE, radius=simhash.RADIUS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies."""
    found = mixing.mixed(docs, keep=("text", "lang"))
    return found.where(F.col("copies") > 0).select("doc_id", "text", "lang", "source", "size", "source_size", "target", "copies", "taken")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", named_language),
    ("line_dedup", without_templates),
    ("simhash", one_of_each),
    ("decontamination", without_leaks),
    ("mixing", mix),
]

# The stages are no SQL: a trained model, a template tree and linked fingerprints. Tests hold them against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
