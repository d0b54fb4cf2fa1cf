"""A training corpus from documents, in stages that each apply one operator.

Each stage reads what the one before it kept and returns the columns of documents,
but for the last, which adds what the mix takes of each document. Empty tables, null
texts and extra columns pass through; doc_id is a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.decontaminate import leaks
from newsloom.llm.durable import cut
from newsloom.llm.jaccard import near_groups
from newsloom.llm.linejoin import EVERY, drop_lines
from newsloom.llm.mixing import mix_sources
from newsloom.llm.toxicity import accepted


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return accepted(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier place has, but for small edits, go, and documents of nothing else."""
    return drop_lines(docs, least=EVERY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their five-word shingles, the one with the smallest doc_id stays."""
    later = near_groups(docs, n=5, percent=80).filter("doc_id <> component_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, or a short item of it, go; those without an id are known by their text."""
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.sha2("text", 256))
    found = leaks(docs.select(key.alias("doc_id"), "text"), _table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct()
    return docs.join(found, key == F.col("leak"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words it takes of each."""
    return mix_sources(docs, keep=tuple(c for c in docs.columns if c != "doc_id")).filter("taken > 0")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Trained scores and components are beyond SQL; tests hold the stages against plain versions, each on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
