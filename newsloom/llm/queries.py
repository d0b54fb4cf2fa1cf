"""The queries of the numbered operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.pmod("vec_id", F.lit(50)) == 0))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.runindex import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.jaccard import near_groups

    return near_groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.linejoin import EVERY, removals

    return removals(table(spark, sf_dir, "documents"), least=EVERY)


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.disclosure import report

    return report(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.pagetree import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.automata import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.turns import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from newsloom.llm import automata, decontaminate, jaccard, phrases, quality, topk

    return {"op1_topk_search": topk.ORACLE_SQL, "op2_decontaminate": decontaminate.ORACLE_SQL, "op4_jaccard_join": jaccard.ORACLE_SQL, "op9_automata_dedup": automata.ORACLE_SQL, "op11_quality_rules": quality.ORACLE_SQL, "op13_collocations": phrases.ORACLE_SQL}
