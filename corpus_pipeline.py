"""The corpus pipeline: five stages over `documents`, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stormgrid.llm.common import documents, free_name, written
from stormgrid.llm.decontaminate import drop_leaks
from stormgrid.llm.line_dedup import drop_boilerplate
from stormgrid.llm.near_join import one_per_class
from stormgrid.llm.packing import pack
from stormgrid.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return drop_toxic(docs, documents(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go, and n_chars follows the text. A document of boilerplate alone stays whole: the next stage keeps one of each group of copies."""
    from pyspark.sql import functions as F

    lines, dropped = free_name(docs, "stage_lines"), free_name(docs, "stage_dropped")
    kept = drop_boilerplate(docs, spare_copies=True, counts=(lines, dropped))
    return kept.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return one_per_class(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, documents(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces, each with its sequence and place."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL cannot tokenize, nor learn the toxicity lexicon. tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
