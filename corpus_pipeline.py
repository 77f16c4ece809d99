"""A corpus pipeline of five stages; each result is written as Parquet and reread by the next.

The tables between the stages lie in the shared folder, so a lost executor costs a reread of
its part of the last table, never a rerun of earlier stages.

Defined results: null and empty texts have too few words and go in the first stage, and so do
very short ones; rows that repeat an id are judged row by row, except that near duplicates are
groups of ids, of which the least stays with all its rows; rows with a null id are never
duplicates; an empty table gives an empty result; extra columns, whatever their names, pass
through all stages but the last, which adds its own columns. Very long texts stay whole in every
stage. Ties between equal lines or documents go to the least (id, line number) or id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from collinea.llm import decontamination, line_dedup, ngram_jaccard, quality_rules, sentencepieces
from collinea.llm.common import cut, free_name
from collinea.llm.queries import piece_model, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality_rules.clean_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, or nearly repeat, an earlier line.

    A document that had words and has none left, since earlier documents hold all its lines, goes.
    """
    worded = free_name("worded", docs)
    has_word = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    cleaned = line_dedup.remove_lines(docs.withColumn(worded, has_word), **line_dedup.WHOLE)
    return cleaned.filter(~F.col(worded) | has_word).drop(worded)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the benchmark passages below the limit."""
    return decontamination.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with digests of the round trip."""
    return sentencepieces.encode_digests(docs, piece_model(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", piece_stage),
]

#: the stages' automata, edit joins and piece merges can't be put in SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
