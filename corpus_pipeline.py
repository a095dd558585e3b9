"""A training-data pipeline over `documents`: five stages, each working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import decontaminate, jaccard_join, langid, linededup, mix
from leafmark.llm.common import cut, join_checked, shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null texts too), or in no language that the labelled ones teach, go; null ids stay."""
    return langid.reject_unknown(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays; documents of which no line is left go. Null texts and rows without a doc_id stay as they are; rows with one doc_id are one document."""
    return linededup.dedup_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the least doc_id stays, with all its rows; so do null and empty texts and rows without a doc_id."""
    return jaccard_join.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go; rows without a doc_id, null and empty texts stay; null items have no window."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = cut(found.where("n_hit > 0").select("doc_id").distinct())
    return join_checked(docs, gone, ["doc_id"], "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that is taken, with how often (copies) and its words taken; texts without words never are. Null sources are one source."""
    return mix.mix_documents(docs).where("copies > 0")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
]

#: The stages learn models, sample and find components, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared folder and read again.

    An empty table goes through; extra columns, whatever their names, stay up to the last stage, which replaces those
    named like its own (size, source_size, target, copies, taken).
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
