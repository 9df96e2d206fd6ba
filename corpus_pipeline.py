"""A corpus from raw documents to encodable text: five stages, each one operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesieve.llm import bpe, decontaminate, line_dedup, quality, trie_join
from codesieve.llm.common import Workspace
from codesieve.llm.queries import table, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat go."""
    return line_dedup.dedup_lines(spark, docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by shared shingles one stays."""
    return trie_join.keep_one(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return bpe.encode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_duplicate_stage), ("benchmark decontamination", decontamination_stage), ("BPE encoding and decoding", encoding_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before = list(Workspace.open)
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{i}")
        for used in [w for w in Workspace.open if w not in before]:
            used.close()  # the stage is written, its steps have been read
        ws.drop(f"stage-{i - 1}")
    return docs
