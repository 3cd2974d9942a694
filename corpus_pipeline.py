"""The corpus pipeline: five stages over ``documents``, each written and reread before the next.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of ``documents``. What the operators do with nulls, empty and
very long texts, ties, repeated rows and empty tables is said in their modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.llm import line_dedup, mixing, near_dedup, quality_rules, sentencepiece_codec
from platter.llm.common import free_name
from platter.llm.queries import model_path
from platter.session import stored


def rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a large share of a source's documents carry go; the source stands for the host.

    Copies of a document count once, and one document keeps each line: the near-duplicate stage comes later.
    """
    lines = line_dedup.text_lines(F.col("text"))
    kept, before = free_name(docs, "_kept_lines"), free_name(docs, "_all_lines")
    cut = line_dedup.drop_boilerplate(docs, F.col("source"), lines, kept, before, once=True)
    whole = F.size(kept) == F.col(before)
    text = F.when(whole, F.col("text")).otherwise(F.array_join(kept, "\n"))
    size = F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return cut.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics get their target shares of tokens."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with a digest of what they decode to."""
    return sentencepiece_codec.encode_decode(docs, model_path())


STAGES = [
    ("quality_rules", rule_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: SQL expresses neither the near-duplicate classes nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
