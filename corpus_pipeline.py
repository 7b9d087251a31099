"""A corpus cleaned for training, in stages: each takes (spark, docs, sf_dir) and its result is written and read again.

toxicity drops documents the ordinal model rejects; line_dedup takes repeated lines out of the texts; near_copies keeps one
document of each group of similar texts; mixing samples to target weights; sentencepiece encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystead.llm import pieces
from keystead.llm.line_runs import drop_repeated_lines
from keystead.llm.mixing import mix
from keystead.llm.ngram_join import drop_near_copies
from keystead.llm.ordinal import drop_toxic
from keystead.llm.tables import read, ship, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the model does not reject; it is fitted on the labelled ones among them."""
    return drop_toxic(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; ``n_chars`` follows."""
    ship(spark)
    return drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = mix(docs)
    return out.filter("mix.kept").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode(docs)


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_copies", near_copies), ("mixing", mixing), ("sentencepiece", sentencepiece),
]

#: A model fit and iterative raking are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
