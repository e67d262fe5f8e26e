"""A training corpus from raw documents: quality, toxicity, near duplicates, benchmark passages, packed sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of their docs. Null and empty
texts, repeated rows, very long texts and empty tables pass through the operators as their docstrings say; extra columns
stay, whatever their names. Rows without an id are never taken out as copies; equal rows of one id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import quality_model, toxicity
from umbra.llm.near_dups import BROADCAST_ROWS, near_duplicates
from umbra.llm.packing import pack
from umbra.llm.tables import read
from umbra.llm.winnowing import clean_rows
from umbra.session import broadcast_if_small, cut, remove_folder, shared_folder


def free_name(docs: DataFrame, name: str) -> str:
    """name, or a longer one where docs has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes; its score is compared with the threshold of op6."""
    model = quality_model.train(docs, read(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score")
    return quality_model.score_quality(docs, model, score).where(F.col(score) >= quality_model.THRESHOLD).drop(score)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    net = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity_score")
    return toxicity.score_toxicity(docs, net, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id. A copy is known by its id and its text."""
    copies = near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_copy_id"), F.col("text_hash").alias("_copy_hash"))
    copies = broadcast_if_small(cut(copies.distinct(), light=True), BROADCAST_ROWS)
    return docs.join(copies, (F.col("doc_id") == F.col("_copy_id")) & (F.xxhash64("text") == F.col("_copy_hash")), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, each judged as it streams by."""
    return clean_rows(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its place in a sequence."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifiers and packing can't be said in SQL; tests compare the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared checkpoint folder and read again; what the next has read goes."""
    folder = shared_folder(spark)
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
