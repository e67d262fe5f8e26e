"""How the llm queries read their tables, labels and training rows."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.words import trim
from umbra.session import broadcast_if_small

#: Labels are broadcast up to this many rows (16 bytes each, some 60 as a hash table: 120 MB), joined by a shuffle beyond.
BROADCAST_LABELS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(column: str | F.Column, n: int) -> F.Column:
    """crc32(column as text) mod n; a null id falls in fold 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def fold_of(doc_id: int, n: int) -> int:
    """The same on the driver."""
    return zlib.crc32(str(doc_id).encode()) % n


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row for each labelled document; repeated labels: the largest, nulls dropped."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def training_sample(documents: DataFrame, labels: DataFrame, column: str, per_class: int, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, text, label) of at most per_class documents of each class, for fitting a classifier in one task.

    Rows of fold `held` are never used. The rows are those whose id hashes lowest, so the sample doesn't depend on
    how the tables are laid out; of rows that share an id the least text counts. Only the 2 * per_class chosen ids meet
    the documents (a broadcast of that bound).
    """
    labels = clean_labels(labels, column).where((fold("doc_id", folds) != held) & F.col("label").isin(0, 1))
    least = lambda value: labels.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    ids = [(r["doc_id"], r["label"]) for r in least(0).unionByName(least(1)).select("doc_id", "label").collect()]
    small = documents.sparkSession.createDataFrame(ids, "doc_id bigint, label int")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(small), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], Any]) -> Any:
    """fit() on the (text, label) rows of a bounded sample in id order; it runs in one task, and only the model reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True))
        model = zlib.compress(pickle.dumps(fit([(t, y) for _, t, y in rows])), 1)
        del rows
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    # an aggregate without keys is one partition, also without rows
    whole = sample.agg(F.collect_list(F.struct("doc_id", "text", "label")).alias("rows")).select(F.explode_outer("rows").alias("r")).select("r.*")
    model = whole.where("doc_id IS NOT NULL").mapInArrow(run, "model binary").collect()
    return pickle.loads(zlib.decompress(model[0]["model"])) if model else fit([])
