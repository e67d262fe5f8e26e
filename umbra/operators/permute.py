"""Permutations and shuffles of rows by pseudo-random rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.prf import prf60


#: Rows ranked in one task; 10**10 rows make a hundred thousand slices, whose sizes are summed up in one.
SLICE_ROWS = 100_000


def generate_permutation(rows: DataFrame, seed: str, row: str = "row_no") -> DataFrame:
    """(row_no, target): a random permutation of 0..n-1.

    The rank is taken in ranges of the random number: rows are dealt to slices of some SLICE_ROWS rows by its high bits, ranked
    inside a slice, and slices are offset by the sizes of those before; no task sees all rows.
    """
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    high = (F.shiftright("k", 30) * F.lit(slices)).cast("bigint")
    keyed = rows.select(row, prf60(seed, F.col(row)).alias("k")).withColumn("slice", F.shiftright(high, 30).cast("int"))
    sizes = keyed.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("k", row)) - 1
    return keyed.withColumn("inside", inside).join(F.broadcast(before), "slice").select(row, (F.col("before") + F.col("inside")).cast("bigint").alias("target"))


def permute(rows: DataFrame, permutation: DataFrame, row: str = "row_no") -> DataFrame:
    """Row i goes to place target(i)."""
    return rows.join(permutation, row).drop(row).withColumnRenamed("target", row)


def unpermute(rows: DataFrame, permutation: DataFrame, row: str = "row_no") -> DataFrame:
    """Undoes permute()."""
    back = permutation.select(F.col("target").alias(row), F.col(row).alias("source"))
    return rows.join(back, row).drop(row).withColumnRenamed("source", row)


def shuffle_reports(reports: DataFrame, seed: str, client: str = "client_id") -> DataFrame:
    """Reports in random order without who sent them; rows are dealt by a random key and sorted inside their task."""
    keyed = reports.withColumn("_k", prf60(seed, F.col(client)))
    return keyed.drop(client).repartitionByRange("_k").sortWithinPartitions("_k").drop("_k")
