"""Keyed and share tables as CSV: K id columns, then whole-number columns; no quoting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = "decimal(20,0)"


def _reader(spark: SparkSession, header: bool):
    """Malformed rows fail; blank lines are skipped by the reader; quotes and escapes are ordinary characters."""
    return spark.read.options(header=str(header).lower(), enforceSchema="true", mode="FAILFAST", quote="", escape="", emptyValue="", nullValue="\u0000")


def scan_keyed_csv(spark: SparkSession, path: str, ids: list[str], features: list[str], header: bool = False) -> DataFrame:
    """id columns as strings, features as unsigned 64-bit decimals; column names are given, never read."""
    schema = ", ".join([f"`{c}` string" for c in ids] + [f"`{c}` {U64}" for c in features])
    read = _reader(spark, header).schema(schema).csv(path)
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ids], *features)


def scan_shares_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return scan_keyed_csv(spark, path, [], columns)


def sink_keyed_csv(df: DataFrame, path: str, header: bool = False, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=str(header).lower(), quote="\u0000", escape="\u0000", emptyValue="").csv(path)


def sink_shares_csv(df: DataFrame, columns: list[str], path: str, mode: str = "errorifexists") -> None:
    sink_keyed_csv(df.select(*[F.col(c).cast(U64) for c in columns]), path, False, mode)


def csv_shape(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """n_rows (without blank lines and header) and n_columns (cells of a first line that aren't empty)."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    first = lines.limit(1).select(F.size(F.filter(F.split("value", ","), lambda c: c != "")).cast("bigint").alias("n_columns"))
    count = lines.agg((F.count(F.lit(1)) - (1 if header else 0)).alias("n_rows"))
    shape = first.unionByName(spark.createDataFrame([(0,)], "n_columns bigint")).agg(F.max("n_columns").alias("n_columns"))
    return count.join(F.broadcast(shape), F.lit(True)).select(F.greatest("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), "n_columns")
