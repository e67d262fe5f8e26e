"""Deterministic inputs: two parties with a wanted intersection, random ids and features, audit sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.prf import prf60, random_keys, uniform


def column_of_match(row: Column, shared: int, k: int, shares: tuple[float, ...] | None = None) -> Column:
    """Through which id column a shared row matches: blocks of rows, even or by the given shares (85, 10 and 5 % for three)."""
    bounds, acc = [], 0.0
    for i in range(k - 1):
        acc += shares[i] * shared if shares else -(-shared // k)
        bounds.append(int(min(acc, shared)))
    out = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        out = F.when(row < bounds[i], F.lit(i)).otherwise(out)
    return out


def party(spark: SparkSession, n: int, shared: int, k: int, features: int, side: str, seed: str = "umbra", shares: tuple[float, ...] | None = None) -> DataFrame:
    """n rows of one party ('s' or 'r'): row r < shared has, in its matching column, an id that the other party's row r has too."""
    row = F.col("id")
    own = column_of_match(row, shared, k, shares)
    ids = [
        F.when((row < shared) & (own == i), F.concat(F.lit(f"id_{i}_"), row.cast("string"))).otherwise(F.concat(F.lit(f"{side}_{i}_"), row.cast("string"))).alias(f"id_{i}")
        for i in range(k)
    ]
    values = [(prf60(seed, side, j, row) % 1_000_000).alias(f"f_{j}") for j in range(features)]
    return spark.range(n).select(row.alias("row_id"), *ids, *values)


BENCH_SHARES = (0.85, 0.10, 0.05)


def bench_parties(spark: SparkSession, shared: int, ratio: int = 2, k: int = 3, seed: str = "umbra") -> tuple[DataFrame, DataFrame]:
    """The benchmark's pair: rows = ratio * shared; three ids match 85, 10 and 5 % of the shared rows."""
    how = BENCH_SHARES if k == 3 else None
    return tuple(party(spark, ratio * shared, shared, k, 1, side, seed, how) for side in "sr")


def keys(spark: SparkSession, n: int, seed: str, suffix: str = "") -> DataFrame:
    return spark.range(n).select("id", random_keys(F.col("id"), seed, suffix=suffix).alias("key"))


def features(spark: SparkSession, n: int, seed: str, zero: bool = False) -> DataFrame:
    return spark.range(n).select("id", (F.lit(0).cast("bigint") if zero else prf60(seed, F.col("id"))).alias("value"))


def doubles(spark: SparkSession, n: int, low: float, high: float, seed: str, zero: bool = False) -> DataFrame:
    """Uniform doubles, shifted by half their range; zeros on demand."""
    x = low + uniform(seed, F.col("id")) * (high - low) + (high - low) / 2
    return spark.range(n).select("id", (F.lit(0.0) if zero else x).alias("value"))


def audit_sets(spark: SparkSession, n_x: int, n_y: int, common: int, dense: int = 2, dummies: int = 0, seed: str = "umbra") -> DataFrame:
    """id, in_x, in_y, is_dummy: sets with an exact overlap from the numbers below dense * all, in random order; dummies are apart."""
    need = n_x + n_y - common + dummies
    order = spark.range(max(need, dense * need)).select("id", prf60(seed, F.col("id")).alias("o")).orderBy("o", "id").limit(need)
    ranked = order.select("id", (F.row_number().over(_window()) - 1).alias("r"))
    return ranked.select("id", (F.col("r") < n_x).alias("in_x"), ((F.col("r") >= n_x - common) & (F.col("r") < n_x + n_y - common)).alias("in_y"), (F.col("r") >= n_x + n_y - common).alias("is_dummy"))


def independent_sets(spark: SparkSession, n_x: int, n_y: int, below: int, seed: str = "umbra") -> tuple[DataFrame, DataFrame]:
    """Two samples from 0..below-1 that know nothing of each other."""
    draw = lambda n, tag: spark.range(below).orderBy(prf60(seed, tag, F.col("id")), "id").limit(n)
    return draw(n_x, "x"), draw(n_y, "y")


def _window():
    from pyspark.sql import Window

    return Window.orderBy("o", "id")  # audit sets are some dozens of elements
