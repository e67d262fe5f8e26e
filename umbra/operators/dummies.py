"""Dummy rows that hide intersection sizes, and the published table of how many are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.prf import prf60, random_keys

EPSILONS = (1, 2, 4, 6, 8)
QUERIES = (6, 10, 20)
#: Published dummy counts; by ids (3, then 1) and log10 of rows, for QUERIES x EPSILONS.
TAU = {
    (3, 3): (1462, 433, 133, 68, 43, 2437, 722, 221, 113, 71, 4882, 1445, 441, 225, 142),
    (3, 4): (2005, 573, 169, 84, 52, 3342, 954, 281, 140, 87, 6697, 1910, 561, 280, 173),
    (3, 5): (2571, 717, 205, 101, 62, 4286, 1194, 342, 168, 103, 8588, 2390, 684, 336, 205),
    (3, 6): (3153, 864, 243, 118, 71, 5257, 1440, 405, 196, 119, 10534, 2882, 809, 392, 237),
    (1, 3): (487, 145, 45, 23, 15, 812, 241, 74, 38, 24, 1624, 481, 147, 75, 47),
    (1, 4): (669, 191, 57, 29, 18, 1114, 318, 94, 47, 29, 2227, 636, 187, 94, 58),
    (1, 5): (857, 240, 69, 35, 22, 1428, 399, 114, 56, 35, 2857, 796, 228, 112, 69),
    (1, 6): (1052, 289, 82, 40, 25, 1752, 480, 135, 66, 40, 3503, 960, 270, 131, 79),
}


def tau_rows() -> list[tuple[int, int, int, int, int]]:
    """(ids, rows, queries, epsilon, tau) of the published table."""
    return [(k, 10**n, q, e, row[i * len(EPSILONS) + j]) for (k, n), row in TAU.items() for i, q in enumerate(QUERIES) for j, e in enumerate(EPSILONS)]


def tau_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(tau_rows(), "ids int, n_rows bigint, queries int, epsilon int, tau int")


def tau_lookup(rows: int, epsilon: int, queries: int, ids: int) -> int:
    """The published count for the next table size at or above `rows`; ValueError where nothing was published."""
    for k, n, q, e, tau in sorted(tau_rows(), key=lambda r: r[1]):
        if k == ids and q == queries and e == epsilon and n >= rows:
            return tau
    raise ValueError("no tau was published for these parameters")


def negotiated_tau(mine: int, theirs: int) -> int:
    return max(mine, theirs)


def dummy_rows(spark: SparkSession, ids: list[str], features: list[str], tau: int, party: str, seed: str, zero_column: int | None = None) -> DataFrame:
    """ids' K * tau dummy rows of one party ('s' or 'r').

    In column i rows [i * tau, (i + 1) * tau) hold tau of 2 * tau ids that both parties know (each party draws its own
    by random rank), all other rows ids that only this party has. A negative zero_column counts from the end.
    """
    k = len(ids)
    rows = spark.range(k * tau).withColumnRenamed("id", "j")
    columns = []
    for i, name in enumerate(ids):
        # which of the 2 * tau common ids: an affine walk with an odd step over a power of two would not be uniform; rank decides
        own = F.lit("A" if party == "s" else "B")
        inside = (F.col("j") >= i * tau) & (F.col("j") < (i + 1) * tau)
        columns.append(F.when(inside, F.concat(F.lit("common:"), F.col(f"pick_{i}").cast("string"), F.lit(f":{i}"))).otherwise(F.concat(random_keys(F.col("j"), seed, party, suffix="D"), own, F.lit(f":{i}"))).alias(name))
    for i in range(k):
        pool = spark.range(2 * tau).select(F.col("id").alias(f"pick_{i}"), prf60(seed, "pick", party, i, F.col("id")).alias("o"))
        picked = pool.orderBy("o", f"pick_{i}").limit(tau)
        numbered = picked.select(f"pick_{i}", (F.row_number().over(_by_order()) - 1 + i * tau).cast("bigint").alias("j"))
        rows = rows.join(numbered, "j", "left")
    zero = None if zero_column is None or not features else features[zero_column % len(features)]
    values = [(F.lit(0) if f == zero else prf60(seed, "feature", party, f, F.col("j")) % 1000).cast("bigint").alias(f) for f in features]
    return rows.select(F.concat(F.lit(f"dummy-{party}-"), F.col("j").cast("string")).alias("row_id"), *columns, *values)


def _by_order():
    from pyspark.sql import Window

    return Window.orderBy("o")  # tau is bounded by a parameter


def with_dummies(party: DataFrame, dummies: DataFrame) -> DataFrame:
    """The party's rows and its dummies, row ids as text."""
    return party.withColumn("row_id", F.col("row_id").cast("string")).unionByName(dummies)
