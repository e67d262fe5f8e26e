"""Count-mean sketch under local differential privacy: private reports, the sketch, and frequency estimates."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.encoding import hash_encode
from umbra.functions.prf import bernoulli, prf60


@dataclass(frozen=True)
class SketchParams:
    """k hash functions onto m cells; a report names s cells, the true one with probability p."""

    k: int = 1000
    m: int = 1024
    s: int = 56
    p: float = 0.5

    def __post_init__(self) -> None:
        if not (self.k > 0 and 0 < self.s < self.m and 0 < self.p < 1):
            raise ValueError("k > 0, 0 < s < m and 0 < p < 1 are needed")

    @property
    def epsilon(self) -> float:
        return math.log((self.m - self.s) * self.p / ((1 - self.p) * self.s))

    @property
    def q(self) -> float:
        """Probability that a report names another given cell."""
        return (self.p * (self.s - 1) + (1 - self.p) * self.s) / (self.m - 1)


def privatize(messages: DataFrame, params: SketchParams, seed: str | None = None) -> DataFrame:
    """client_id, j, x: one report for each message that isn't null.

    The other cells are a uniform subset of the m - 1, drawn one by one: the draw for place j takes a random cell up to j, or j
    itself if that one is taken (Floyd's sampling), so s hashes a report suffice. Without a seed the numbers are Spark's own
    and can't be repeated.
    """
    rows = messages.where(F.col("message").isNotNull())
    if seed is None:
        rows = rows.withColumn("_seed", F.expr("uuid()"))
    tag = F.lit(seed) if seed is not None else F.col("_seed")
    drawn = rows.select("client_id", (prf60(tag, "j", F.col("client_id")) % params.k).cast("int").alias("j"), "message", tag.alias("t"))
    hashed = drawn.withColumn("r", hash_encode(F.col("message"), F.col("j"), params.m).cast("int")).withColumn("hit", bernoulli(params.p, F.col("t"), "hit", F.col("client_id")))
    places = F.filter(F.sequence(F.lit(params.m - 1 - params.s), F.lit(params.m - 2)), lambda j: j >= F.lit(params.m - 1 - params.s) + F.col("hit"))
    tried = F.transform(places, lambda j: F.struct(j.alias("j"), (prf60(F.col("t"), "fill", F.col("client_id"), j) % (j + 1)).cast("int").alias("c")))
    taken = F.aggregate(tried, F.array().cast("array<int>"), lambda acc, z: F.array_append(acc, F.when(F.array_contains(acc, z["c"]), z["j"]).otherwise(z["c"])))
    fill = F.transform(taken, lambda c: F.when(c >= F.col("r"), c + 1).otherwise(c))  # of all cells but the true one
    return hashed.select("client_id", "j", F.array_sort(F.concat(F.when(F.col("hit") == 1, F.array("r")).otherwise(F.array().cast("array<int>")), fill)).alias("x"))


def build(reports: DataFrame) -> DataFrame:
    """j, pos, cnt: the sketch's cells that are not 0, by a map-side-combined count (at most k * m groups)."""
    return reports.select("j", F.explode("x").alias("pos")).groupBy("j", "pos").agg(F.count(F.lit(1)).alias("cnt"))


def merge(*sketches: DataFrame) -> DataFrame:
    """Sketches add cell by cell, so batches and days combine."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("j", "pos").agg(F.sum("cnt").alias("cnt"))


def estimate(sketch: DataFrame, n_reports: DataFrame, candidates: DataFrame, params: SketchParams) -> DataFrame:
    """message, est of the candidates; n_reports has one row with n."""
    cells = candidates.select("message", F.explode(F.sequence(F.lit(0), F.lit(params.k - 1))).alias("j"))
    cells = cells.select("message", "j", hash_encode(F.col("message"), F.col("j"), params.m).cast("int").alias("pos"))
    counts = cells.join(sketch, ["j", "pos"], "left").groupBy("message").agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("double").alias("c"))
    p, q, m = params.p, params.q, params.m
    n = F.lit(n_reports.first()["n"] or 0).cast("double")
    return counts.select("message", ((F.col("c") - p * n / m - q * n * (1 - 1 / m)) / ((p - q) * (1 - 1 / m))).alias("est"))


def repeated_estimates(messages: DataFrame, candidates: DataFrame, params: SketchParams, seeds: list[str]) -> DataFrame:
    """message, est: the mean of the estimates of one sketch for each seed."""
    n = messages.where(F.col("message").isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    runs = [estimate(build(privatize(messages, params, seed)), n, candidates, params) for seed in seeds]
    return reduce(DataFrame.unionByName, runs).groupBy("message").agg(F.avg("est").alias("est"))
