"""Leakage curves: audits repeated over budgets and trials, in parallel over the cluster."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.audit import bayes, descent, sumtree
from umbra.audit.memo import Memo

ALGORITHMS = ("baseline", "improved", "dynamic", "bayes", "sum_tree", "sum_only")
_memo = Memo()


def run_one(algorithm: str, x: set[int], y: set[int], budget: int, seed: int) -> tuple[int, int]:
    """(members, others) resolved by one audit."""
    rng = random.Random(seed)
    if algorithm == "bayes":
        found = bayes.audit(np.array([int(e in y) for e in sorted(x)]), budget, seed=seed)
        return found[0], found[1]
    if algorithm == "sum_tree":
        a, b = sumtree.audit(x, y, budget, rng=rng)
    elif algorithm == "sum_only":
        a, b = descent.audit({(e, e) for e in x}, {(e, e) for e in y}, budget, descent.SUM_ONLY, rng)
    else:
        policy = {"baseline": descent.BASELINE, "improved": descent.IMPROVED}.get(algorithm) or descent.dynamic(_memo)
        a, b = descent.audit(x, y, budget, policy, rng)
    return len(a), len(b)


def leakage_trials(spark: SparkSession, x: list[int], y: list[int], budgets: list[int], trials: int, algorithms: tuple[str, ...] = ALGORITHMS, seed: int = 0) -> DataFrame:
    """algo, tau, trial, members, others: each (algorithm, budget, trial) is a row of its own, dealt over the cluster.

    x and y are the audit's sets, a parameter of some dozens of elements.
    """
    plan = spark.createDataFrame([(a, t) for a in algorithms for t in budgets], "algo string, tau int")
    plan = plan.select("algo", "tau", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).repartition("algo", "tau", "trial")
    xs, ys = set(x), set(y)

    def run(parts):
        for p in parts:
            done = [run_one(a, xs, ys, t, zlib.crc32(f"{seed}:{a}:{t}:{i}".encode())) for a, t, i in zip(p["algo"], p["tau"].tolist(), p["trial"].tolist(), strict=True)]
            yield p.assign(members=pd.Series([d[0] for d in done], dtype="int64", index=p.index), others=pd.Series([d[1] for d in done], dtype="int64", index=p.index))

    return plan.mapInPandas(run, "algo string, tau int, trial int, members bigint, others bigint")


def leakage_curve(spark: SparkSession, x: list[int], y: list[int], budgets: list[int], trials: int, algorithms: tuple[str, ...] = ALGORITHMS, seed: int = 0) -> DataFrame:
    """algo, tau, leak: elements resolved, averaged over the trials.

    As published, the baseline counts as having resolved all once it resolved as many as the intersection holds.
    """
    common, whole = len(set(x) & set(y)), len(set(x))
    found = F.col("members") + F.col("others")
    leak = F.when((F.col("algo") == "baseline") & (found == common), F.lit(whole)).otherwise(found)
    return leakage_trials(spark, x, y, budgets, trials, algorithms, seed).groupBy("algo", "tau").agg(F.avg(leak).alias("leak"))


def bisect_tree(x: DataFrame, seed: str, id_column: str = "id") -> DataFrame:
    """node, depth, member of a random balanced bisection tree: heap-numbered nodes, from the bits of each element's rank."""
    from umbra.operators.permute import generate_permutation

    ranked = generate_permutation(x.select(F.col(id_column).alias("row_no")), seed)
    n = ranked.count()
    levels = max(1, (n - 1).bit_length()) if n > 1 else 0
    # position in [0, 2**levels): rank r of n falls to floor(r * 2**levels / n)
    place = F.floor(F.col("target") * (1 << levels) / max(n, 1)).cast("bigint")
    nodes = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda d: F.struct((F.pow(F.lit(2), d).cast("bigint") + F.floor(place / F.pow(F.lit(2), F.lit(levels) - d)).cast("bigint")).alias("node"), d.alias("depth")))
    return ranked.select(F.col("row_no").alias("member"), F.explode(nodes).alias("x")).select("x.node", "x.depth", "member")
