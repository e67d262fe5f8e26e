"""Noise for differential privacy from pseudo-random bits, and the parameters of releases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.prf import prf60, uniform, word64


def binomial_trials(epsilon: float, delta: float, sensitivity: float = 1.0) -> int:
    return math.ceil(8 * sensitivity**2 * math.log(2 / delta) / epsilon**2)


def binomial_noise(trials: int, *parts: Column | str | int) -> Column:
    """Centred Binomial(trials, 1/2): bits of 60-bit words, counted, less half the trials."""
    full, rest = divmod(trials, 60)
    count = F.lit(0)
    for w in range(full):
        count = count + F.bit_count(prf60(*parts, w))
    if rest:
        count = count + F.bit_count(prf60(*parts, full).bitwiseAND(F.lit((1 << rest) - 1)))
    return count.cast("double") - trials / 2


def shared_bits_noise(df: DataFrame, trials: int, seed: str, row: str = "row_no") -> DataFrame:
    """row and noise from two parties' bits: each party holds words, a bit counts where theirs differ; neither knows the noise."""
    words = -(-trials // 64)
    x = df.select(row, F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("w"))
    bits = word64(seed, "a", F.col(row), F.col("w")).bitwiseXOR(word64(seed, "b", F.col(row), F.col("w")))
    last = F.lit((1 << (trials - 64 * (words - 1))) - 1 if trials % 64 else -1)
    kept = F.when(F.col("w") == words - 1, bits.bitwiseAND(last.cast("bigint"))).otherwise(bits)
    return x.select(row, F.bit_count(kept).alias("n")).groupBy(row).agg((F.sum("n") - trials / 2).alias("noise"))


def laplace_noise(scale: float, *parts: Column | str | int, location: float = 0.0) -> Column:
    """Laplace(location, scale) by the inverse of its distribution function."""
    u = uniform(*parts) - 0.5
    return location - scale * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(2.0**-60)))


def stability_parameters(epsilon: float, delta: float) -> tuple[float, float]:
    """(threshold, scale) of a release by counts."""
    return 1 + math.log(1 / (2 * delta)) / epsilon, 1 / epsilon


def stability_budget(threshold: float, scale: float) -> tuple[float, float]:
    """(epsilon, delta) that a threshold and scale spend."""
    epsilon = max(1 / scale, math.log(1 + 1 / (2 * math.exp((threshold - 1) / scale) - 1)))
    return epsilon, 0.5 * math.exp(epsilon * (1 - threshold))


def noisy_count(count: Column, noise: Column, low: Column | float, high: Column | float) -> Column:
    """A count with noise in proportion to it, held in [low, high]."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(count * (1 + noise), as_column(low)), as_column(high))
