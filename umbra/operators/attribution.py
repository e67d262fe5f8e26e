"""Conversion attribution: the sum of value over joined rows with 0 < t1 - t0 < window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import ring64
from umbra.functions.encoding import fixed_decode, fixed_encode
from umbra.operators import mpc, shares
from umbra.operators.match import intersection_features, waterfall_match
from umbra.operators.party import PartySpec
from umbra.operators.private_join import joined_shares, private_join


def window_predicate(t0: Column, t1: Column, window: float) -> Column:
    return (t1 - t0 > 0) & (t1 - t0 < window)


def attribution(joined: DataFrame, window: float, t0: str = "t0", t1: str = "t1", value: str = "value") -> DataFrame:
    """One row: attributed sum in clear, a single map-side-combined aggregate."""
    hit = window_predicate(F.col(t0), F.col(t1), window)
    return joined.agg(F.coalesce(F.sum(F.when(hit, F.col(value))), F.lit(0.0)).alias("attributed"), F.count_if(hit).alias("n_attributed"))


def attribution_fixed(joined: DataFrame, window: float, t0: str = "t0", t1: str = "t1", value: str = "value") -> DataFrame:
    """The same in 16-bit fixed point: comparisons by sign bits in the ring, then a sum modulo 2**64."""
    a, b, v = (fixed_encode(F.col(c)) for c in (t0, t1, value))
    dt = ring64.signed(ring64.sub(b, a))
    bit = shares.greater(dt, F.lit(0)) * shares.less(dt, F.lit(int(window * (1 << 16))))
    total = ring64.signed(ring64.total(ring64.unsigned(shares.mux(bit, v))))
    return joined.agg(F.coalesce(fixed_decode(total), F.lit(0.0)).alias("attributed"))


def contributions(held: DataFrame, window: float, seed: str, row: str = "row_no") -> DataFrame:
    """(row, party, s_c): shares of each row's attributed value from shares of t0, t1 and value. Nothing but the dealer's differences is opened."""
    df = mpc.wide(held, ["t0", "t1", "value"], row)
    df = df.withColumns({f"dt_{p}": mpc.minus(F.col(f"t1_{p}"), F.col(f"t0_{p}")) for p in (0, 1)})
    df = mpc.less(mpc.greater(df, "dt", 0, "after", seed, row), "dt", int(window * (1 << 16)), "soon", seed, row)
    df = mpc.conjunction(df, [("after", "soon", "hit")], f"{seed}:hit", row)
    return mpc.long(mpc.chosen(df, "hit", "value", "c", seed, row), ["c"], row)


def attribution_shared(joined: DataFrame, window: float, seed: str, row: str = "row_no") -> DataFrame:
    """The protocol's steps on shares of the encoded columns: compare, choose and add up; only the attributed sum is opened."""
    held = shares.share_doubles(joined, ["t0", "t1", "value"], seed, row)
    sums = shares.column_sum(contributions(held, window, seed, row), ["c"])
    return sums.agg(F.coalesce(fixed_decode(ring64.signed(ring64.total(F.col("s_c")))), F.lit(0.0)).alias("attributed"))


def private_measurement(sender: DataFrame, receiver: DataFrame, ids: list[str], window: float, seed: str, tau: int = 0) -> DataFrame:
    """A private join of impressions (t0) and conversions (t1, value) with dummies, whose joined rows go on as shares to attribution.

    The receiver's dummies have the value 0, so they add nothing.
    """
    s = sender.withColumn("t0", fixed_encode(F.col("t0")))
    r = receiver.withColumn("t1", fixed_encode(F.col("t1"))).withColumn("value", fixed_encode(F.col("value")))
    config = {"tau": tau, "seed": seed}
    joined = private_join(s, r, PartySpec(tuple(ids), ("t0",)), PartySpec(tuple(ids), ("t1", "value")), config | {"zero_column": -1}, config | {"zero_column": -1})
    held = joined_shares(joined, ["t0", "t1", "value"], seed)
    sums = shares.column_sum(contributions(held, window, seed), ["c"])
    return sums.agg(F.coalesce(fixed_decode(ring64.signed(ring64.total(F.col("s_c")))), F.lit(0.0)).alias("attributed"))


def measurement(sender: DataFrame, receiver: DataFrame, ids: list[str], window: float) -> DataFrame:
    """Waterfall match of impressions (t0) and conversions (t1, value), then attribution."""
    matched = waterfall_match(sender, receiver, ids)
    joined = intersection_features(matched, sender, receiver, PartySpec(tuple(ids), ("t0",)), PartySpec(tuple(ids), ("t1", "value")))
    return attribution(joined, window)
