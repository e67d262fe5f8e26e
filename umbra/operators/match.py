"""Set matching: intersection, its size and sums, and the waterfall match over K id columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.operators.party import PartySpec
from umbra.session import cut


def psi(x: DataFrame, y: DataFrame, on: str = "id") -> DataFrame:
    """Distinct ids of x that are in y. A semi-join with map-side distinct; Catalyst picks broadcast or sort-merge."""
    return x.select(on).join(y.select(on), on, "left_semi").distinct()


def psi_cardinality(x: DataFrame, y: DataFrame, on: str = "id") -> DataFrame:
    return psi(x, y, on).agg(F.count(F.lit(1)).alias("cardinality"))


def psi_sum(x: DataFrame, y: DataFrame, on: str = "id", value: str = "value") -> DataFrame:
    """Number and sum over the (id, value) pairs that both sides hold."""
    both = x.select(on, value).join(y.select(on, value), [on, value], "left_semi").distinct()
    return both.agg(F.count(F.lit(1)).alias("cardinality"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def psi_sum_int(x: DataFrame, y: DataFrame, on: str = "id") -> DataFrame:
    """Number and sum of the common elements themselves."""
    return psi(x, y, on).agg(F.count(F.lit(1)).alias("cardinality"), F.coalesce(F.sum(on), F.lit(0)).alias("total"))


def set_difference(x: DataFrame, y: DataFrame, on: str = "id") -> DataFrame:
    return x.select(on).join(y.select(on), on, "left_anti").distinct()


def match_round(sender: DataFrame, receiver: DataFrame, id_column: str, number: int) -> DataFrame:
    """(s_row, r_row, match_round) of rows with equal ids in one column; null ids match nothing."""
    s = sender.select(F.col("row_id").alias("s_row"), id_column)
    r = receiver.select(F.col("row_id").alias("r_row"), id_column)
    return s.join(r, id_column).select("s_row", "r_row", F.lit(number).alias("match_round"))


def waterfall_match(sender: DataFrame, receiver: DataFrame, ids: list[str]) -> DataFrame:
    """(s_row, r_row, match_round): K rounds in column order; a row matched on both sides takes no part in later rounds.

    A round reads its own id column and leaves out, by one anti-join a side, the rows of all rounds before, whose row ids
    are written to the checkpoint folder. So each round has three joins, whatever K is (up to 100).
    """
    found: list[DataFrame] = []
    for k, column in enumerate(ids):
        s, r = sender.select("row_id", column), receiver.select("row_id", column)
        if found:
            before = reduce(DataFrame.unionByName, found)
            s = s.join(before.select(F.col("s_row").alias("row_id")), "row_id", "left_anti")
            r = r.join(before.select(F.col("r_row").alias("row_id")), "row_id", "left_anti")
        found.append(cut(match_round(s, r, column, k)))
    return reduce(DataFrame.unionByName, found)


def intersection_features(matched: DataFrame, sender: DataFrame, receiver: DataFrame, s_spec: PartySpec, r_spec: PartySpec) -> DataFrame:
    """Matched rows with both sides' features (sender's first); the join itself aligns them."""
    s = sender.select(F.col("row_id").alias("s_row"), *s_spec.features)
    r = receiver.select(F.col("row_id").alias("r_row"), *r_spec.features)
    return matched.join(s, "s_row").join(r, "r_row").select("s_row", "r_row", "match_round", *s_spec.features, *r_spec.features)
