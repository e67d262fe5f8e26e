"""The whole private join: dummies, waterfall match, joined features, additive shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import ring64
from umbra.operators import shares
from umbra.operators.dummies import dummy_rows, negotiated_tau, with_dummies
from umbra.operators.match import intersection_features, waterfall_match
from umbra.operators.party import PartySpec, check_parameters, load_config
from umbra.operators.permute import generate_permutation
from umbra.session import cut


def private_join(sender: DataFrame, receiver: DataFrame, s_spec: PartySpec, r_spec: PartySpec, s_config: dict | None = None, r_config: dict | None = None) -> DataFrame:
    """s_row, r_row, match_round and both sides' features of the joined rows, dummies among them.

    The receiver's zero column makes dummies harmless for its sum.
    """
    a, b = (load_config({"ids_num": len(spec.ids)} | (c or {})) for spec, c in ((s_spec, s_config), (r_spec, r_config)))
    check_parameters(a, b)
    spark, ids, tau = sender.sparkSession, list(s_spec.ids), negotiated_tau(a["tau"], b["tau"])
    if tuple(s_spec.ids) != tuple(r_spec.ids):
        raise ValueError("the parties' id columns differ")
    s = with_dummies(s_spec.select(sender), dummy_rows(spark, ids, list(s_spec.features), tau, "s", a["seed"], a["zero_column"]))
    r = with_dummies(r_spec.select(receiver), dummy_rows(spark, ids, list(r_spec.features), tau, "r", a["seed"], b["zero_column"]))
    return intersection_features(waterfall_match(s, r, ids), s, r, s_spec, r_spec)


def joined_shares(joined: DataFrame, features: list[str], seed: str) -> DataFrame:
    """row_no, party and the share columns of the joined features. Rows are permuted: a place tells neither party its row."""
    named = cut(joined.select(F.xxhash64(F.lit(seed), "s_row", "r_row").alias("_name"), *features))
    places = generate_permutation(named.select("_name"), f"{seed}:join", "_name").withColumnRenamed("target", "row_no")
    return shares.share(named.join(places, "_name").drop("_name"), features, seed)


def sum_check(shared: DataFrame, column: str) -> DataFrame:
    """The sum of a shared column, from the parties' sums."""
    sums = shares.column_sum(shared, [column])
    return sums.agg(ring64.signed(ring64.total(F.col(f"s_{column}"))).alias("total"))
