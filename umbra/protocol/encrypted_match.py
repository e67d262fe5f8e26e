"""The match as it is run between parties: ids as points, encrypted by both, re-keyed each round, and compared as short tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.encoding import token_truncate
from umbra.operators.match import waterfall_match
from umbra.protocol import p256


def tokens(party: DataFrame, ids: list[str], own: list[int], other: list[int]) -> DataFrame:
    """row_id and a token for each id: hashed to the curve and encrypted by the owner's first key, re-keyed to the round's, then by the
    other party's. Encryption commutes, so equal ids of two parties get equal tokens in a round, and unlike ones in different rounds."""
    columns = []
    for i, name in enumerate(ids):
        point = p256.hash_encrypt(F.col(name), own[0])
        mine = point if i == 0 else p256.rekey(point, own[i], own[0])
        columns.append(F.hex(token_truncate(p256.encrypt(mine, other[i]))).alias(name))
    return party.select("row_id", *columns)


def encrypted_match(sender: DataFrame, receiver: DataFrame, ids: list[str], s_seed: str, r_seed: str) -> DataFrame:
    """(s_row, r_row, match_round), as waterfall_match() gives on the clear ids; neither side's ids are compared in clear."""
    s_keys, r_keys = p256.private_keys(s_seed, len(ids)), p256.private_keys(r_seed, len(ids))
    return waterfall_match(tokens(sender, ids, s_keys, r_keys), tokens(receiver, ids, r_keys, s_keys), ids)
