"""What the protocols send, in bytes, from the sizes of the inputs."""

from __future__ import annotations

POINT, TOKEN, SHARE = 33, 12, 8


def match_bytes(rows_s: int, rows_r: int, ids: int, tau: int = 0) -> int:
    """Waterfall match: every id of both parties goes over as a point and comes back re-encrypted; one side's tokens go over for each round."""
    a, b = rows_s + ids * tau, rows_r + ids * tau
    return ids * (2 * POINT * (a + b) + TOKEN * a)


def join_bytes(rows_s: int, rows_r: int, ids: int, joined: int, features: int, tau: int = 0, modulus_bits: int = 2048) -> int:
    """Private join: the match, all rows' features as ciphertexts, and the joined rows' masked ones back."""
    cipher = modulus_bits // 4
    return match_bytes(rows_s, rows_r, ids, tau) + cipher * features * (rows_s + rows_r + 2 * ids * tau + joined)


def compare_bytes(rows: int, levels: int = 6) -> int:
    """One comparison a row: masked inputs, then two opened words of each party for every AND of the adder."""
    return rows * SHARE * (2 + 2 * 2 * (1 + 2 * levels))
