"""P-256 in whole-number arithmetic: hash to curve, commutative encryption, re-keying. For fixtures, not for speed."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The curve's prime, coefficient b, order and base point.
P = 0xFFFFFFFF00000001000000000000000000000000FFFFFFFFFFFFFFFFFFFFFFFF
B = 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B
N = 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551
G = (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5)

Point = tuple[int, int] | None


def add(p: Point, q: Point) -> Point:
    if p is None or q is None:
        return q if p is None else p
    if p[0] == q[0]:
        if (p[1] + q[1]) % P == 0:
            return None
        slope = (3 * p[0] * p[0] - 3) * pow(2 * p[1], -1, P) % P
    else:
        slope = (q[1] - p[1]) * pow(q[0] - p[0], -1, P) % P
    x = (slope * slope - p[0] - q[0]) % P
    return x, (slope * (p[0] - x) - p[1]) % P


def multiply(k: int, p: Point) -> Point:
    out: Point = None
    k %= N
    while k:
        if k & 1:
            out = add(out, p)
        p = add(p, p)
        k >>= 1
    return out


def square_root(v: int) -> int | None:
    r = pow(v, (P + 1) // 4, P)
    return r if r * r % P == v % P else None


def hash_to_point(message: bytes) -> Point:
    """Try x = SHA3-256(counter, message) until it is on the curve; the even y."""
    for i in range(256):
        x = int.from_bytes(hashlib.sha3_256(bytes([i]) + message).digest(), "big") % P
        y = square_root((x * x * x - 3 * x + B) % P)
        if y is not None:
            return x, y if y % 2 == 0 else P - y
    raise ValueError("no point found")


def compress(p: Point) -> bytes:
    return bytes([2 + p[1] % 2]) + p[0].to_bytes(32, "big")


def decompress(data: bytes) -> Point:
    x = int.from_bytes(data[1:], "big")
    y = square_root((x * x * x - 3 * x + B) % P)
    if y is None:
        raise ValueError("not on the curve")
    return x, y if y % 2 == data[0] - 2 else P - y


def private_keys(seed: str, n: int) -> list[int]:
    """n scalars of full length."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest(), "big") % (N - (1 << 255)) + (1 << 255) for i in range(n)]


def _column(f, c: Column) -> Column:
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(v))

    return F.pandas_udf(apply, "binary")(c)


def hash_encrypt(message: Column, key: int) -> Column:
    """Compressed H(message) ** key."""
    return _column(lambda m: compress(multiply(key, hash_to_point(m.encode() if isinstance(m, str) else bytes(m)))), message)


def encrypt(point: Column, key: int) -> Column:
    return _column(lambda b: compress(multiply(key, decompress(bytes(b)))), point)


def rekey(point: Column, new: int, old: int) -> Column:
    """point ** (new / old): what was under `old` comes under `new`."""
    return encrypt(point, new * pow(old, -1, N) % N)
