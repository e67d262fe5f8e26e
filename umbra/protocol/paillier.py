"""Paillier encryption of whole numbers, with packing of features and additive masks. For fixtures, not for speed."""

from __future__ import annotations

import hashlib
import math
import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_VALUE, MASK_BITS = 64, 40


def _prime(bits: int, rng: random.Random) -> int:
    while True:
        p = rng.getrandbits(bits) | (3 << (bits - 2)) | 1
        if all(p % q for q in (3, 5, 7, 11, 13, 17, 19, 23, 29)) and all(pow(rng.randrange(2, p - 1), p - 1, p) == 1 for _ in range(12)):
            return p


@dataclass(frozen=True)
class Key:
    """n is public; p and q are the owner's."""

    p: int
    q: int

    @property
    def n(self) -> int:
        return self.p * self.q

    def serialize(self) -> bytes:
        size = (self.p.bit_length() + 7) // 8
        return self.p.to_bytes(size, "little") + self.q.to_bytes(size, "little")

    @staticmethod
    def deserialize(data: bytes) -> Key:
        half = len(data) // 2
        return Key(int.from_bytes(data[:half], "little"), int.from_bytes(data[half:], "little"))


def generate(bits: int, seed: str) -> Key:
    rng = random.Random(hashlib.sha256(seed.encode()).digest())
    while True:
        key = Key(_prime(bits // 2, rng), _prime(bits // 2, rng))
        if key.p != key.q and math.gcd(key.n, (key.p - 1) * (key.q - 1)) == 1:
            return key


def encrypt(n: int, m: int, r: int) -> int:
    return (1 + (m % n) * n) * pow(r % n or 1, n, n * n) % (n * n)


def decrypt(key: Key, c: int) -> int:
    """By the two primes apart, then put together."""
    parts = []
    for p in (key.p, key.q):
        x = (pow(c, p - 1, p * p) - 1) // p
        g = (pow(1 + key.n, p - 1, p * p) - 1) // p
        parts.append(x * pow(g, -1, p) % p)
    a, b = parts
    return (a + key.p * ((b - a) * pow(key.p, -1, key.q) % key.q)) % key.n


def add(n: int, c: int, d: int) -> int:
    return c * d % (n * n)


def add_plain(n: int, c: int, m: int) -> int:
    return c * (1 + (m % n) * n) % (n * n)


def multiply(n: int, c: int, k: int) -> int:
    return pow(c, k % n, n * n)


def slots(n_bits: int, slot: int = SLOT_VALUE + MASK_BITS + 1) -> int:
    return n_bits // slot


def pack(values: list[int], slot: int = SLOT_VALUE + MASK_BITS + 1) -> int:
    return sum(v << (slot * i) for i, v in enumerate(values))


def unpack(m: int, count: int, slot: int = SLOT_VALUE + MASK_BITS + 1) -> list[int]:
    return [(m >> (slot * i)) & ((1 << slot) - 1) for i in range(count)]


def to_bytes(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8 or 1, "little")


def share_features(features: Column, key: Key, seed: str) -> Column:
    """array<decimal> of unsigned features to struct(owner, other): their additive shares modulo 2**64, made under encryption.

    The values are packed and encrypted, the other side adds random masks without seeing them, and the owner decrypts.
    """
    n, each, slot = key.n, slots(key.n.bit_length()), SLOT_VALUE + MASK_BITS + 1

    def run(rows: pd.Series) -> pd.DataFrame:
        own, other = [], []
        for values in rows:
            values = [int(v) for v in values]
            rng = random.Random(hashlib.sha256(f"{seed}:{values}".encode()).digest())
            masks = [rng.getrandbits(SLOT_VALUE + MASK_BITS) for _ in values]
            got: list[int] = []
            for i in range(0, len(values), each):
                c = encrypt(n, pack(values[i : i + each]), rng.randrange(2, n))
                c = add_plain(n, c, pack(masks[i : i + each]))
                got += unpack(decrypt(key, c), len(values[i : i + each]), slot)
            own.append([str(g % (1 << 64)) for g in got])
            other.append([str(-m % (1 << 64)) for m in masks])
        return pd.DataFrame({"owner": own, "other": other})

    return F.pandas_udf(run, "owner array<string>, other array<string>")(features)
