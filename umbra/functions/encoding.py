"""Scalar encodings: fixed point, hashes to a range, packed whole numbers, hex, tokens."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION = 1 << 16


def fixed_encode(x: Column) -> Column:
    """trunc(x * 2**16) as bigint, towards zero."""
    return (x * float(FRACTION)).cast("bigint")


def fixed_decode(v: Column) -> Column:
    return v.cast("double") / float(FRACTION)


def hash_encode(message: Column, i: Column, m: int) -> Column:
    """sha256 of message, '$$$' and i as a whole number, modulo m (below 2**47), by a Horner scheme over 16-bit digits."""
    digest = F.sha2(F.concat(message, F.lit("$$$"), i.cast("string")).cast("binary"), 256)
    digit = lambda k: F.conv(F.substring(digest, k * 4 + 1, F.lit(4)), 16, 10).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("bigint"), lambda acc, k: (acc * 65536 + digit(k)) % m)


def serialize_ints(xs: Column, width: int) -> Column:
    """Whole numbers as big-endian bytes of a fixed width, end to end."""
    return F.unhex(F.array_join(F.transform(xs, lambda v: F.lpad(F.hex(v.cast("bigint")), 2 * width, "0")), ""))


def deserialize_ints(data: Column, width: int) -> Column:
    digits = F.hex(data)
    n = F.length(data) / width
    at = lambda i: F.substring(digits, i * (2 * width) + 1, F.lit(2 * width))
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.conv(at(i), 16, 10).cast("bigint")))


def sha256_digest(message: Column) -> Column:
    return F.unhex(F.sha2(message.cast("binary"), 256))


def _sha3(message: pd.Series) -> pd.Series:
    return message.map(lambda b: None if b is None else hashlib.sha3_256(bytes(b)).digest())


def sha3_256(message: Column) -> Column:
    """SHA3-256, which Spark lacks: a pandas UDF."""
    return F.pandas_udf(_sha3, "binary")(message.cast("binary"))


def hex_encode(x: Column) -> Column:
    return F.hex(x)


def hex_decode(x: Column) -> Column:
    return F.unhex(x)


def bool_pack(bits: Column) -> Column:
    """Booleans to bytes, 8 to each, the first in the lowest bit; the last byte is filled with zeros."""
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda acc, j: acc + F.when(F.coalesce(F.get(bits, i * 8 + j), F.lit(False)), F.pow(F.lit(2), j).cast("int")).otherwise(0))
    count = F.ceil(F.size(bits) / 8).cast("int")
    return F.when(count < 1, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")))


def bits_to_word(bits: Column) -> Column:
    """64 low bits, the first the highest, as one bigint."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("bigint").bitwiseAND(F.lit(1).cast("bigint"))))


def token_truncate(point: Column, size: int = 12) -> Column:
    """The last bytes of a compressed point: the match token."""
    return F.substring(point, -size, size)
