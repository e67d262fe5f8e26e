"""Seeded pseudo-random columns from SHA-256, so that results can be repeated and checked in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prf60(*parts: Column | str | int) -> Column:
    """A 60-bit whole number from the parts: the first 15 hex digits of sha256 of the parts joined by ':'."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[c.cast("string") for c in columns]).cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return prf60(*parts).cast("double") / float(1 << 60)


def word64(*parts: Column | str | int) -> Column:
    """64 pseudo-random bits as a signed bigint."""
    return prf60(*parts, "hi").bitwiseXOR(F.shiftleft(prf60(*parts, "lo"), 4))


def bernoulli(p: float, *parts: Column | str | int) -> Column:
    """1 with probability p, in steps of 1e-6."""
    return (F.floor(uniform(*parts) * 1_000_000) < p * 1_000_000).cast("int")


def random_keys(row: Column, *seed: Column | str | int, suffix: str = "") -> Column:
    """Ids of 32 alternating digits and letters and a suffix, from sha256 of the seed and row."""
    digest = F.sha2(F.concat_ws(":", *[c if isinstance(c, Column) else F.lit(str(c)) for c in seed], row.cast("string")).cast("binary"), 256)
    digits = F.translate(F.substring(digest, 1, 16), "abcdef", "012345")
    letters = F.translate(F.substring(digest, 17, 16), "0123456789", "ghijklmnop")
    pairs = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.concat(F.substring(digits, i, F.lit(1)), F.substring(letters, i, F.lit(1))))
    return F.concat(F.array_join(pairs, ""), F.lit(suffix))
