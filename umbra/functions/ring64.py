"""Arithmetic modulo 2**64. Unsigned values are decimal(20,0), signed ones bigint; nothing overflows under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 1 << 64
_wide = "decimal(38,0)"
U64 = "decimal(20,0)"


def _modulus() -> Column:
    return F.lit(str(MODULUS)).cast(_wide)


def wrap(x: Column) -> Column:
    """Any whole number to its unsigned residue."""
    return F.pmod(x.cast(_wide), _modulus()).cast(U64)


def add(x: Column, y: Column) -> Column:
    return wrap(x.cast(_wide) + y.cast(_wide))


def sub(x: Column, y: Column) -> Column:
    return wrap(x.cast(_wide) - y.cast(_wide))


def neg(x: Column) -> Column:
    return wrap(-x.cast(_wide))


def signed(x: Column) -> Column:
    """Unsigned residue to the bigint of the same bits."""
    w = x.cast(_wide)
    return F.when(w >= F.lit(str(MODULUS >> 1)).cast(_wide), w - _modulus()).otherwise(w).cast("bigint")


def unsigned(x: Column) -> Column:
    """bigint to the unsigned residue of the same bits."""
    return wrap(x)


def total(x: Column) -> Column:
    """Aggregate: the sum of residues, modulo 2**64; decimal(30,0) partial sums hold 10**10 rows."""
    return wrap(F.sum(x.cast(U64)))
