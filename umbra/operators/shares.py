"""Secret shares modulo 2**64: additive and XOR shares, and what is computed on them (trusted-dealer randomness)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import ring64
from umbra.functions.encoding import fixed_decode, fixed_encode
from umbra.functions.prf import word64


def share(df: DataFrame, columns: list[str], seed: str, row: str = "row_no") -> DataFrame:
    """row, party (0, 1) and unsigned share columns s_<c>: party 1 holds a random word, party 0 the value less that word."""
    masks = [ring64.unsigned(word64(seed, c, F.col(row))).alias(f"_m_{c}") for c in columns]
    base = df.select(row, *columns, *masks)
    rows = F.array(
        F.struct(F.lit(0).alias("party"), *[ring64.sub(F.col(c), F.col(f"_m_{c}")).alias(f"s_{c}") for c in columns]),
        F.struct(F.lit(1).alias("party"), *[F.col(f"_m_{c}").alias(f"s_{c}") for c in columns]),
    )
    return base.select(row, F.explode(rows).alias("x")).select(row, "x.*")


def reveal(shares: DataFrame, columns: list[str], row: str = "row_no") -> DataFrame:
    """row and the signed values of the shared columns."""
    return shares.groupBy(row).agg(*[ring64.signed(ring64.total(F.col(f"s_{c}"))).alias(c) for c in columns])


def share_doubles(df: DataFrame, columns: list[str], seed: str, row: str = "row_no") -> DataFrame:
    return share(df.select(row, *[fixed_encode(F.col(c)).alias(c) for c in columns]), columns, seed, row)


def reveal_doubles(shares: DataFrame, columns: list[str], row: str = "row_no") -> DataFrame:
    return reveal(shares, columns, row).select(row, *[fixed_decode(F.col(c)).alias(c) for c in columns])


def finalize(share_mod_n: Column) -> Column:
    """A share modulo a larger n to one modulo 2**64."""
    return ring64.wrap(share_mod_n)


def column_sum(shares: DataFrame, columns: list[str]) -> DataFrame:
    """Each party's sums of its share columns; adding the parties' gives the columns' sums."""
    return shares.groupBy("party").agg(*[ring64.total(F.col(f"s_{c}")).alias(f"s_{c}") for c in columns])


def row_sum(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a + b.cast("bigint"))


def sign_bit(x: Column) -> Column:
    """The highest bit of a signed or unsigned word."""
    return F.shiftrightunsigned(x.cast("bigint"), 63).cast("int")


def greater(x: Column, y: Column) -> Column:
    """1 where x > y, as the sign of y - x in the ring; right while they differ by less than 2**63."""
    return sign_bit(ring64.signed(ring64.sub(y, x)))


def less(x: Column, y: Column) -> Column:
    return sign_bit(ring64.signed(ring64.sub(x, y)))


def mux(bit: Column, y: Column) -> Column:
    """y where the bit is set, else 0."""
    return F.when(bit.cast("int") == 1, y).otherwise(F.lit(0).cast("bigint"))
