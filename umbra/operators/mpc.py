"""Computing on two parties' shares: AND, adder, sign, comparison, oblivious transfer and choice; inputs are never opened.

A shared value `x` stands as two bigint columns, `x_0` and `x_1`, one party's each: additive shares modulo 2**64 or XOR
shares. One row holds both so that a single engine can play both parties; each party's expression reads its own columns,
what a dealer gave it, and opened values. Opened are only differences with the dealer's one-time numbers. The dealer's
numbers come from hashes of a seed and the row, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import ring64

LEVELS = 6


def dealt(df_row: Column, seed: str, *tag: str | int) -> Column:
    """64 pseudo-random bits of the dealer for a row."""
    return F.xxhash64(df_row, F.lit(":".join([seed, *map(str, tag)])))


def plus(x: Column, y: Column) -> Column:
    return ring64.signed(ring64.add(x, y))


def minus(x: Column, y: Column) -> Column:
    return ring64.signed(ring64.sub(x, y))


def wide(shares: DataFrame, columns: list[str], row: str = "row_no") -> DataFrame:
    """Share rows of both parties (row, party, s_<c>) side by side: <c>_0 and <c>_1."""
    own = lambda c, p: ring64.signed(F.max(F.when(F.col("party") == p, F.col(f"s_{c}")))).alias(f"{c}_{p}")
    return shares.groupBy(row).agg(*[own(c, p) for c in columns for p in (0, 1)])


def long(df: DataFrame, columns: list[str], row: str = "row_no") -> DataFrame:
    """The opposite of wide()."""
    parties = [F.struct(F.lit(p).alias("party"), *[ring64.unsigned(F.col(f"{c}_{p}")).alias(f"s_{c}") for c in columns]) for p in (0, 1)]
    return df.select(row, F.explode(F.array(*parties)).alias("x")).select(row, "x.*")


def xor_shared(df: DataFrame, columns: list[str], seed: str, row: str = "row_no") -> DataFrame:
    """df with XOR shares <c>_0, <c>_1 of clear columns, which go."""
    masks = {c: dealt(F.col(row), seed, "share", c) for c in columns}
    return df.withColumns({f"{c}_1": m for c, m in masks.items()}).withColumns({f"{c}_0": F.col(c).bitwiseXOR(F.col(f"{c}_1")) for c in columns}).drop(*columns)


def xor_open(name: str) -> Column:
    return F.col(f"{name}_0").bitwiseXOR(F.col(f"{name}_1"))


def conjunction(df: DataFrame, pairs: list[tuple[str, str, str]], seed: str, row: str = "row_no") -> DataFrame:
    """df with XOR shares of x & y for each (x, y, out), by AND triples (a, b, a & b): only x ^ a and y ^ b are opened."""
    given, opened, out = {}, {}, {}
    for x, y, z in pairs:
        for n in ("a_0", "a_1", "b_0", "b_1", "c_0"):
            given[f"_{z}_{n}"] = dealt(F.col(row), seed, z, n)
        part = lambda n, z=z: F.col(f"_{z}_{n}")
        given_c = part("a_0").bitwiseXOR(part("a_1")).bitwiseAND(part("b_0").bitwiseXOR(part("b_1"))).bitwiseXOR(part("c_0"))
        opened[f"_{z}_d"] = xor_open(x).bitwiseXOR(part("a_0")).bitwiseXOR(part("a_1"))
        opened[f"_{z}_e"] = xor_open(y).bitwiseXOR(part("b_0")).bitwiseXOR(part("b_1"))
        opened[f"_{z}_c_1"] = given_c
        for p in (0, 1):
            own = part(f"c_{p}").bitwiseXOR(part("d").bitwiseAND(part(f"b_{p}"))).bitwiseXOR(part("e").bitwiseAND(part(f"a_{p}")))
            out[f"{z}_{p}"] = own.bitwiseXOR(part("d").bitwiseAND(part("e"))) if p == 0 else own
    return df.withColumns(given).withColumns(opened).withColumns(out).drop(*given, *opened)


def added(df: DataFrame, x: str, y: str, out: str, seed: str, row: str = "row_no") -> DataFrame:
    """df with XOR shares of x + y modulo 2**64 from XOR shares, by a parallel-prefix adder: two ANDs a level, the rest is local."""
    df = df.withColumns({f"_p_{i}": F.col(f"{x}_{i}").bitwiseXOR(F.col(f"{y}_{i}")) for i in (0, 1)})
    df = conjunction(df.withColumns({f"_h_{i}": F.col(f"_p_{i}") for i in (0, 1)}), [(x, y, "_g")], f"{seed}:{out}:g", row)
    for k in range(LEVELS):
        df = df.withColumns({f"_{n}s_{i}": F.shiftleft(f"_{n}_{i}", 1 << k) for n in "gp" for i in (0, 1)})
        df = conjunction(df, [("_p", "_gs", "_t"), ("_p", "_ps", "_q")], f"{seed}:{out}:{k}", row)
        # a run that hands a carry on makes none itself, so "or" is "xor"
        df = df.withColumns({f"_g_{i}": F.col(f"_g_{i}").bitwiseXOR(F.col(f"_t_{i}")) for i in (0, 1)} | {f"_p_{i}": F.col(f"_q_{i}") for i in (0, 1)})
    sums = {f"{out}_{i}": F.col(f"_h_{i}").bitwiseXOR(F.shiftleft(f"_g_{i}", 1)) for i in (0, 1)}
    return df.withColumns(sums).drop(*[f"_{n}_{i}" for n in ("h", "g", "p", "t", "q", "gs", "ps") for i in (0, 1)])


def to_binary(df: DataFrame, x: str, out: str, seed: str, row: str = "row_no") -> DataFrame:
    """df with XOR shares of an additively shared x: each party XOR-shares its share, and the two are added."""
    masks = {f"_m{p}": dealt(F.col(row), seed, out, "mask", p) for p in (0, 1)}
    df = df.withColumns(masks).withColumns({"_u_0": F.col(f"{x}_0").bitwiseXOR(F.col("_m0")), "_u_1": F.col("_m0"), "_v_0": F.col("_m1"), "_v_1": F.col(f"{x}_1").bitwiseXOR(F.col("_m1"))})
    return added(df, "_u", "_v", out, seed, row).drop("_m0", "_m1", "_u_0", "_u_1", "_v_0", "_v_1")


def sign(df: DataFrame, x: str, out: str, seed: str, row: str = "row_no") -> DataFrame:
    """df with XOR shares of the highest bit of an additively shared x, in the lowest place."""
    df = to_binary(df, x, "_b", f"{seed}:{out}", row)
    return df.withColumns({f"{out}_{p}": F.shiftrightunsigned(f"_b_{p}", 63) for p in (0, 1)}).drop("_b_0", "_b_1")


def greater(df: DataFrame, x: str, y: str | int, out: str, seed: str, row: str = "row_no") -> DataFrame:
    """XOR shares of x > y, for a shared or a plain y: the sign of y - x, which each party subtracts by itself."""
    other = lambda p: F.col(f"{y}_{p}") if isinstance(y, str) else F.lit(y if p == 0 else 0).cast("bigint")
    df = df.withColumns({f"_gt_{p}": minus(other(p), F.col(f"{x}_{p}")) for p in (0, 1)})
    return sign(df, "_gt", out, seed, row).drop("_gt_0", "_gt_1")


def less(df: DataFrame, x: str, y: str | int, out: str, seed: str, row: str = "row_no") -> DataFrame:
    """XOR shares of x < y: the sign of x - y."""
    other = lambda p: F.col(f"{y}_{p}") if isinstance(y, str) else F.lit(y if p == 0 else 0).cast("bigint")
    df = df.withColumns({f"_lt_{p}": minus(F.col(f"{x}_{p}"), other(p)) for p in (0, 1)})
    return sign(df, "_lt", out, seed, row).drop("_lt_0", "_lt_1")


def random_transfer(df: DataFrame, name: str, seed: str, row: str = "row_no") -> DataFrame:
    """df with a dealt random oblivious transfer: the sender's <name>_m0 and _m1, the receiver's random _b and its message _mb."""
    df = df.withColumns({f"{name}_m0": dealt(F.col(row), seed, name, 0), f"{name}_m1": dealt(F.col(row), seed, name, 1), f"{name}_b": dealt(F.col(row), seed, name, "b").bitwiseAND(F.lit(1))})
    return df.withColumn(f"{name}_mb", F.when(F.col(f"{name}_b") == 1, F.col(f"{name}_m1")).otherwise(F.col(f"{name}_m0")))


def transferred(df: DataFrame, first: Column, second: Column, choice: Column, out: str, seed: str, row: str = "row_no") -> DataFrame:
    """df with out = second where the receiver's choice is 1, else first, and nothing else of the sender's: by a random transfer.

    The receiver opens its choice hidden by the random one; the sender's messages go hidden by its random ones, swapped by that.
    """
    df = random_transfer(df, "_ot", f"{seed}:{out}", row).withColumns({"_c": choice.cast("bigint"), "_x0": first, "_x1": second})
    df = df.withColumn("_d", F.col("_c").bitwiseXOR(F.col("_ot_b")))
    pad = lambda j: F.when(F.col("_d") == j, F.col("_ot_m0")).otherwise(F.col("_ot_m1"))
    df = df.withColumns({"_y0": F.col("_x0").bitwiseXOR(pad(0)), "_y1": F.col("_x1").bitwiseXOR(pad(1))})
    got = F.when(F.col("_c") == 1, F.col("_y1")).otherwise(F.col("_y0")).bitwiseXOR(F.col("_ot_mb"))
    return df.withColumn(out, got).drop("_ot_m0", "_ot_m1", "_ot_b", "_ot_mb", "_c", "_x0", "_x1", "_d", "_y0", "_y1")


def chosen(df: DataFrame, bit: str, x: str, out: str, seed: str, row: str = "row_no") -> DataFrame:
    """Additive shares of x where the XOR-shared bit (the lowest of its words) is 1, else of 0.

    Each party offers the other r and r + its share of x, in the order that its own half of the bit says, and keeps -r.
    """
    for p in (0, 1):
        df = df.withColumn(f"_r{p}", dealt(F.col(row), seed, out, "r", p))
        on, off = plus(F.col(f"_r{p}"), F.col(f"{x}_{p}")), F.col(f"_r{p}")
        mine, theirs = (F.col(f"{bit}_{q}").cast("bigint").bitwiseAND(F.lit(1)) for q in (p, 1 - p))
        df = transferred(df, F.when(mine == 1, on).otherwise(off), F.when(mine == 1, off).otherwise(on), theirs, f"_o{p}", f"{seed}:{out}:{p}", row)
    return df.withColumns({f"{out}_{p}": minus(F.col(f"_o{1 - p}"), F.col(f"_r{p}")) for p in (0, 1)}).drop("_r0", "_r1", "_o0", "_o1")
