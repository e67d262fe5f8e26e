"""Party tables: a row id, K id columns, F feature columns; what must hold for them, and parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PartySpec:
    """Which columns of a DataFrame are the row id, the ids in order of trust, and the features."""

    ids: tuple[str, ...]
    features: tuple[str, ...] = ()
    row: str = "row_id"

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(self.row, *self.ids, *self.features)


DEFAULTS = {"ids_num": 1, "has_header": False, "sigma": 40, "epsilon": 2.0, "max_queries": 10, "tau": 1440, "use_precomputed_tau": True, "zero_column": None, "n_bits": 2048, "curve": "P-256", "seed": "umbra"}
MAX_IDS, MAX_TAU = 100, 1 << 20


def load_config(given: dict | None, defaults: dict | None = None) -> dict:
    """Merge patch over the defaults: dicts merge, None removes, everything else replaces."""
    out = dict(DEFAULTS if defaults is None else defaults)
    for k, v in (given or {}).items():
        if v is None and defaults is not None:
            out.pop(k, None)
        elif isinstance(v, dict):
            out[k] = load_config(v, out[k] if isinstance(out.get(k), dict) else {})
        else:
            out[k] = v
    return out


def check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def check_parameters(mine: dict, theirs: dict | None = None) -> None:
    """Ranges of one party's parameters, and agreement with the other's."""
    check(1 <= mine["ids_num"] <= MAX_IDS, f"ids_num must be in 1..{MAX_IDS}")
    check(0 <= mine["tau"] <= MAX_TAU, f"tau must be at most {MAX_TAU}")
    check(mine["n_bits"] in (1024, 2048, 3072), "n_bits must be 1024, 2048 or 3072")
    check(mine["curve"] == "P-256", "the curve must be P-256")
    check(mine["epsilon"] > 0, "epsilon must be positive")
    check(mine["use_precomputed_tau"], "only precomputed tau is supported")
    for k in ("ids_num", "sigma", "epsilon", "max_queries", "curve", "use_precomputed_tau") if theirs else ():
        check(mine[k] == theirs[k], f"the parties disagree on {k}: {mine[k]} and {theirs[k]}")


def duplicate_ids(df: DataFrame, spec: PartySpec) -> DataFrame:
    """(id_column, id, n) of ids that stand more than once in their column; a sound party table has none."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("id_column"), F.col(c).cast("string").alias("id")) for c in spec.ids])).alias("x"))
    return stacked.select("x.*").where(F.col("id").isNotNull()).groupBy("id_column", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate(df: DataFrame, spec: PartySpec) -> DataFrame:
    """df, or ValueError where an id repeats in its column."""
    found = duplicate_ids(df, spec).limit(1).collect()
    check(not found, f"id repeats: {found[0].asDict() if found else ''}")
    return df


def within(x: Column, low: int, high: int) -> Column:
    return x.between(low, high)
