"""Registry of the queries over the reference operators and their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.audit import compare, memo, sumtree
from umbra.functions import encoding, ring64
from umbra.functions.prf import bernoulli
from umbra.operators import attribution as attr
from umbra.operators import cost, discovery, dummies, match, mpc, noise, permute, private_join, shares, sketch
from umbra.operators.party import PartySpec, duplicate_ids
from umbra.plans import inputs
from umbra.plans.inputs import IDS, RECEIVER_SQL, SENDER_SQL, TOUCH_SQL, table
from umbra.protocol import encrypted_match as protocol_match
from umbra.session import shared_folder
from umbra.sources import csv_tables, generators
from umbra.streaming import streams

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DAYS3 = 3 * 86400.0
S_SPEC, R_SPEC = PartySpec(tuple(IDS), ("s_cents",)), PartySpec(tuple(IDS), ("r_nation",))


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def prf_sql(*parts: str) -> str:
    """DuckDB text of prf60; parts are SQL expressions."""
    return "('0x' || substr(sha256(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 1, 15))::BIGINT"


# --- set matching

X_IDS, Y_IDS = "SELECT c_custkey AS id FROM customer", "SELECT DISTINCT o_custkey AS id FROM orders"


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def _y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))


@query(f"SELECT id FROM ({X_IDS}) INTERSECT SELECT id FROM ({Y_IDS})")
def psi_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.psi(_x(spark, sf_dir), _y(spark, sf_dir))


@query(f"SELECT count(*) AS cardinality FROM (SELECT id FROM ({X_IDS}) INTERSECT SELECT id FROM ({Y_IDS}))")
def psi_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.psi_cardinality(_x(spark, sf_dir), _y(spark, sf_dir))


@query(f"SELECT count(*) AS cardinality, coalesce(sum(id), 0)::BIGINT AS total FROM (SELECT id FROM ({X_IDS}) INTERSECT SELECT id FROM ({Y_IDS}))")
def psi_sum_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.psi_sum_int(_x(spark, sf_dir), _y(spark, sf_dir))


@query(
    "SELECT count(*) AS cardinality, coalesce(sum(value), 0)::BIGINT AS total FROM (SELECT l_orderkey AS id, CAST(l_quantity AS BIGINT) AS value FROM lineitem"
    " INTERSECT SELECT l_partkey AS id, CAST(l_quantity AS BIGINT) AS value FROM lineitem)"
)
def psi_sum_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return match.psi_sum(lines.selectExpr("l_orderkey AS id", "CAST(l_quantity AS BIGINT) AS value"), lines.selectExpr("l_partkey AS id", "CAST(l_quantity AS BIGINT) AS value"))


@query(f"SELECT id FROM ({X_IDS}) EXCEPT SELECT id FROM ({Y_IDS})")
def set_difference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.set_difference(_x(spark, sf_dir), _y(spark, sf_dir))


MATCH_SQL = f"""WITH s AS ({SENDER_SQL}), r AS ({RECEIVER_SQL}),
m0 AS (SELECT s.row_id AS s_row, r.row_id AS r_row, 0 AS match_round FROM s JOIN r ON s.id_0 = r.id_0),
m1 AS (SELECT s.row_id AS s_row, r.row_id AS r_row, 1 AS match_round FROM s JOIN r ON s.id_1 = r.id_1
  WHERE s.row_id NOT IN (SELECT s_row FROM m0) AND r.row_id NOT IN (SELECT r_row FROM m0)),
m2 AS (SELECT s.row_id AS s_row, r.row_id AS r_row, 2 AS match_round FROM s JOIN r ON s.id_2 = r.id_2
  WHERE s.row_id NOT IN (SELECT s_row FROM m0 UNION ALL SELECT s_row FROM m1) AND r.row_id NOT IN (SELECT r_row FROM m0 UNION ALL SELECT r_row FROM m1)),
m AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2),
f AS (SELECT m.*, s.s_cents, r.r_nation FROM m JOIN s ON m.s_row = s.row_id JOIN r ON m.r_row = r.row_id)
"""


def _parties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return inputs.sender(spark, sf_dir), inputs.receiver(spark, sf_dir)


@query(MATCH_SQL + "SELECT s_row, r_row, match_round FROM m")
def waterfall_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.waterfall_match(*_parties(spark, sf_dir), IDS)


@query(MATCH_SQL + "SELECT match_round, count(*) AS n FROM m GROUP BY 1")
def waterfall_round_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.waterfall_match(*_parties(spark, sf_dir), IDS).groupBy("match_round").agg(F.count(F.lit(1)).alias("n"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = _parties(spark, sf_dir)
    return match.intersection_features(match.waterfall_match(s, r, IDS), s, r, S_SPEC, R_SPEC)


@query(MATCH_SQL + "SELECT sum(s_cents)::BIGINT AS s_total, sum(r_nation)::BIGINT AS r_total, count(*) AS n FROM f")
def waterfall_features_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).agg(F.sum("s_cents").alias("s_total"), F.sum("r_nation").alias("r_total"), F.count(F.lit(1)).alias("n"))


@query(MATCH_SQL + "SELECT s_row, r_row, match_round, s_cents, r_nation FROM f")
def intersection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)


@query("SELECT 'c_name' AS id_column, c_mktsegment AS id, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING count(*) > 1")
def duplicate_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS row_id", "c_mktsegment AS c_name")
    return duplicate_ids(rows, PartySpec(("c_name",)))


# --- dummies

TAU = 64


def _with_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = {"tau": TAU, "seed": "umbra"}
    return private_join.private_join(*_parties(spark, sf_dir), S_SPEC, R_SPEC, config, config | {"zero_column": 0})


_picks = " UNION ALL ".join(
    f"SELECT {i} AS c, '{side}' AS side, range AS pick, row_number() OVER (ORDER BY {prf_sql(repr('umbra'), repr('pick'), repr(side), str(i), 'range')}, range) AS n FROM range({2 * TAU})" for i in range(3) for side in "sr"
)
_DUMMY_SQL = f"picks AS (SELECT * FROM ({_picks}) WHERE n <= {TAU}), both_sides AS (SELECT c, pick FROM picks GROUP BY c, pick HAVING count(*) = 2)"


@query(MATCH_SQL.rstrip() + f", {_DUMMY_SQL} SELECT (SELECT count(*) FROM m) + (SELECT count(*) FROM both_sides) AS n, (SELECT sum(r_nation)::BIGINT FROM f) AS r_total")
def join_with_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receiver's sum is the one without dummies, as its dummies are zero."""
    return _with_dummies(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("r_nation").alias("r_total"))


@query(MATCH_SQL + "SELECT sum(r_nation)::BIGINT AS total FROM f")
def join_shares_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_join.sum_check(private_join.joined_shares(_with_dummies(spark, sf_dir), ["s_cents", "r_nation"], "umbra"), "r_nation")


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {n}::BIGINT, {q}, {e}, {t})" for k, n, q, e, t in dummies.tau_rows()) + ") AS t(ids, n_rows, queries, epsilon, tau)")
def tau_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dummies.tau_table(spark)


# --- attribution

_TOUCH = f"WITH {TOUCH_SQL} "


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.impressions(spark, sf_dir).join(inputs.conversions(spark, sf_dir), "user_id")


@query(_TOUCH + f"SELECT coalesce(sum(value) FILTER (t1 - t0 > 0 AND t1 - t0 < {DAYS3}), 0) AS attributed, count(*) FILTER (t1 - t0 > 0 AND t1 - t0 < {DAYS3}) AS n_attributed FROM j")
def attribution_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = attr.attribution(_touches(spark, sf_dir), DAYS3)
    return out.select(F.round("attributed", 6).alias("attributed"), "n_attributed")


ORACLE["attribution_sum"] = ORACLE["attribution_sum"].replace("coalesce(sum", "round(coalesce(sum", 1).replace(", 0) AS attributed", ", 0), 6) AS attributed", 1)


@query(_TOUCH + f"SELECT user_id, round(t1 - t0, 6) AS dt, value FROM j WHERE t1 - t0 > 0 AND t1 - t0 < {DAYS3}")
def attribution_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _touches(spark, sf_dir).where(attr.window_predicate(F.col("t0"), F.col("t1"), DAYS3))
    return j.select("user_id", F.round(F.col("t1") - F.col("t0"), 6).alias("dt"), "value")


_FIXED = (
    f"SELECT coalesce(sum(trunc(value * 65536)::BIGINT) FILTER (trunc(t1 * 65536)::BIGINT - trunc(t0 * 65536)::BIGINT > 0"
    f" AND trunc(t1 * 65536)::BIGINT - trunc(t0 * 65536)::BIGINT < {int(DAYS3 * 65536)}), 0)::DOUBLE / 65536 AS attributed FROM j"
)


@query(_TOUCH + _FIXED)
def attribution_fixed_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attr.attribution_fixed(_touches(spark, sf_dir), DAYS3)


@query(_TOUCH + _FIXED)
def attribution_shared_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attr.attribution_shared(_touches(spark, sf_dir).withColumnRenamed("user_id", "row_no"), DAYS3, "umbra")


@query(_TOUCH + f"SELECT round(coalesce(sum(value) FILTER (t1 - t0 > 0 AND t1 - t0 < {DAYS3}), 0), 6) AS attributed, count(*) FILTER (t1 - t0 > 0 AND t1 - t0 < {DAYS3}) AS n_attributed FROM j")
def measurement_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match through ids and all: impressions and conversions as party tables."""
    ids = ["CAST(user_id AS STRING) AS id_0", "concat('x', user_id) AS id_1"]
    s = inputs.impressions(spark, sf_dir).selectExpr("user_id AS row_id", *ids, "t0")
    r = inputs.conversions(spark, sf_dir).selectExpr("user_id AS row_id", *ids, "t1", "value")
    return attr.measurement(s, r, ["id_0", "id_1"], DAYS3).select(F.round("attributed", 6).alias("attributed"), "n_attributed")


@query(_TOUCH + _FIXED)
def private_measurement_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private join with dummies, then attribution on the joined rows' shares."""
    ids = ["CAST(user_id AS STRING) AS id_0", "concat('x', user_id) AS id_1"]
    s = inputs.impressions(spark, sf_dir).selectExpr("user_id AS row_id", *ids, "t0")
    r = inputs.conversions(spark, sf_dir).selectExpr("user_id AS row_id", *ids, "t1", "value")
    return attr.private_measurement(s, r, ["id_0", "id_1"], DAYS3, "umbra", TAU)


@query(
    "SELECT a.user_id AS id, epoch_us(a.ts) AS t0, epoch_us(b.ts) AS t1, b.value FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts < a.ts + INTERVAL 1 HOUR"
    " WHERE a.event_type = 'click' AND b.event_type = 'purchase'"
)
def attribution_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases read as streams and joined by interval, once all of them have come."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    clicks = source.where("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("t0"))
    bought = source.where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("t1"), "value")
    name = f"touches_{uuid.uuid4().hex}"
    joined = streams.attribution_stream(clicks, bought, "1 hour")
    running = joined.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", shared_folder(spark)).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.table(name).select("id", F.unix_micros("t0").alias("t0"), F.unix_micros("t1").alias("t1"), "value")


# --- shares


def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS row_no", "CAST(round(c_acctbal * 100) AS BIGINT) AS cents", "CAST(c_nationkey AS BIGINT) * 20000 AS other")


_CENTS = "WITH c AS (SELECT c_custkey AS row_no, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, CAST(c_nationkey AS BIGINT) * 20000 AS other FROM customer) "


@query(_CENTS + "SELECT row_no, cents, other FROM c")
def share_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares.reveal(shares.share(_cents(spark, sf_dir), ["cents", "other"], "umbra"), ["cents", "other"])


@query(_CENTS + "SELECT sum(cents)::BIGINT AS cents, sum(other)::BIGINT AS other FROM c")
def share_column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = shares.column_sum(shares.share(_cents(spark, sf_dir), ["cents", "other"], "umbra"), ["cents", "other"])
    return sums.agg(*[ring64.signed(ring64.total(F.col(f"s_{c}"))).alias(c) for c in ("cents", "other")])


@query(_CENTS + "SELECT row_no, CAST(cents > other AS INTEGER) AS gt, CAST(cents < other AS INTEGER) AS lt, CAST(cents < 0 AS INTEGER) AS sign, CAST(cents > 1000 AS INTEGER) AS gt_plain, CASE WHEN cents > other THEN cents ELSE 0 END AS chosen FROM c")
def compare_and_mux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons and choice on shares; opened here are the results alone."""
    df = mpc.wide(shares.share(_cents(spark, sf_dir), ["cents", "other"], "umbra"), ["cents", "other"])
    df = mpc.less(mpc.greater(df, "cents", "other", "gt", "umbra"), "cents", "other", "lt", "umbra")
    df = mpc.greater(mpc.sign(df, "cents", "sign", "umbra"), "cents", 1000, "gt_plain", "umbra")
    df = mpc.chosen(df, "gt", "cents", "chosen", "umbra")
    bits = [mpc.xor_open(c).cast("int").alias(c) for c in ("gt", "lt", "sign", "gt_plain")]
    return df.select("row_no", *bits, mpc.plus(F.col("chosen_0"), F.col("chosen_1")).alias("chosen"))


@query(_CENTS + "SELECT row_no, cents & other AS anded, cents + other AS added FROM c")
def beaver_and_adder(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mpc.xor_shared(_cents(spark, sf_dir), ["cents", "other"], "umbra")
    df = mpc.added(mpc.conjunction(df, [("cents", "other", "anded")], "umbra"), "cents", "other", "added", "umbra")
    return df.select("row_no", mpc.xor_open("anded").alias("anded"), mpc.xor_open("added").alias("added"))


@query(_CENTS + "SELECT row_no, cents FROM c")
def arithmetic_to_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mpc.wide(shares.share(_cents(spark, sf_dir), ["cents"], "umbra"), ["cents"])
    return mpc.to_binary(df, "cents", "b", "umbra").select("row_no", mpc.xor_open("b").alias("cents"))


@query(_CENTS + "SELECT row_no, CASE WHEN other > 200000 THEN cents ELSE other END AS got, 1 AS dealt_right FROM c")
def oblivious_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receiver's chosen message; the dealt random transfer gives the receiver the message of its random choice."""
    df = mpc.transferred(_cents(spark, sf_dir), F.col("other"), F.col("cents"), (F.col("other") > 200000).cast("int"), "got", "umbra")
    df = mpc.random_transfer(df, "ot", "umbra")
    right = F.col("ot_mb") == F.when(F.col("ot_b") == 1, F.col("ot_m1")).otherwise(F.col("ot_m0"))
    return df.select("row_no", "got", (right & (F.col("ot_m0") != F.col("ot_m1"))).cast("int").alias("dealt_right"))


@query(_CENTS + "SELECT row_no, cents, bit_count(row_no)::BIGINT AS ones, row_no AS word FROM c")
def share_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares modulo a larger number brought to 2**64, sums of bits, words of bits."""
    rows = _cents(spark, sf_dir)
    big = (F.col("cents").cast("decimal(38,0)") + F.lit(str(5 << 64)).cast("decimal(38,0)"))
    bits = F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda i: F.getbit("row_no", i).cast("int"))
    return rows.select("row_no", ring64.signed(shares.finalize(big)).alias("cents"), shares.row_sum(bits).alias("ones"), encoding.bits_to_word(bits).alias("word"))


@query(_CENTS + "SELECT row_no, cents FROM c")
def shares_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share tables of both parties through CSV in the shared folder and back, then opened."""
    folder = shared_folder(spark) + "/shares-csv"
    columns = ["row_no", "party", "s_cents"]
    csv_tables.sink_shares_csv(shares.share(_cents(spark, sf_dir), ["cents"], "umbra"), columns, folder, mode="overwrite")
    back = csv_tables.scan_shares_csv(spark, folder, columns).select(F.col("row_no").cast("bigint").alias("row_no"), F.col("party").cast("int").alias("party"), "s_cents")
    return shares.reveal(back, ["cents"])


@query("SELECT count(*) AS n_rows, 4::BIGINT AS n_columns FROM customer")
def csv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark) + "/shape-csv"
    csv_tables.sink_keyed_csv(inputs.receiver(spark, sf_dir).select(*IDS, "r_nation"), folder, mode="overwrite")
    return csv_tables.csv_shape(spark, folder)


@query(_CENTS + "SELECT row_no, (cents::HUGEINT - other::HUGEINT)::BIGINT AS difference, (-cents)::BIGINT AS negated, (cents::HUGEINT * 0 + 18446744073709551616 + other - 18446744073709551616)::BIGINT AS wrapped FROM c")
def ring_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("cents"), F.col("other")
    return _cents(spark, sf_dir).select("row_no", ring64.signed(ring64.sub(c, o)).alias("difference"), ring64.signed(ring64.neg(c)).alias("negated"), ring64.signed(ring64.add(o, F.lit(str(1 << 64)).cast("decimal(38,0)"))).alias("wrapped"))


# --- noise, permutations

TRIALS = noise.binomial_trials(1.0, 1e-5)
_words = [f"bit_count({prf_sql(repr('umbra'), 'c_custkey', str(w))}{'' if (w + 1) * 60 <= TRIALS else f' & {(1 << (TRIALS % 60)) - 1}'})" for w in range(-(-TRIALS // 60))]


@query(f"SELECT c_custkey AS id, ({' + '.join(_words)})::DOUBLE - {TRIALS / 2} AS noise FROM customer")
def binomial_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), noise.binomial_noise(TRIALS, "umbra", F.col("c_custkey")).alias("noise"))


_U = f"({prf_sql(repr('umbra'), repr('laplace'), 'c_custkey')}::DOUBLE / {1 << 60} - 0.5)"


@query(f"SELECT c_custkey AS id, round(0.0 - 2.0 * sign({_U}) * ln(greatest(1 - 2 * abs({_U}), {2.0**-60})), 9) AS noise FROM customer")
def laplace_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(noise.laplace_noise(2.0, "umbra", "laplace", F.col("c_custkey")), 9).alias("noise"))


def _noisy_segments(key: str) -> str:
    words = " + ".join(f"bit_count({prf_sql(repr('segments'), key, str(w))}{'' if (w + 1) * 60 <= TRIALS else f' & {(1 << (TRIALS % 60)) - 1}'})" for w in range(-(-TRIALS // 60)))
    return f"({words})::DOUBLE - {TRIALS / 2}"


@query(f"SELECT c_mktsegment AS segment, count(*) + {_noisy_segments('c_mktsegment')} AS noisy FROM customer GROUP BY c_mktsegment")
def noisy_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("segment", (F.col("n") + noise.binomial_noise(TRIALS, "segments", F.col("segment"))).alias("noisy"))


@query(f"SELECT c_custkey AS id, row_number() OVER (ORDER BY {prf_sql(repr('umbra'), 'c_custkey')}, c_custkey) - 1 AS target FROM customer")
def permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_no"))
    return permute.generate_permutation(rows, "umbra").select(F.col("row_no").alias("id"), "target")


@query("SELECT c_custkey - min(c_custkey) OVER () AS row_no, c_name AS name FROM customer")
def permute_unpermute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    least = rows.agg(F.min("c_custkey")).first()[0]
    rows = rows.select((F.col("c_custkey") - F.lit(least)).alias("row_no"), F.col("c_name").alias("name"))
    p = permute.generate_permutation(rows, "umbra")
    return permute.unpermute(permute.permute(rows, p), p).select("row_no", "name")


@query(f"SELECT c_custkey AS id, CAST(floor({prf_sql(repr('umbra'), 'c_custkey')}::DOUBLE / {1 << 60} * 1000000) < 0.3 * 1000000 AS INTEGER) AS bit FROM customer")
def bernoulli_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), bernoulli(0.3, "umbra", F.col("c_custkey")).alias("bit"))


# --- sketch and discovery

PARAMS = sketch.SketchParams(k=16, m=64, s=4, p=0.5)


def _fold(m: int) -> str:
    acc = "0::BIGINT"
    for k in range(16):
        acc = f"(({acc}) * 65536 + ('0x' || substr(d, {4 * k + 1}, 4))::BIGINT) % {m}"
    return acc


@query(f"SELECT id, {_fold(1000)} AS h FROM (SELECT c_custkey AS id, sha256(c_name || '$$$' || CAST(c_custkey % 7 AS VARCHAR)) AS d FROM customer)")
def hash_encode_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), encoding.hash_encode(F.col("c_name"), F.col("c_custkey") % 7, 1000).alias("h"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), F.col("c_mktsegment").alias("message"))


_FIRST = PARAMS.m - 1 - PARAMS.s
_FLOYD = "".join(
    f"f{i} AS (SELECT *, " + ("CASE WHEN hit = 0 THEN " if i == 0 else "CASE WHEN true THEN ") + f"CASE WHEN t{i} IN ({', '.join(['-1', *(f'c{k}' for k in range(i))])}) THEN {_FIRST + i} ELSE t{i} END END AS c{i}"
    f" FROM (SELECT *, {prf_sql(repr('umbra'), repr('fill'), 'client_id', str(_FIRST + i))} % {_FIRST + i + 1} AS t{i} FROM {'r1' if i == 0 else f'f{i - 1}'})),\n"
    for i in range(PARAMS.s)
) + "fill AS (" + " UNION ALL ".join(f"SELECT client_id, j, r, c{i} AS c FROM f{PARAMS.s - 1}" for i in range(PARAMS.s)) + "),"
_REPORTS = f"""WITH r0 AS (SELECT c_custkey AS client_id, c_mktsegment AS message, {prf_sql("'umbra'", "'j'", "c_custkey")} % {PARAMS.k} AS j,
  CAST(floor({prf_sql("'umbra'", "'hit'", "c_custkey")}::DOUBLE / {1 << 60} * 1000000) < {PARAMS.p} * 1000000 AS INTEGER) AS hit FROM customer WHERE c_mktsegment IS NOT NULL),
r1 AS (SELECT client_id, j, hit, {_fold(PARAMS.m)} AS r FROM (SELECT *, sha256(message || '$$$' || CAST(j AS VARCHAR)) AS d FROM r0)),
{_FLOYD}
x AS (SELECT client_id, j, r AS pos FROM r1 WHERE hit = 1 UNION ALL SELECT client_id, j, CASE WHEN c >= r THEN c + 1 ELSE c END AS pos FROM fill WHERE c IS NOT NULL),
cells AS (SELECT j, pos, count(*) AS cnt FROM x GROUP BY 1, 2)
"""


@query(_REPORTS + "SELECT CAST(j AS INTEGER) AS j, CAST(pos AS INTEGER) AS pos, cnt FROM cells")
def sketch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.build(sketch.privatize(_messages(spark, sf_dir), PARAMS, "umbra"))


@query(_REPORTS + "SELECT CAST(j AS INTEGER) AS j, CAST(pos AS INTEGER) AS pos, cnt FROM cells")
def sketch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches of each nation's reports, added cell by cell."""
    reports = sketch.privatize(_messages(spark, sf_dir), PARAMS, "umbra").join(table(spark, sf_dir, "customer").selectExpr("c_custkey AS client_id", "c_nationkey AS nation"), "client_id")
    return sketch.merge(*[sketch.build(reports.where((F.col("nation") < 10) == low)) for low in (True, False)])


@query(_REPORTS + "SELECT CAST(j AS INTEGER) AS j, CAST(pos AS INTEGER) AS pos, cnt FROM cells")
def sketch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running sketch over the customers read as a stream, once all of them have come."""
    source = spark.readStream.schema(table(spark, sf_dir, "customer").schema).parquet(f"{sf_dir}/customer.parquet*")
    messages = source.select(F.col("c_custkey").alias("client_id"), F.col("c_mktsegment").alias("message"))
    name = f"sketch_{uuid.uuid4().hex}"
    running = streams.start_sketch(messages, PARAMS, "umbra", name, shared_folder(spark))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.table(name)


@query(_REPORTS + "SELECT CAST(j AS INTEGER) AS j, string_agg(pos, ',' ORDER BY pos) AS cells FROM x GROUP BY client_id, j")
def shuffled_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as the analyst gets them: in random order, without who sent them."""
    reports = sketch.privatize(_messages(spark, sf_dir), PARAMS, "umbra")
    return permute.shuffle_reports(reports, "umbra").select("j", F.array_join(F.transform("x", lambda c: c.cast("string")), ",").alias("cells"))


_q = PARAMS.q
_EST = f"round((c - {PARAMS.p} * n / {PARAMS.m} - {_q!r} * n * (1 - 1.0::DOUBLE / {PARAMS.m})) / (({PARAMS.p} - {_q!r}) * (1 - 1.0::DOUBLE / {PARAMS.m})), 6)"


@query(
    _REPORTS
    + f", cand AS (SELECT message, j, {_fold(PARAMS.m)} AS pos FROM (SELECT message, t.range AS j, sha256(message || '$$$' || CAST(t.range AS VARCHAR)) AS d FROM (SELECT DISTINCT c_mktsegment AS message FROM customer), range({PARAMS.k}) t))"
    + f" SELECT message, {_EST} AS est FROM (SELECT message, coalesce(sum(cnt), 0)::DOUBLE AS c, (SELECT count(*) FROM r0)::DOUBLE AS n FROM cand LEFT JOIN cells USING (j, pos) GROUP BY message)"
)
def sketch_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    built = sketch.build(sketch.privatize(messages, PARAMS, "umbra"))
    n = messages.where("message IS NOT NULL").agg(F.count(F.lit(1)).alias("n"))
    return sketch.estimate(built, n, messages.select("message").distinct(), PARAMS).select("message", F.round("est", 6).alias("est"))


_ONE = ORACLE["sketch_estimates"]


@query(f"SELECT message, round(avg(est), 6) AS est FROM (({_ONE}) UNION ALL ({_ONE.replace(repr('umbra'), repr('again'))})) GROUP BY message")
def repeated_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    out = sketch.repeated_estimates(messages, messages.select("message").distinct(), PARAMS, ["umbra", "again"])
    return out.select("message", F.round("est", 6).alias("est"))


EPSILON, DELTA = 0.1, 1e-5
#: Keys of the queries' server and analyst.
KEYS = ("0123456789abcdef", "fedcba9876543210")
_T, _B = noise.stability_parameters(EPSILON, DELTA)
_LAP = f"({prf_sql(repr('umbra'), repr('release'), 'upper(sha256(w))')}::DOUBLE / {1 << 60} - 0.5)"
_WORDS = "SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w FROM documents WHERE text IS NOT NULL"


@query(f"SELECT w AS message FROM (SELECT w, count(*) AS n FROM ({_WORDS}) WHERE w <> '' GROUP BY w) WHERE n + (0.0 - {_B!r} * sign({_LAP}) * ln(greatest(1 - 2 * abs({_LAP}), {2.0**-60}))) >= {_T!r}")
def discover_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("client_id"), F.explode(F.split("text", "\\s+")).alias("message")).where("message <> ''")
    return discovery.discover(words, EPSILON, DELTA, "umbra", *KEYS)


@query("SELECT upper(sha256(c_mktsegment)) AS digest, count(*) AS cnt, c_mktsegment AS message FROM customer GROUP BY c_mktsegment")
def digest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope for each client, grouped by digest; the picked envelope of each group opened by both keys in turn."""
    groups = discovery.open_outer(discovery.digest_group(discovery.enclose(_messages(spark, sf_dir), *KEYS), "umbra"), KEYS[0])
    return groups.select(F.hex("digest").alias("digest"), "cnt", F.aes_decrypt("envelope", F.lit(KEYS[1]), F.lit("GCM")).cast("string").alias("message"))


_BUDGET_ROWS = [(2.0, 1.0), (68.7, 10.0), (200.0, 4.0)]


@query(
    "SELECT threshold, scale, round(e, 9) AS epsilon, round(0.5 * exp(e * (1 - threshold)), 12) AS delta FROM (SELECT threshold, scale, greatest(1 / scale, ln(1 + 1 / (2 * exp((threshold - 1) / scale) - 1))) AS e"
    " FROM (VALUES " + ", ".join(f"({t}::DOUBLE, {b}::DOUBLE)" for t, b in _BUDGET_ROWS) + ") AS t(threshold, scale))"
)
def stability_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, b, *noise.stability_budget(t, b)) for t, b in _BUDGET_ROWS]
    return spark.createDataFrame([(t, b, round(e, 9), round(d, 12)) for t, b, e, d in rows], "threshold double, scale double, epsilon double, delta double")


@query("SELECT c_custkey AS id, round(least(greatest(c_nationkey * (1 + c_acctbal / 10000), 2), 20), 6) AS held FROM customer")
def noisy_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(noise.noisy_count(F.col("c_nationkey"), F.col("c_acctbal") / 10000, 2, 20), 6).alias("held"))


# --- encodings


@query(
    "SELECT c_custkey AS id, trunc(c_acctbal * 65536)::BIGINT AS fixed, trunc(c_acctbal * 65536)::BIGINT / 65536.0::DOUBLE AS back, upper(sha256(c_name)) AS digest, upper(hex(c_name)) AS hexed,"
    " printf('%06X%06X', c_custkey, c_nationkey::BIGINT) AS packed FROM customer"
)
def scalar_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = encoding.fixed_encode(F.col("c_acctbal"))
    packed = encoding.serialize_ints(F.array(F.col("c_custkey"), F.col("c_nationkey").cast("bigint")), 3)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        fixed.alias("fixed"),
        encoding.fixed_decode(fixed).alias("back"),
        F.hex(encoding.sha256_digest(F.col("c_name"))).alias("digest"),
        encoding.hex_encode(F.col("c_name")).alias("hexed"),
        F.hex(packed).alias("packed"),
    )


@query(
    "SELECT c_custkey AS id, c_custkey AS one, c_nationkey::BIGINT AS two, c_name AS name, printf('%02X', list_sum(list_transform(range(0, 8), lambda i: (((c_custkey >> i) & 1) << i)))::BIGINT) AS bits,"
    " substr(upper(sha256(c_name)), 41, 24) AS token FROM customer"
)
def scalar_decodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = encoding.serialize_ints(F.array(F.col("c_custkey"), F.col("c_nationkey").cast("bigint")), 3)
    back = encoding.deserialize_ints(packed, 3)
    bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit("c_custkey", i) == 1)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.get(back, F.lit(0)).alias("one"),
        F.get(back, F.lit(1)).alias("two"),
        encoding.hex_decode(encoding.hex_encode(F.col("c_name"))).cast("string").alias("name"),
        F.hex(encoding.bool_pack(bits)).alias("bits"),
        F.hex(encoding.token_truncate(encoding.sha256_digest(F.col("c_name")))).alias("token"),
    )


# --- the protocol itself, its cost, and audits' trees


@query("SELECT range AS s_row, range AS r_row, CAST(CASE WHEN range < 10 THEN 0 WHEN range < 20 THEN 1 ELSE 2 END AS INTEGER) AS match_round FROM range(30)")
def encrypted_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generated parties of 40 rows, matched as curve points under both parties' keys."""
    s, r = (generators.party(spark, 40, 30, 3, 0, side) for side in "sr")
    return protocol_match.encrypted_match(s, r, IDS, "sender", "receiver")


@query(
    f"SELECT 3 * (66 * (2 * n + 6 * {TAU}) + 12 * (n + 3 * {TAU})) AS match_bytes, 3 * (66 * (2 * n + 6 * {TAU}) + 12 * (n + 3 * {TAU})) + 512 * 2 * (2 * n + 6 * {TAU} + n) AS join_bytes, n * 8 * 54 AS compare_bytes FROM (SELECT count(*) AS n FROM customer)"
)
def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that two parties of all customers would send."""
    n = table(spark, sf_dir, "customer").count()
    row = (cost.match_bytes(n, n, 3, TAU), cost.join_bytes(n, n, 3, n, 2, TAU), cost.compare_bytes(n))
    return spark.createDataFrame([row], "match_bytes bigint, join_bytes bigint, compare_bytes bigint")


@query(
    f"WITH r AS (SELECT c_custkey AS member, row_number() OVER (ORDER BY {prf_sql(repr('umbra'), 'c_custkey')}, c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer),"
    " l AS (SELECT *, ceil(log2(n))::BIGINT AS levels FROM r), d AS (SELECT member, levels, floor(r * (1::BIGINT << levels)::DOUBLE / n)::BIGINT AS place, unnest(range(0, levels + 1)) AS depth FROM l)"
    " SELECT (1::BIGINT << depth) + (place >> (levels - depth)) AS node, CAST(depth AS INTEGER) AS depth, member FROM d"
)
def bisect_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.bisect_tree(table(spark, sf_dir, "customer"), "umbra", "c_custkey").select("node", F.col("depth").cast("int").alias("depth"), "member")


# --- sources


@query(
    "WITH p AS (SELECT range AS r, CASE WHEN range < 850 THEN 0 WHEN range < 950 THEN 1 ELSE 2 END AS c FROM range(1000)) SELECT CAST(c AS INTEGER) AS match_round, count(*) AS n FROM p GROUP BY 1"
)
def generated_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = generators.bench_parties(spark, 1000)
    return match.waterfall_match(s, r, IDS).groupBy("match_round").agg(F.count(F.lit(1)).alias("n"))


_KEY = "translate(substr(d, {0} + 1, 1), 'abcdef', '012345') || translate(substr(d, {0} + 17, 1), '0123456789', 'ghijklmnop')"


@query(
    f"SELECT id, {' || '.join(_KEY.format(i) for i in range(16))} || '@x' AS key, {prf_sql(repr('umbra'), 'id')} AS feature, 0::BIGINT AS nothing,"
    f" round(5 + {prf_sql(repr('umbra'), 'id')}::DOUBLE / {1 << 60} * 5 + 2.5, 9) AS number FROM (SELECT range AS id, sha256('umbra:' || range) AS d FROM range(500))"
)
def generated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random ids, features, zero features and doubles."""
    parts = [generators.features(spark, 500, "umbra").withColumnRenamed("value", "feature"), generators.features(spark, 500, "umbra", zero=True).withColumnRenamed("value", "nothing")]
    out = generators.keys(spark, 500, "umbra", suffix="@x")
    for p in [*parts, generators.doubles(spark, 500, 5.0, 10.0, "umbra").select("id", F.round("value", 9).alias("number"))]:
        out = out.join(p, "id")
    return out


@query(
    f"SELECT id, r < 20 AS in_x, r >= 10 AND r < 30 AS in_y, r >= 30 AS is_dummy FROM (SELECT id, row_number() OVER (ORDER BY o, id) - 1 AS r FROM (SELECT range AS id, {prf_sql(repr('umbra'), 'range')} AS o FROM range(70))) WHERE r < 35"
)
def generated_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit sets of 20 and 20 with 10 in common, and 5 dummies."""
    return generators.audit_sets(spark, 20, 20, 10, dense=2, dummies=5)


@query("SELECT side, count(*) AS n, CAST(50 AS BIGINT) AS below FROM (VALUES ('x'), ('y')) AS t(side), range(CASE side WHEN 'x' THEN 20 ELSE 15 END) GROUP BY side")
def generated_independent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = generators.independent_sets(spark, 20, 15, 50)
    both = x.select(F.lit("x").alias("side"), "id").unionByName(y.select(F.lit("y").alias("side"), "id"))
    return both.where((F.col("id") >= 0) & (F.col("id") < 50)).groupBy("side").agg(F.count_distinct("id").alias("n"), F.lit(50).cast("bigint").alias("below"))


@query(f"SELECT id_0, id_1, id_2, r_nation FROM ({RECEIVER_SQL})")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Party tables through a keyed CSV in the shared folder and back."""
    folder = shared_folder(spark) + "/keyed-csv"
    csv_tables.sink_keyed_csv(inputs.receiver(spark, sf_dir).select(*IDS, "r_nation"), folder, header=True, mode="overwrite")
    return csv_tables.scan_keyed_csv(spark, folder, IDS, ["r_nation"], header=True).select(*IDS, F.col("r_nation").cast("bigint").alias("r_nation"))


# --- audits

SET_X, SET_Y = list(range(20)), list(range(10, 30))


@query("SELECT CAST(n AS INTEGER) AS n, CAST(c AS INTEGER) AS c, CAST(calls AS INTEGER) AS calls FROM (VALUES " + ", ".join(f"(12, {c}, {k})" for c, k in enumerate([0, 4, 6, 8, 9, 10, 11, 10, 9, 8, 6, 4, 0])) + ") AS t(n, c, calls)")
def audit_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo.calls_table(spark, 12).where("n = 12")


@query()
def audit_memo_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo.memo_table(spark, 12)


@query("SELECT algo, 0::BIGINT AS beyond FROM (VALUES ('baseline'), ('improved'), ('dynamic'), ('bayes'), ('sum_tree'), ('sum_only')) AS t(algo)")
def audit_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials in which an audit says that it has found more than there is, which no sound one but the probabilistic one may; that keeps to the set's size."""
    trials = compare.leakage_trials(spark, SET_X, SET_Y, [0, 1, 2, 4, 8, 16, 30], 10)
    common, whole = len(set(SET_X) & set(SET_Y)), len(SET_X)
    sound = F.when(F.col("algo") == "bayes", F.col("members") + F.col("others") <= whole).otherwise((F.col("members") <= common) & (F.col("others") <= whole - common))
    return trials.groupBy("algo").agg(F.count_if(~sound).alias("beyond"))


@query()
def audit_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.leakage_curve(spark, SET_X, SET_Y, [0, 1, 2, 3, 4, 8, 16], 20)


@query("WITH s AS (SELECT range AS v FROM range(1, 13)) SELECT a.v AS x, b.v AS y, c.v AS z FROM s a, s b, s c WHERE a.v < b.v AND b.v < c.v AND a.v + b.v + c.v = 18")
def n_sum_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sumtree.n_sum(range(1, 13), 18, 3)
    return spark.createDataFrame([tuple(map(int, r)) for r in found], "x bigint, y bigint, z bigint")

