"""Party tables, impressions, messages and audit sets out of the test tables; the select lists serve Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDS = ["id_0", "id_1", "id_2"]


def _ids(side: str, shift: int, known: str) -> list[str]:
    """Three id columns: shared text where a rule of the key says that both parties know the id, private text elsewhere.

    The receiver's second id belongs to the next customer, so that rounds disagree about which rows belong together. Rows
    outside `known` have private ids alone.
    """
    rules = ["c_custkey % 10 < 6", f"(c_custkey + {shift}) % 4 = 0 OR (c_custkey + {shift}) % 10 = 7", "c_custkey % 2 = 1"]
    shifts = [0, shift, 0]
    return [
        f"CASE WHEN {known} AND ({r}) THEN 'i{i}_' || CAST(c_custkey + {d} AS STRING) ELSE '{side}{i}_' || CAST(c_custkey AS STRING) END AS id_{i}"
        for i, (r, d) in enumerate(zip(rules, shifts, strict=True))
    ]


SENDER = ["c_custkey AS row_id", *_ids("s", 0, "c_custkey % 5 <> 0"), "CAST(round(c_acctbal * 100) AS BIGINT) AS s_cents"]
RECEIVER = ["c_custkey AS row_id", *_ids("r", 1, "c_custkey % 3 <> 0"), "CAST(c_nationkey AS BIGINT) AS r_nation"]
SENDER_SQL = f"SELECT {', '.join(SENDER)} FROM customer"
RECEIVER_SQL = f"SELECT {', '.join(RECEIVER)} FROM customer"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*SENDER)


def receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*RECEIVER)


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t0: seconds of each user's first click."""
    first = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg(F.min("ts").alias("ts"))
    return first.selectExpr("user_id", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS t0")


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t1, value: each user's first purchase (of ties the least event_id)."""
    first = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "value")).alias("x"))
    return first.selectExpr("user_id", "unix_micros(CAST(x.ts AS TIMESTAMP)) / 1e6 AS t1", "x.value AS value")


TOUCH_SQL = """
a AS (SELECT user_id, epoch_us(min(ts)) / 1e6 AS t0 FROM events WHERE event_type = 'click' GROUP BY user_id),
b AS (SELECT user_id, epoch_us(ts) / 1e6 AS t1, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1),
j AS (SELECT a.user_id, t0, t1, value FROM a JOIN b USING (user_id))"""
