"""Discovery of unknown values: messages travel in nested envelopes with a digest; digests seen often enough are opened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.encoding import sha256_digest
from umbra.functions.prf import prf60
from umbra.operators.noise import laplace_noise, stability_parameters


def enclose(messages: DataFrame, server_key: str, analyst_key: str) -> DataFrame:
    """client_id, digest, envelope: the message sealed for the analyst (AES-GCM), and that once more for the server that groups."""
    inner = F.aes_encrypt("message", F.lit(analyst_key), F.lit("GCM"))
    return messages.where(F.col("message").isNotNull()).select("client_id", sha256_digest(F.col("message")).alias("digest"), F.aes_encrypt(inner, F.lit(server_key), F.lit("GCM")).alias("envelope"))


def enclose_counted(messages: DataFrame, server_key: str, analyst_key: str) -> DataFrame:
    """digest, cnt, envelope of each value: what enclose() and digest_group() give, but counted before anything is hashed or sealed."""
    counted = messages.where(F.col("message").isNotNull()).groupBy("message").agg(F.count(F.lit(1)).alias("cnt"))
    return enclose(counted.withColumnRenamed("cnt", "client_id"), server_key, analyst_key).withColumnRenamed("client_id", "cnt").select("digest", "cnt", "envelope")


def digest_group(envelopes: DataFrame, seed: str) -> DataFrame:
    """digest, cnt and one envelope picked by random rank; only a count and one envelope of a group ever meet."""
    order = prf60(seed, "pick", F.col("client_id"))
    return envelopes.groupBy("digest").agg(F.count(F.lit(1)).alias("cnt"), F.max_by("envelope", F.struct(order.alias("o"), F.col("client_id"))).alias("envelope"))


def stability_release(groups: DataFrame, epsilon: float, delta: float, seed: str) -> DataFrame:
    """Groups whose noisy count reaches the threshold."""
    threshold, scale = stability_parameters(epsilon, delta)
    return groups.where(F.col("cnt") + laplace_noise(scale, seed, "release", F.hex("digest")) >= threshold)


def open_outer(groups: DataFrame, server_key: str) -> DataFrame:
    """groups with the server's layer taken off; the message stays sealed."""
    return groups.withColumn("envelope", F.aes_decrypt("envelope", F.lit(server_key), F.lit("GCM")))


def open_envelopes(groups: DataFrame, analyst_key: str) -> DataFrame:
    return groups.select(F.aes_decrypt("envelope", F.lit(analyst_key), F.lit("GCM")).cast("string").alias("message"))


def discover(messages: DataFrame, epsilon: float, delta: float, seed: str, server_key: str, analyst_key: str) -> DataFrame:
    """The released names alone."""
    released = stability_release(enclose_counted(messages, server_key, analyst_key), epsilon, delta, seed)
    return open_envelopes(open_outer(released, server_key), analyst_key)
