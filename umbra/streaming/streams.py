"""Streaming forms: the sketch as a running count, attribution as an interval join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from umbra.operators.sketch import SketchParams, build, privatize


def sketch_stream(messages: DataFrame, params: SketchParams, seed: str) -> DataFrame:
    """j, pos, cnt kept up to date over a stream of (client_id, message); state: at most k * m cells."""
    return build(privatize(messages, params, seed))


def start_sketch(messages: DataFrame, params: SketchParams, seed: str, name: str, checkpoint: str) -> StreamingQuery:
    """The running sketch as the in-memory table `name`."""
    return sketch_stream(messages, params, seed).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def attribution_stream(impressions: DataFrame, conversions: DataFrame, window: str, late: str = "1 hour") -> DataFrame:
    """Joined (id, t0, t1, value) with t0 < t1 < t0 + window; watermarks let old state go, so it stays bounded by window and lateness."""
    a = impressions.select(F.col("id").alias("a_id"), "t0").withWatermark("t0", late)
    b = conversions.select(F.col("id").alias("b_id"), "t1", "value").withWatermark("t1", late)
    inside = F.expr(f"a_id = b_id AND t1 > t0 AND t1 < t0 + INTERVAL {window}")
    return a.join(b, inside).select(F.col("a_id").alias("id"), "t0", "t1", "value")
