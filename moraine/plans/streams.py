"""Queries whose rows come from streams; their SQL is the batch result that a stream must reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.plans.common import HEADS, current_posts
from moraine.plans.registry import Registry
from moraine.streaming import logs as Z
from moraine.tables import table

registry = Registry()


@registry.add("stream_search_buckets", """SELECT lower(trim(query, ' ' || chr(9) || chr(10) || chr(13))) AS query, date_trunc('hour', time_bucket) AS bucket, CAST(sum("count") AS BIGINT) AS total, count(*) AS lines FROM search_logs WHERE "count" > 0 AND trim(query, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1, 2""")
def stream_search_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as they are delivered, repeats included; the last state of every bucket."""
    out = Z.run(Z.hourly_counts(Z.stream(spark, folder, "search_logs")), "update", "buckets")
    return out.groupBy("query", "bucket").agg(F.max(F.struct("batch", "total", "lines")).alias("v")).select("query", "bucket", "v.total", "v.lines")


@registry.add("stream_view_flush", f"WITH {HEADS}, d AS (SELECT post_id, count(*) AS delta FROM click_logs GROUP BY post_id) SELECT p.id, view_count + coalesce(delta, 0) AS view_count FROM p LEFT JOIN d ON p.id = d.post_id")
def stream_view_flush(spark: SparkSession, folder: str) -> DataFrame:
    """View counts after all flushes of the click stream."""
    out = Z.run(Z.view_deltas(Z.stream(spark, folder, "click_logs")), "update", "views")
    last = out.groupBy(F.col("post_id").alias("id")).agg(F.max(F.struct("batch", "delta")).alias("v"))
    return current_posts(spark, folder, "view_count").join(last, "id", "left").select("id", (F.col("view_count") + F.coalesce("v.delta", F.lit(0))).alias("view_count"))


@registry.add("stream_click_dwell", """WITH c AS (SELECT * FROM click_logs WHERE session_id IS NOT NULL), d AS (SELECT id, session_id, post_id, dwell_time_ms, created_at + to_milliseconds(dwell_time_ms) AS reported FROM c WHERE dwell_time_ms >= 0)
SELECT c.id, d.id AS dwell_id, c.session_id, c.post_id, d.dwell_time_ms FROM c JOIN d ON c.session_id = d.session_id AND c.post_id = d.post_id AND reported >= c.created_at AND reported <= c.created_at + INTERVAL 1 HOUR""")
def stream_click_dwell(spark: SparkSession, folder: str) -> DataFrame:
    clicks = Z.stream(spark, folder, "click_logs")
    return Z.run(Z.clicks_with_dwell(clicks, Z.stream(spark, folder, "click_logs")), "append", "dwell").drop("batch")


@registry.add(
    "stream_click_dwell_left",
    """WITH c AS (SELECT * FROM click_logs WHERE session_id IS NOT NULL), d AS (SELECT id, session_id, post_id, dwell_time_ms, created_at + to_milliseconds(dwell_time_ms) AS reported FROM c WHERE dwell_time_ms >= 0)
SELECT c.id, d.id AS dwell_id, c.session_id, c.post_id, d.dwell_time_ms FROM c LEFT JOIN d ON c.session_id = d.session_id AND c.post_id = d.post_id AND reported >= c.created_at AND reported <= c.created_at + INTERVAL 1 HOUR""",
)
def stream_click_dwell_left(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the clicks that get no dwell time: those the watermark has passed come from the stream, those whose hour is still open stand as they are."""
    clicks = Z.stream(spark, folder, "click_logs")
    out = Z.run(Z.clicks_with_dwell(clicks, Z.stream(spark, folder, "click_logs"), how="left"), "append", "dwell").drop("batch")
    none = lambda name: F.lit(None).cast("bigint").alias(name)
    still = table(spark, folder, "click_logs").where("session_id is not null").join(out.select("id"), "id", "left_anti")
    return out.unionByName(still.select("id", none("dwell_id"), "session_id", "post_id", none("dwell_time_ms")))


@registry.add("stream_click_sink", "SELECT id, query, post_id, click_position FROM click_logs")
def stream_click_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks as JSON messages keyed by post, written by a stream and read back."""
    clicks = Z.stream(spark, folder, "click_logs")
    message = F.to_json(F.struct("id", "query", "post_id", "click_position"))
    out = Z.run(clicks.select(F.col("post_id").cast("string").alias("key"), message.alias("value")), "append", "clicks")
    return out.select(F.from_json("value", "id BIGINT, query STRING, post_id BIGINT, click_position SMALLINT").alias("m")).select("m.*")
