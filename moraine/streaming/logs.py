"""Streams of search and click logs: hourly counts, view-count flushes, clicks joined to later dwell times.

File sources stand in for message queues: the same rows in the same form. Every query runs with
availableNow, so what is there is processed in micro-batches and the stream ends; state and output are below one folder,
and an output folder is named after its batch, so that a replayed batch overwrites it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.operators.logs import query_form
from moraine.storage import fresh_path
from moraine.streaming.cdc import ROCKSDB, _settings, written


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def run(df: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream to its end; every row it has put out, with the number of its batch."""
    spark = df.sparkSession
    path = fresh_path(spark, label)

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    with _settings(spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
        df.writeStream.outputMode(mode).foreachBatch(publish).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return written(spark, f"{path}/out", T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())]))


def hourly_counts(logs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts of every query by hour of the event, late ones within the watermark."""
    rows = logs.where(F.col("count") > 0).withColumn("query", query_form(F.col("query"))).where("query <> ''")
    rows = rows.withColumn("ts", F.col("time_bucket").cast("timestamp")).withWatermark("ts", late)
    counted = rows.groupBy(F.window("ts", "1 hour"), "query").agg(F.sum("count").alias("total"), F.count("*").alias("lines"))
    return counted.select("query", F.col("window.start").cast("timestamp_ntz").alias("bucket"), "total", "lines")


def view_deltas(clicks: DataFrame) -> DataFrame:
    """Views of every post since the last flush."""
    return clicks.groupBy("post_id").agg(F.count("*").alias("delta"))


def clicks_with_dwell(clicks: DataFrame, dwells: DataFrame, within: str = "1 hour", how: str = "inner") -> DataFrame:
    """Every click with the dwell times that its session reports for the post within an hour.

    how = "left": a click without any comes out alone, once the watermark has passed its hour.
    """
    left = clicks.where("session_id is not null").select("id", "session_id", "post_id", F.col("created_at").cast("timestamp").alias("clicked")).withWatermark("clicked", within)
    right = dwells.where("session_id is not null and dwell_time_ms >= 0").select(
        F.col("id").alias("dwell_id"), F.col("session_id").alias("s"), F.col("post_id").alias("p"), "dwell_time_ms", F.timestamp_add("MILLISECOND", F.col("dwell_time_ms").cast("int"), F.col("created_at").cast("timestamp")).alias("reported")
    ).withWatermark("reported", within)
    same = (F.col("session_id") == F.col("s")) & (F.col("post_id") == F.col("p")) & (F.col("reported") >= F.col("clicked")) & (F.col("reported") <= F.col("clicked") + F.expr(f"INTERVAL {within}"))
    return left.join(right, same, how).select("id", "dwell_id", "session_id", "post_id", "dwell_time_ms")
