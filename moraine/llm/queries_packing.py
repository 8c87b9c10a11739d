"""Queries of problem 6: documents packed into containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.packing import pack
from moraine.llm.tokens import DEFAULT
from moraine.plans.registry import Registry
from moraine.tables import table

registry = Registry()
CAPACITY = 2048


@registry.add("p6_containers")
def containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), "doc_id", "text", DEFAULT, CAPACITY)


@registry.add("p6_fill")
def fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens, unused share, and the fewest containers that the tokens could need."""
    by_container = containers(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return by_container.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest")).select(
        "containers", "tokens", "fullest", F.ceil(F.col("tokens") / CAPACITY).alias("fewest"), F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("unused")
    )
