"""Queries of problem 7: documents that hold passages of evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.leaks import leaks
from moraine.plans.registry import Registry
from moraine.tables import table

registry = Registry()


@registry.add("p7_found")
def found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


@registry.add("p7_suites")
def suites(spark: SparkSession, folder: str) -> DataFrame:
    """Items of each suite, and how many of them leaked into how many documents."""
    items = table(spark, folder, "eval_items")
    pairs = leaks(table(spark, folder, "documents"), items)
    leaked = items.select("item_id", "suite").join(pairs, "item_id", "left")
    return leaked.groupBy("suite").agg(F.countDistinct("item_id").alias("items"), F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("leaked"), F.countDistinct("doc_id").alias("documents"))
