"""Queries of problem 4: the five rows with the highest count of every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.topn import top_n
from moraine.plans.registry import Registry
from moraine.tables import table

registry = Registry()

#: What counts as a blank at the ends of a query.
BLANKS = " \t\n\r 　"


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """search_logs with the query in its common form, without blank queries and counts that aren't positive."""
    # the count is tested here, on the column as it is stored, so that the scan can use it
    logs = table(spark, folder, "search_logs").where(F.col("count") > 0)
    return logs.withColumn("query", F.lower(F.btrim("query", F.lit(BLANKS)))).where(F.col("query") != "")


@registry.add(
    "p4_found",
    """WITH q AS (SELECT DISTINCT lower(trim(query, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))) AS query, id, "count", time_bucket
  FROM search_logs WHERE "count" > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY "count" DESC, time_bucket, id) AS place FROM q WHERE query <> '')
SELECT query, id FROM r WHERE place <= 5""",
)
def found(spark: SparkSession, folder: str) -> DataFrame:
    ties = [F.col("time_bucket").asc_nulls_last(), F.col("id").asc()]
    return top_n(counted(spark, folder), "query", "count", ties, 5, ["time_bucket", "id"]).select("query", "id")
