"""Search, click and view logs: buckets, top queries, prefix suggestions, retention, counters, dwell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import korean

BLANKS = " \t\n\r"


def query_form(query: Column) -> Column:
    """A logged query in the form that is counted."""
    return F.lower(F.btrim(query, F.lit(BLANKS)))


def deliveries(logs: DataFrame) -> DataFrame:
    """Log rows that count: a query, a positive count, each id once (repeated rows are equal in all columns)."""
    kept = logs.where(F.col("count") > 0).withColumn("query", query_form(F.col("query"))).where("query <> ''")
    return kept.select("id", "query", "time_bucket", "count").distinct()


def hourly(logs: DataFrame) -> DataFrame:
    return logs.groupBy("query", F.date_trunc("hour", "time_bucket").cast("timestamp_ntz").alias("bucket")).agg(F.sum("count").alias("total"))


def top_queries(logs: DataFrame, since: Column, most: int) -> DataFrame:
    totals = logs.where(F.col("time_bucket") >= since).groupBy("query").agg(F.sum("count").alias("total"), F.max("time_bucket").alias("last_bucket"))
    return totals.orderBy(F.col("total").desc(), "query").limit(most)


def prefixes(query: Column, longest: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.least(F.length(query), F.lit(longest))), lambda n: F.substring(query, F.lit(1), n))


def prefix_top(totals: DataFrame, longest: int = 10, most: int = 10) -> DataFrame:
    """For every prefix of a query, of its letters and of its initials the queries most often asked.

    A query counts once for a prefix. Each task keeps `most` of a prefix before the shuffle.
    """
    q = F.col("query")
    initials = korean.initials(q)
    families = F.concat(prefixes(q, longest), prefixes(korean.decompose(q), longest), F.when(F.length(initials) >= 2, prefixes(initials, longest)).otherwise(F.array().cast("array<string>")))
    rows = totals.select("query", "total", F.explode(F.array_distinct(families)).alias("prefix"))
    order = Window.partitionBy("prefix").orderBy(F.col("total").desc(), "query")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def latest_click(clicks: DataFrame) -> DataFrame:
    """The newest click of every session on a post, the one a dwell time is written to."""
    row = F.struct("created_at", "id", "query", "click_position", "dwell_time_ms")
    return clicks.where("session_id is not null").groupBy("session_id", "post_id").agg(F.max(row).alias("c")).select("session_id", "post_id", "c.*")


def dwell_grade(dwell_ms: Column, position: Column) -> Column:
    """3 above two minutes, 2 from 30 s, 1 from 10 s, 0 below; without dwell 0 in the first four places, else none."""
    s = dwell_ms / 1000.0
    return F.when((dwell_ms.isNull() | (dwell_ms < 0)) & (position <= 3), 0).when(dwell_ms.isNull() | (dwell_ms < 0), None).when(s > 120, 3).when(s >= 30, 2).when(s >= 10, 1).otherwise(0)


def rate_limited(events: DataFrame, key: str, ts: str, tie: str, per_minute: int = 10) -> DataFrame:
    """The events that a fixed window of a minute lets through for each key."""
    order = Window.partitionBy(key, F.date_trunc("minute", ts)).orderBy(ts, tie)
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_minute)
