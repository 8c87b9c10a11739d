"""Queries of problem 2: the language of every post and of its segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.langid import LANGUAGES, label, labelled_sample, segments, train
from moraine.plans.registry import Registry
from moraine.tables import table

registry = Registry()
#: Most rows of each language that the models are trained on.
SAMPLE = 200


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each post, by its latest version: named language (null, other or a code) and segments."""
    posts = table(spark, folder, "posts")
    tables = train(labelled_sample(posts, "content", "lang", "id", SAMPLE))
    found = segments(posts.select("id", "content", label(F.col("lang")).alias("named"), "updated_at", "view_count"), "id", "content", tables)
    # repeated rows hold the same text; the last version's label counts
    version = F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.coalesce("view_count", F.lit(-1)), "named", "segments")
    return found.groupBy("id").agg(F.max(version).alias("v")).select("id", "v.named", "v.segments")


@registry.add("p2_found")
def found(spark: SparkSession, folder: str) -> DataFrame:
    counts = F.col("named").isNull() | (F.size("segments") > 1) | (F.col("named") != F.col("segments")[0]["lang"])
    parts = judged(spark, folder).where(counts).select(F.col("id").alias("post_id"), F.posexplode("segments").alias("at", "segment"))
    return parts.where(F.col("segment.lang").isin(*LANGUAGES)).select("post_id", (F.col("at") + 1).cast("int").alias("seg_no"), "segment.lang")


@registry.add("p2_segments")
def all_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every post with its confidence."""
    return judged(spark, folder).select(F.col("id").alias("post_id"), "named", F.posexplode("segments").alias("at", "segment")).select("post_id", "named", (F.col("at") + 1).cast("int").alias("seg_no"), "segment.*")
