"""Queries of problem 5: the subjects of every post and their share of the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.topics import labelled_sample, subjects_of, train
from moraine.plans.registry import Registry
from moraine.tables import table

registry = Registry()
#: Most posts of each subject that the classifiers are trained on.
SAMPLE = 250
#: A subject counts if more than this share of the sentences deal with it.
SHARE = 0.25


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """post_id, category_id and share for every subject of which a sentence of a post treats."""
    posts = table(spark, folder, "posts")
    subjects = {r["id"]: r["name"] for r in table(spark, folder, "categories").where("parent_id is not null").collect()}
    model = train(labelled_sample(posts, subjects, SAMPLE))
    found = subjects_of(posts.select(F.col("id").alias("post_id"), "content"), "post_id", "content", model)
    # repeated rows of a post hold the same text
    return found.select("post_id", F.explode("subjects").alias("s")).select("post_id", "s.*").groupBy("post_id", "category_id").agg(F.max("share").alias("share"))


@registry.add("p5_found")
def found(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).where(F.col("share") > SHARE).select("post_id", "category_id")


@registry.add("p5_composition")
def composition(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of each subject, and their share of all posts."""
    posts = table(spark, folder, "posts").agg(F.countDistinct("id").alias("all_posts"))
    counted = found(spark, folder).groupBy("category_id").agg(F.count("*").alias("posts"))
    return counted.crossJoin(F.broadcast(posts)).select("category_id", "posts", F.round(F.col("posts") / F.col("all_posts"), 6).alias("share"))
