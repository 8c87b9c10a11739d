"""Queries of problem 3: abusive, hateful and sexual content of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.abuse import CATEGORIES, QUOTED, listed_words, sample_texts, scores, train
from moraine.plans.registry import Registry
from moraine.tables import table

registry = Registry()
#: Most unlabelled posts that training looks at.
SAMPLE = 2500
THRESHOLD = 0.5


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each post with its source and the score of each category."""
    posts = table(spark, folder, "posts")
    model = train(listed_words(table(spark, folder, "banned_words")), sample_texts(posts, "id", "content", SAMPLE))
    found = scores(posts.select(F.col("id").alias("post_id"), "source", "content"), "post_id", "content", model)
    # repeated rows of a post hold the same text
    return found.groupBy("post_id").agg(F.max("source").alias("source"), *[F.max(c).alias(c) for c in (*CATEGORIES, *QUOTED)])


def flagged(found: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])
    return found.select("post_id", "source", F.explode(F.filter(pairs, lambda x: x["score"] >= THRESHOLD)).alias("x")).select("post_id", "source", "x.*")


@registry.add("p3_found")
def found(spark: SparkSession, folder: str) -> DataFrame:
    return flagged(judged(spark, folder)).select("post_id", "category")


@registry.add("p3_scores")
def all_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The scores of every post: of what it says itself, and of what it quotes."""
    return judged(spark, folder).select("post_id", *[F.col(c).alias(c.lower()) for c in (*CATEGORIES, *QUOTED)])


@registry.add("p3_rates")
def rates(spark: SparkSession, folder: str) -> DataFrame:
    """Posts of each source, and the share that falls under each category."""
    by_source = judged(spark, folder).groupBy(F.coalesce("source", F.lit("none")).alias("source"))
    return by_source.agg(F.count("*").alias("posts"), *[F.round(F.avg((F.col(c) >= THRESHOLD).cast("int")), 6).alias(c.lower()) for c in CATEGORIES])
