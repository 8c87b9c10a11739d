"""Learning to rank: the fourteen features of a query and a post, gain metrics, folds and a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.functions import words
from moraine.operators import search as S
from moraine.operators.stored import Index

FEATURES = (
    "bm25_title", "bm25_content", "bm25_snippet", "coverage_title", "coverage_snippet", "exact_title", "tag_overlap",
    "title_length", "content_length", "freshness_days", "view_count", "like_count", "category_id", "query_length",
)


def coverage(query_words: Column, text_words: Column) -> Column:
    """Share of the query's words that the text holds."""
    return F.coalesce(F.try_divide(F.size(F.filter(query_words, lambda w: F.array_contains(text_words, w))).cast("double"), F.size(query_words)), F.lit(0.0))


def overlap(query_words: Column, tags: Column) -> Column:
    """How many of the query's words are among the words of the tags."""
    tag_words = F.split(F.lower(F.array_join(tags, " ")), r"\s+")
    return F.size(F.filter(query_words, lambda w: F.array_contains(tag_words, w)))


def features(pairs: DataFrame, index: Index, queries: dict[int, str], terms: S.Terms, now: Column) -> DataFrame:
    """The features of the pairs (qid, id) from an index with the fields title, content and snippet; pairs are the best of each query, so they are broadcast."""
    spark = pairs.sparkSession
    title, source = F.col("title"), F.col("source_text")
    asked = F.broadcast(spark.createDataFrame([(q, t, S.words_of_query(t)) for q, t in queries.items()], "qid int, query string, query_words array<string>"))
    names = ("bm25_title", "bm25_content", "bm25_snippet")
    pairs = F.broadcast(pairs)
    scores = index.scored({n: [(n.split("_")[1], terms)] for n in names}).join(pairs, ["qid", "id"], "left_semi")
    out = index.docs().join(pairs, "id").join(asked, "qid").join(scores, ["qid", "id"], "left")
    q = F.col("query_words")
    return out.select(
        "qid",
        "id",
        *[F.round(F.coalesce(n, F.lit(0.0)), 6).alias(n) for n in names],
        F.round(coverage(q, words.tokens(title)), 6).alias("coverage_title"),
        F.round(coverage(q, words.tokens(source)), 6).alias("coverage_snippet"),
        F.coalesce(F.contains(F.lower(title), F.lower("query")).cast("double"), F.lit(0.0)).alias("exact_title"),
        overlap(q, F.col("tags")).cast("double").alias("tag_overlap"),
        F.size(words.tokens(title)).cast("double").alias("title_length"),
        F.round(F.log1p(F.coalesce(F.length(source), F.lit(0))), 6).alias("content_length"),
        F.floor(S.age_days(F.col("created_at"), now)).cast("double").alias("freshness_days"),
        F.round(F.log1p(F.coalesce("view_count", F.lit(0))), 6).alias("view_count"),
        F.round(F.log1p(F.coalesce("like_count", F.lit(0))), 6).alias("like_count"),
        F.coalesce("category_id", F.lit(0)).cast("double").alias("category_id"),
        F.size(q).cast("double").alias("query_length"),
    )


def ndcg(judged: DataFrame, group: str, score: str, rel: str, tie: str, k: int = 10) -> DataFrame:
    """Discounted gain of the first k by score against the first k by relevance; groups without gain are left out."""
    by_score = Window.partitionBy(group).orderBy(F.col(score).desc(), tie)
    by_rel = Window.partitionBy(group).orderBy(F.col(rel).desc(), tie)
    gain = F.pow(F.lit(2.0), rel) - 1

    def total(place: str) -> Column:
        return F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1)))

    at = judged.withColumn("got", F.row_number().over(by_score)).withColumn("ideal", F.row_number().over(by_rel))
    return at.groupBy(group).agg(total("got").alias("dcg"), total("ideal").alias("idcg")).where("idcg > 0").select(group, (F.col("dcg") / F.col("idcg")).alias("ndcg"))


def fit_ranker(rows: DataFrame, label: str = "rel", trees: int = 100, depth: int = 3):
    """A pointwise gradient-boosted ranker over the features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    return Pipeline(stages=[vector, GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.05, seed=7)]).fit(rows)


def rescored(model, rows: DataFrame, first_pass: str = "place") -> DataFrame:
    """The first-pass rows in the order of the model; ties and rows without a prediction keep the first order."""
    order = Window.partitionBy("qid").orderBy(F.col("prediction").desc_nulls_last(), first_pass)
    return model.transform(rows).withColumn("new_place", F.row_number().over(order))


def held_out(rows: DataFrame, folds: int = 5, label: str = "rel", trees: int = 100) -> DataFrame:
    """The rows with their fold (by the hash of the query), in the order of a model fitted on all other folds.

    A query never ranks by a model that has seen it. With fewer than two folds there is nothing to hold out: no rows.
    """
    rows = rows.withColumn("fold", F.pmod(F.hash("qid"), F.lit(folds)))
    there = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    if len(there) < 2:
        return rows.where("false").withColumn("new_place", F.lit(None).cast("int"))
    parts = [rescored(fit_ranker(rows.where(F.col("fold") != k), label, trees), rows.where(F.col("fold") == k)).drop("features", "prediction") for k in there]
    return reduce(DataFrame.unionByName, parts)
