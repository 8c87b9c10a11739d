"""Queries of learning to rank: features, metrics, folds, judgements and rescoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import markup, words
from moraine.operators import learning as M
from moraine.operators import search as S
from moraine.operators.stored import Index
from moraine.plans.common import POSTS, as_of, current_posts
from moraine.plans.logs import CLICKS, GRADE_SQL, clicks
from moraine.plans.registry import Registry
from moraine.storage import materialize
from moraine.operators.logs import dwell_grade
from moraine.plans.search import AGE_SQL, QUERIES, QUERY_VALUES, WORD_TERMS, _bm25, _rank_sql, _top, full_rank, index_of

registry = Registry()
SOURCE_SQL = markup.snippet_source_sql("content")
SOURCE_WORDS = words.tokens_sql(SOURCE_SQL)


#: Hits of the first pass that the model puts in a new order.
WINDOW = 200


def candidates(spark: SparkSession, folder: str, most: int = 20) -> tuple[Index, DataFrame]:
    index = index_of(spark, folder)
    return index, S.ranked(full_rank(index), most).select("qid", "id", "place")


def feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    index, pairs = candidates(spark, folder)
    return M.features(materialize(pairs.select("qid", "id"), "pairs"), index, QUERIES, WORD_TERMS, as_of())


QUERY_WORDS = "regexp_extract_all(lower(q), '[\\p{L}\\p{N}]+')"


def _share(text_words: str) -> str:
    return f"round(len(list_filter({QUERY_WORDS}, lambda w: list_contains({text_words}, w))) / CAST(len({QUERY_WORDS}) AS DOUBLE), 6)"


FEATURE_SQL = f"""WITH {POSTS}, {_rank_sql()}, {_top('fr', 20)}, {QUERY_VALUES}, {_bm25('fs', SOURCE_WORDS, 'w')},
x AS (SELECT top.qid, top.id, q, title, content, {SOURCE_SQL} AS source_text, created_at, view_count, like_count, p.category_id AS cat FROM top JOIN p USING (id) JOIN qs USING (qid)),
f AS (SELECT x.qid, x.id, round(coalesce(bt.score, 0), 6) AS bm25_title, round(coalesce(bc.score, 0), 6) AS bm25_content, round(coalesce(fs.score, 0), 6) AS bm25_snippet,
  {_share(words.tokens_sql('title'))} AS coverage_title, {_share(words.tokens_sql('source_text'))} AS coverage_snippet,
  CASE WHEN contains(lower(title), lower(q)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_title,
  CAST(len(list_filter({QUERY_WORDS}, lambda w: list_contains(regexp_split_to_array(lower(array_to_string({markup.tags_sql('content')}, ' ')), '\\s+'), w))) AS DOUBLE) AS tag_overlap,
  CAST(len({words.tokens_sql('title')}) AS DOUBLE) AS title_length, round(ln(1 + coalesce(length(source_text), 0)), 6) AS content_length,
  CAST(floor({AGE_SQL}) AS DOUBLE) AS freshness_days, round(ln(1 + coalesce(view_count, 0)), 6) AS view_count, round(ln(1 + coalesce(like_count, 0)), 6) AS like_count,
  CAST(coalesce(cat, 0) AS DOUBLE) AS category_id, CAST(len({QUERY_WORDS}) AS DOUBLE) AS query_length
  FROM x LEFT JOIN bt ON bt.qid = x.qid AND bt.id = x.id LEFT JOIN bc ON bc.qid = x.qid AND bc.id = x.id LEFT JOIN fs ON fs.qid = x.qid AND fs.id = x.id)"""


@registry.add("ltr_features", f"{FEATURE_SQL} SELECT * FROM f")
def ltr_features(spark: SparkSession, folder: str) -> DataFrame:
    return feature_rows(spark, folder)


@registry.add("term_coverage", f"{FEATURE_SQL} SELECT qid, id, coverage_title, coverage_snippet FROM f")
def term_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return feature_rows(spark, folder).select("qid", "id", "coverage_title", "coverage_snippet")


@registry.add("tag_overlap", f"WITH {POSTS}, w(word) AS (VALUES ('notes'), ('이야기'), ('choir'), ('정리')) SELECT id, CAST((SELECT count(*) FROM w WHERE list_contains(regexp_split_to_array(lower(array_to_string({markup.tags_sql('content')}, ' ')), '\\s+'), word)) AS INT) AS shared FROM p")
def tag_overlap(spark: SparkSession, folder: str) -> DataFrame:
    asked = F.array(*[F.lit(w) for w in ("notes", "이야기", "choir", "정리")])
    return current_posts(spark, folder, "content").select("id", M.overlap(asked, markup.tags(F.col("content"))).alias("shared"))


@registry.add("ltr_resume_antijoin", f"WITH {POSTS}, {_rank_sql()}, {_top('fr', 20)} SELECT qid, id FROM top WHERE NOT (qid IN (1, 2) AND id % 2 = 0)")
def ltr_resume_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs still to be judged: without those that an earlier run has written."""
    _, pairs = candidates(spark, folder)
    done = pairs.where("qid in (1, 2) and id % 2 = 0").select("qid", "id")
    return pairs.select("qid", "id").join(done, ["qid", "id"], "left_anti")


GRADED = f"{CLICKS}, g AS (SELECT query, id, click_position, {GRADE_SQL} AS rel FROM c WHERE {GRADE_SQL} IS NOT NULL)"
NDCG_SQL = """n AS (SELECT query, sum(CASE WHEN got <= 10 THEN (power(2, rel) - 1) / log2(got + 1) END) / nullif(sum(CASE WHEN ideal <= 10 THEN (power(2, rel) - 1) / log2(ideal + 1) END), 0) AS ndcg
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY click_position, id) AS got, row_number() OVER (PARTITION BY query ORDER BY rel DESC, id) AS ideal FROM g) GROUP BY query)"""


def graded(spark: SparkSession, folder: str) -> DataFrame:
    rows = clicks(spark, folder).select("query", "id", "click_position", dwell_grade(F.col("dwell_time_ms"), F.col("click_position")).alias("rel"))
    return rows.where("rel is not null").withColumn("score", -F.col("click_position"))


@registry.add("ndcg_at_10", f"WITH {GRADED}, {NDCG_SQL} SELECT query, round(ndcg, 6) AS ndcg FROM n WHERE ndcg IS NOT NULL")
def ndcg_at_10(spark: SparkSession, folder: str) -> DataFrame:
    """How well the places shown agree with the grades of the clicks."""
    return M.ndcg(graded(spark, folder), "query", "score", "rel", "id").select("query", F.round("ndcg", 6).alias("ndcg"))


@registry.add("ltr_fold_stats", f"WITH {GRADED}, {NDCG_SQL}, fo AS (SELECT length(query) % 5 AS fold, avg(ndcg) AS m FROM n WHERE ndcg IS NOT NULL GROUP BY 1) SELECT count(*) AS folds, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM fo")
def ltr_fold_stats(spark: SparkSession, folder: str) -> DataFrame:
    scores = M.ndcg(graded(spark, folder), "query", "score", "rel", "id")
    folds = scores.groupBy((F.length("query") % 5).alias("fold")).agg(F.avg("ndcg").alias("m"))
    return folds.agg(F.count("*").alias("folds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"))


@registry.add("ltr_group_sizes", f"WITH {GRADED} SELECT rel, count(*) AS rows, count(DISTINCT query) AS queries FROM g GROUP BY rel")
def ltr_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return graded(spark, folder).groupBy("rel").agg(F.count("*").alias("rows"), F.countDistinct("query").alias("queries"))


@registry.add("ltr_judge_average", f"WITH {CLICKS}, r AS (SELECT query, post_id, coalesce({GRADE_SQL}, -1) AS score FROM c) SELECT query, post_id, CAST(floor(avg(score) FILTER (WHERE score >= 0) + 0.5) AS BIGINT) AS grade FROM r GROUP BY query, post_id")
def ltr_judge_average(spark: SparkSession, folder: str) -> DataFrame:
    """The rounded mean of the grades given to a pair, failed rounds left out."""
    rows = clicks(spark, folder).select("query", "post_id", F.coalesce(dwell_grade(F.col("dwell_time_ms"), F.col("click_position")), F.lit(-1)).alias("s"))
    return rows.groupBy("query", "post_id").agg(F.floor(F.avg(F.when(F.col("s") >= 0, F.col("s"))) + 0.5).alias("grade"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """The first-pass window of every query with features, place and title relevance."""
    index, pairs = candidates(spark, folder, WINDOW)
    pairs = materialize(pairs, "pairs")
    asked = F.broadcast(spark.createDataFrame([(q, t.split()) for q, t in QUERIES.items()], "qid int, asked array<string>"))
    share = F.size(F.filter("asked", lambda w: F.contains("title", w))) / F.size("asked")
    rel = F.coalesce(F.round(share * 3), F.lit(0.0)).alias("rel")
    rows = M.features(pairs.select("qid", "id"), index, QUERIES, WORD_TERMS, as_of())
    rows = rows.join(index.docs().select("id", "title").join(F.broadcast(pairs), "id").join(asked, "qid").select("qid", "id", "place", rel), ["qid", "id"])
    return materialize(rows, "features")  # the trainer passes over its rows again and again


@registry.add("ltr_rescore")
def ltr_rescore(spark: SparkSession, folder: str) -> DataFrame:
    """The first-pass window of every query in the order of a boosted ranker trained on title relevance."""
    rows = labelled(spark, folder)
    return M.rescored(M.fit_ranker(rows), rows).select("qid", "id", "place", "new_place")


@registry.add("ltr_rescore_gain")
def ltr_rescore_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Mean gain of the first pass and of models that haven't seen the query, over the same windows; deviation between the folds."""
    rows = M.held_out(labelled(spark, folder)).select("qid", "fold", "id", "rel", (-F.col("place")).alias("first"), (-F.col("new_place")).alias("second"))
    rows = materialize(rows, "gain")
    both = M.ndcg(rows, "qid", "first", "rel", "id").withColumnRenamed("ndcg", "a").join(M.ndcg(rows, "qid", "second", "rel", "id").withColumnRenamed("ndcg", "b"), "qid")
    folds = both.join(rows.select("qid", "fold").distinct(), "qid").groupBy("fold").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    mean = lambda c: F.round(F.sum(c) / F.sum("n"), 4)
    return folds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("queries"), mean("a").alias("first_pass"), mean("b").alias("model"), F.count("*").alias("folds"), F.round(F.stddev_pop(F.col("b") / F.col("n")), 4).alias("deviation"))


@registry.add("ltr_importance")
def ltr_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Features by what they contribute to the boosted ranker."""
    # the trainer passes over its rows again and again
    rows = materialize(feature_rows(spark, folder), "features").withColumn("rel", F.round(F.col("coverage_title") * 3))
    gains = M.fit_ranker(rows).stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(M.FEATURES, gains)), "feature string, gain double").orderBy(F.col("gain").desc(), "feature")
