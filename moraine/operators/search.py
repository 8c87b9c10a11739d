"""Scoring a batch of queries: BM25 by field, dis-max, popularity and recency, paging and facets.

A batch is a list of (qid, term, boost); it is broadcast, as its size is that of the queries asked.
Only postings of its terms leave the scan, so no shuffle carries the index.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.operators.index import field_stats, hits

K1, B = 1.2, 0.75
#: Most terms that are sent to the tasks at once; larger batches are searched in parts.
MOST_TERMS = 10_000
Terms = list[tuple[int, str, float]]


def words_of_query(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def grams_of_query(text: str, least: int = 2, most: int = 3) -> list[str]:
    return [w[i : i + n] for w in words_of_query(text) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def escape_query(text: str | None) -> str | None:
    """Query syntax characters escaped outside quoted phrases; an unclosed quote is escaped to the end."""
    if text is None:
        return None
    out, at = [], 0
    for m in re.finditer(r'"[^"]*"', text):
        out += [re.sub(r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\\1", text[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, re.sub(r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\\1", text[at:])])


def terms_frame(spark: SparkSession, terms: Terms) -> DataFrame:
    """The terms as a table; bm25 and the stored index ask for at most MOST_TERMS at once."""
    return F.broadcast(spark.createDataFrame(terms, "qid int, term string, boost double"))


def weight() -> Column:
    """What one posting adds to a score: from its tf and dl, the df of its term, n and avgdl of its field, and the boost."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.col("boost") * idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def bm25(words: DataFrame, terms: Terms) -> DataFrame:
    """qid, id, score of every document that holds a term."""
    spark = words.sparkSession
    if len(terms) > MOST_TERMS:
        parts = [bm25(words, terms[i : i + MOST_TERMS]) for i in range(0, len(terms), MOST_TERMS)]
        return reduce(DataFrame.unionByName, parts).groupBy("qid", "id").agg(F.sum("score").alias("score"))
    found = hits(words, sorted({t for _, t, _ in terms}))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    # df has at most MOST_TERMS rows, the statistics one
    joined = found.join(F.broadcast(df), "term").join(terms_frame(spark, terms), "term").crossJoin(F.broadcast(field_stats(words)))
    return joined.groupBy("qid", "id").agg(F.sum(weight()).alias("score"))


def best_of(text: Column, gram: Column, boost: float = 2.0, tie: float = 0.1) -> Column:
    """The higher of two scores and a share of the lower; a missing one is 0."""
    a, b = F.coalesce(text, F.lit(0.0)), F.coalesce(gram, F.lit(0.0)) * boost
    return F.greatest(a, b) + tie * F.least(a, b)


def dis_max(text: DataFrame, grams: DataFrame, boost: float = 2.0, tie: float = 0.1) -> DataFrame:
    """qid, id, score of documents that stand in either table."""
    both = text.withColumnRenamed("score", "text").join(grams.withColumnRenamed("score", "gram"), ["qid", "id"], "full")
    return both.select("qid", "id", best_of(F.col("text"), F.col("gram"), boost, tie).alias("score"))


def saturation(count: Column, weight: float, pivot: float) -> Column:
    x = F.greatest(count, F.lit(1))
    return weight * x / (x + pivot)


def recency(age_days: Column, weight: float = 5.0, half_life: float = 30.0) -> Column:
    return weight * F.exp(-math.log(2) / half_life * F.greatest(age_days, F.lit(0.0)))


def age_days(created: Column, now: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", created, now) / 86_400_000_000.0


def ranked(scored: DataFrame, most: int) -> DataFrame:
    """The `most` best of every query by rounded score, then id, with their place from 1."""
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("score", F.round("score", 6)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def page(scored: DataFrame, offset: int, limit: int, last_page: int = 15) -> DataFrame:
    """One page of every query, and whether another follows."""
    if offset // limit > last_page:
        raise ValueError(f"pages beyond {last_page} are not served")
    rows = ranked(scored, offset + limit + 1)
    more = F.max("place").over(Window.partitionBy("qid")) > offset + limit
    return rows.withColumn("has_next", more).where(F.col("place").between(offset + 1, offset + limit))
