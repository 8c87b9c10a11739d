"""The inverted index: words of documents, postings and the statistics that scoring needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_words(docs: DataFrame, words: Column) -> DataFrame:
    """doc id and the analysed words of one field."""
    return docs.select("id", words.alias("ws"))


def field_stats(words: DataFrame) -> DataFrame:
    """One row: documents with the field, and their mean length."""
    return words.where(F.size("ws") > 0).agg(F.count("*").alias("n"), F.avg(F.size("ws")).alias("avgdl"))


def postings(words: DataFrame) -> DataFrame:
    """term, id, tf, dl for every word of every document; combined on the map side."""
    return words.select("id", F.size("ws").alias("dl"), F.explode("ws").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def hits(words: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the given terms only; all other words go before anything is shuffled."""
    kept = F.explode(F.filter("ws", lambda w: w.isin(terms))).alias("term")
    return words.select("id", F.size("ws").alias("dl"), kept).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
