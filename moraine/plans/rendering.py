"""Queries of wiki text rendered to HTML; they have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import markup, render
from moraine.plans.common import current_posts
from moraine.plans.registry import Registry

registry = Registry()


@registry.add("render_mediawiki")
def render_mediawiki(spark: SparkSession, folder: str) -> DataFrame:
    return current_posts(spark, folder, "content").select("id", render.media_html(F.col("content")).alias("page")).select("id", "page.*")


@registry.add("render_namu")
def render_namu(spark: SparkSession, folder: str) -> DataFrame:
    return current_posts(spark, folder, "content").select("id", render.namu_html(F.col("content")).alias("page")).select("id", "page.*")


@registry.add("render_any")
def render_any(spark: SparkSession, folder: str) -> DataFrame:
    """Every post by the renderer of its dialect; plain texts stay in the engine."""
    posts = current_posts(spark, folder, "content").withColumn("format", markup.wiki_format(F.col("content")))
    of = lambda name: F.when(F.col("format") == name, F.col("content"))
    # one pass: a renderer gets nothing for the texts of another dialect
    media, namu = render.media_html(of("mediawiki"))["html"], render.namu_html(of("namumark"))["html"]
    html = F.when(F.col("format") == "plain", markup.plain_html(F.col("content"))).when(F.col("format") == "mediawiki", media).when(F.col("format") == "namumark", namu)
    return posts.select("id", "format", html.alias("html"))
