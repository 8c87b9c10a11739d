"""Readers of wiki dumps, line files, word lists and tables, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions.words import title_parts

PAGE = "id BIGINT, title STRING, ns INT, redirect STRING, revision ARRAY<STRUCT<id: BIGINT, timestamp: STRING, text: STRING>>"
WIKI = "namespace INT, title STRING, text STRING"
REDIRECT = r"(?i)#(?:redirect|넘겨주기)\s+(.+)"
LINKED_REDIRECT = r"(?i)#(?:넘겨주기|REDIRECT)\s*\[\[(.+?)\]\]"


def mediawiki(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump that have id, title and namespace: time of the first revision, text of the last."""
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE).load(path)
    text = F.element_at("revision", -1)["text"]
    target = F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), LINKED_REDIRECT, 1)), F.lit(""))
    return pages.where("id is not null and title is not null and ns is not null").select(
        "id", "title", F.col("ns").alias("namespace"), text.alias("content"), target.alias("redirect_to"), F.to_timestamp(F.element_at("revision", 1)["timestamp"]).alias("created_at")
    )


def wiki_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Articles of a JSON array (or of its elements as lines, which is how a large one is read in parallel)."""
    rows = spark.read.schema(WIKI).option("multiLine", multi_line).json(path).where("title is not null")
    target = F.nullif(F.trim(F.regexp_extract(F.trim(F.coalesce("text", F.lit(""))), REDIRECT, 1)), F.lit(""))
    return rows.select(F.coalesce("namespace", F.lit(0)).alias("namespace"), "title", F.col("text").alias("content"), target.alias("redirect_to"))


def dump(spark: SparkSession, path: str) -> DataFrame | None:
    """The reader for a dump by its extension; None for other files."""
    if path.endswith(".xml"):
        return mediawiki(spark, path).select("title", "namespace", "content", "redirect_to")
    if path.endswith((".json", ".jsonl")):
        return wiki_json(spark, path, not path.endswith(".jsonl")).select("title", "namespace", "content", "redirect_to")
    return None


def two_columns(spark: SparkSession, path: str, title: str = "title", text: str = "text") -> DataFrame:
    """Title and text of a parquet table, nulls as empty, in the main namespace."""
    return spark.read.parquet(path).select(F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("namespace"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a word list: trimmed, without comments and blank lines, each once."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and not startswith(word, '#')").distinct()


def articles_of_lines(lines: DataFrame, least: int = 50) -> DataFrame:
    """Articles of news lines (file, row, line): '제목:' begins one, other lines are its paragraphs.

    Islands are counted within a file, so files are worked on in parallel.
    """
    line = F.trim("line")
    begins = line.startswith("제목:")
    order = Window.partitionBy("file").orderBy("row")
    island = F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    paragraph = F.trim(F.regexp_replace(line, "^내용:", ""))
    rows = lines.select("file", "row", begins.alias("begins"), line.alias("line"), paragraph.alias("paragraph"), island.alias("island")).where("island > 0")
    title = F.max(F.when(F.col("begins"), F.trim(F.substring("line", 4, 1_000_000))))
    body = F.array_sort(F.collect_list(F.when(~F.col("begins") & (F.col("paragraph") != ""), F.struct("row", "paragraph"))))  # the paragraphs of one article
    out = rows.groupBy("file", "island").agg(F.substring(title, 1, 512).alias("title"), F.array_join(F.transform(body, lambda x: x["paragraph"]), "\n\n").alias("body"))
    return out.where((F.col("title") != "") & (F.length("body") >= least)).select("file", "island", "title", "body")


def titled_texts(texts: DataFrame, text: str, least: int = 100, least_body: int = 50) -> DataFrame:
    """Web texts of at least `least` characters with a title taken from them."""
    parts = texts.where(F.length(text) >= least).withColumn("parts", title_parts(F.col(text)))
    return parts.where((F.col("parts.title") != "") & (F.length("parts.body") >= least_body)).select("*", F.col("parts.title").alias("new_title"), F.col("parts.body").alias("body")).drop("parts")


def synthetic_users(spark: SparkSession, count: int, seed: int = 42) -> DataFrame:
    """Users with names in turn Korean and English and a random day of joining within two years."""
    korean = F.concat(F.lit("사용자"), F.col("id").cast("string"))
    english = F.concat(F.lit("user"), F.col("id").cast("string"))
    day = F.floor(F.rand(seed) * 730).cast("int")
    return spark.range(1, count + 1).select("id", english.alias("username"), F.when(F.col("id") % 2 == 0, korean).otherwise(english).alias("nickname"), F.date_sub(F.lit("2025-12-01").cast("date"), day).alias("created_on"))
