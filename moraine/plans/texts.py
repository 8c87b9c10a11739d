"""Queries of the scalar text functions over whole posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import korean, markup, words
from moraine.plans.common import POSTS, current_posts
from moraine.plans.registry import Registry

registry = Registry()


def _scalar(name: str, column: str, make, sql: str, **more: tuple) -> None:
    """A query with the id and one or more expressions of a post column."""
    exprs = {"value": (make, sql)} | more

    def query(spark: SparkSession, folder: str) -> DataFrame:
        posts = current_posts(spark, folder, column)
        return posts.select("id", *[f(F.col(column)).alias(k) for k, (f, _) in exprs.items()])

    registry.add(name, f"WITH {POSTS} SELECT id, " + ", ".join(f"{s.format(c=column)} AS {k}" for k, (_, s) in exprs.items()) + " FROM p")(query)


def _sql(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}").replace("§", "{c}")


_scalar("strip_markup", "content", markup.strip_markup, _sql(markup.strip_markup_sql("§")))
_scalar("snippet", "content", markup.snippet, _sql(markup.snippet_sql("§")))
_scalar("snippet_source", "content", markup.snippet_source, _sql(markup.snippet_source_sql("§")))
_scalar("detect_format", "content", markup.wiki_format, _sql(markup.wiki_format_sql("§")))
_scalar("plain_html", "content", markup.plain_html, _sql(markup.plain_html_sql("§")))
_scalar("heading_anchor", "title", markup.anchor, _sql(markup.anchor_sql("§")))
_scalar("jamo_decompose", "title", korean.decompose, _sql(korean.decompose_sql("§")))
_scalar("jamo_choseong", "title", korean.initials, _sql(korean.initials_sql("§")), letters=(korean.has_letters, _sql(korean.has_letters_sql("§"))))
_scalar("ngrams_2_3", "title", lambda c: F.array_join(words.ngrams(words.tokens(c)), "|"), _sql(f"array_to_string({words.ngrams_sql(words.tokens_sql('§'))}, '|')"))
_scalar("analyze_tokens", "content", lambda c: F.array_join(words.tokens(c), " "), _sql(f"array_to_string({words.tokens_sql('§')}, ' ')"))
_scalar(
    "title_extract",
    "content",
    lambda c: words.title_parts(c)["title"],
    _sql(words.title_parts_sql("§") + ".title").replace("CASE", "(CASE", 1).replace("END.title", "END).title"),
    body=(lambda c: words.title_parts(c)["body"], _sql(words.title_parts_sql("§") + ".body").replace("CASE", "(CASE", 1).replace("END.body", "END).body")),
)
_scalar("index_truncate", "title", lambda c: F.substring(c, 1, 50), "substring({c}, 1, 50)", folded=(lambda c: F.lower(F.btrim(c)), "lower(trim({c}))"))


@registry.add("extract_tags", f"WITH {POSTS} SELECT id, unnest({markup.tags_sql('content')}) AS tag FROM p")
def extract_tags(spark: SparkSession, folder: str) -> DataFrame:
    return current_posts(spark, folder, "content").select("id", F.explode(markup.tags(F.col("content"))).alias("tag"))


REDIRECTS = (r"(?i)#(?:redirect|넘겨주기)\s+(.+)", r"(?i)#(?:넘겨주기|REDIRECT)\s*\[\[(.+?)\]\]")


def redirect_target(text: Column) -> Column:
    """Target of a redirecting page in either dialect; null if it is none."""
    found = [F.nullif(F.trim(F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), p, 1)), F.lit("")) for p in reversed(REDIRECTS)]
    return F.coalesce(*found)


@registry.add(
    "redirect_target",
    f"WITH {POSTS}, m AS (SELECT id, CASE WHEN id % 3 = 0 THEN '#REDIRECT [[' || title || ']] ' WHEN id % 3 = 1 THEN ' #넘겨주기 ' || title ELSE content END AS page FROM p) SELECT id, coalesce("
    + ", ".join(f"nullif(trim(regexp_extract(trim(coalesce(page, '')), {markup.quoted(p)}, 1)), '')" for p in reversed(REDIRECTS))
    + ") AS target FROM m",
)
def redirects(spark: SparkSession, folder: str) -> DataFrame:
    """Redirects made of titles in both dialects, and of other pages none."""
    page = F.when(F.col("id") % 3 == 0, F.concat(F.lit("#REDIRECT [["), "title", F.lit("]] "))).when(F.col("id") % 3 == 1, F.concat(F.lit(" #넘겨주기 "), "title")).otherwise(F.col("content"))
    return current_posts(spark, folder, "title", "content").select("id", redirect_target(page).alias("target"))


@registry.add(
    "html_escape",
    f"WITH {POSTS} SELECT id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS value FROM p",
)
def html_escape(spark: SparkSession, folder: str) -> DataFrame:
    out = F.col("title")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return current_posts(spark, folder, "title").select("id", out.alias("value"))


@registry.add("namespace_filter", f"WITH {POSTS} SELECT id, title FROM p WHERE NOT regexp_matches(coalesce(content, ''), '(?i)#(redirect|넘겨주기)') AND NOT regexp_matches(coalesce(title, ''), '^(틀|분류|파일|사용자|Template|Category|File|User):')")
def namespace_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Articles: neither a redirect nor a page of another namespace."""
    posts = current_posts(spark, folder, "title", "content")
    other = F.coalesce("title", F.lit("")).rlike("^(틀|분류|파일|사용자|Template|Category|File|User):")
    return posts.where(~F.coalesce("content", F.lit("")).rlike("(?i)#(redirect|넘겨주기)") & ~other).select("id", "title")


@registry.add("blank_filter", f"WITH {POSTS} SELECT id, length(content) AS chars FROM p WHERE trim(coalesce(content, '')) <> ''")
def blank_filter(spark: SparkSession, folder: str) -> DataFrame:
    return current_posts(spark, folder, "content").where(F.trim(F.coalesce("content", F.lit(""))) != "").select("id", F.length("content").cast("bigint").alias("chars"))
