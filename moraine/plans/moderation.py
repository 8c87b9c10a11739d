"""Queries of classification by keywords, reclassification, summary decisions and summary context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import markup
from moraine.plans.common import HEADS, POSTS, current_posts
from moraine.plans.logs import BANNED, IS_BANNED, LOGS, banned, logs, with_banned
from moraine.plans.registry import Registry
from moraine.plans.search import QUERIES, _rank_sql, _top, full_rank, index_of
from moraine.operators import search as S
from moraine.tables import table

registry = Registry()
KEYWORDS = "k AS (SELECT DISTINCT c.id AS category_id, lower(trim(w.keyword)) AS keyword, w.weight FROM category_keywords w JOIN categories c ON c.name = w.category_name WHERE w.weight >= 0.8)"


def keywords(spark: SparkSession, folder: str) -> list[tuple[str, int, float]]:
    """Weighty keywords with their category; a dictionary whose size is checked."""
    names = table(spark, folder, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    rows = table(spark, folder, "category_keywords").where("weight >= 0.8").join(names, "category_name").select(F.lower(F.trim("keyword")).alias("keyword"), "category_id", "weight").distinct().limit(20_001).collect()
    if len(rows) > 20_000:
        raise ValueError("more than 20,000 keywords")
    return sorted(tuple(r) for r in rows)


def found_in(text: Column, words: list[tuple[str, int, float]]) -> Column:
    """The entries of the dictionary whose keyword stands in the text; no pair leaves the row."""
    entries = F.array(*[F.struct(F.lit(w).alias("keyword"), F.lit(c).cast("bigint").alias("category_id"), F.lit(x).alias("weight")) for w, c, x in words])
    return F.filter(entries, lambda e: F.contains(text, e["keyword"]))


@registry.add(
    "keyword_vote_category",
    f"""WITH {POSTS}, {KEYWORDS}, g AS (SELECT id, list_distinct({markup.tags_sql('content')}) AS tags FROM p),
v AS (SELECT p.id, category_id, weight AS w FROM (SELECT id, title FROM p) p JOIN k ON contains(lower(p.title), keyword)
  UNION ALL SELECT id, category_id, 0.5 * weight FROM (SELECT id, unnest(tags) AS tag FROM g) t JOIN k ON contains(lower(tag), keyword)),
s AS (SELECT id, category_id, round(sum(w), 6) AS votes FROM v GROUP BY ALL)
SELECT p.id, s.category_id FROM p LEFT JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, category_id) = 1) s ON p.id = s.id""",
)
def keyword_vote_category(spark: SparkSession, folder: str) -> DataFrame:
    """The category with the most votes: weights of keywords in the title, half of those in each tag; the lower id if equal."""
    words = keywords(spark, folder)
    posts = current_posts(spark, folder, "title", "content")
    tags = F.array_distinct(markup.tags(F.col("content")))
    half = F.flatten(F.transform(tags, lambda t: F.transform(found_in(F.lower(t), words), lambda e: F.struct(e["category_id"].alias("category_id"), (e["weight"] * 0.5).alias("weight")))))
    whole = F.transform(found_in(F.lower(F.coalesce("title", F.lit(""))), words), lambda e: F.struct(e["category_id"].alias("category_id"), e["weight"].alias("weight")))
    votes = posts.select("id", F.explode(F.concat(whole, half)).alias("v")).groupBy("id", F.col("v.category_id").alias("category_id")).agg(F.round(F.sum("v.weight"), 6).alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", -F.col("category_id"), "category_id")).alias("b")).select("id", "b.category_id")
    return posts.select("id").join(best, "id", "left")


@registry.add("reclassify_first_match", f"WITH {HEADS}, {KEYWORDS} SELECT p.id, coalesce(min(k.category_id), 20) AS category_id FROM p LEFT JOIN k ON contains(lower(p.title), keyword) GROUP BY p.id")
def reclassify_first_match(spark: SparkSession, folder: str) -> DataFrame:
    """The first category, by id, of which a keyword stands in the title; else the catch-all."""
    ids = F.transform(found_in(F.lower(F.coalesce("title", F.lit(""))), keywords(spark, folder)), lambda e: e["category_id"])
    return current_posts(spark, folder, "title").select("id", F.coalesce(F.array_min(ids), F.lit(20).cast("bigint")).alias("category_id"))


@registry.add("like_chain", f"WITH {HEADS} SELECT id FROM p WHERE lower(title) LIKE '%금리%' OR lower(title) LIKE '%index%' OR lower(title) LIKE '%고분%'")
def like_chain(spark: SparkSession, folder: str) -> DataFrame:
    wanted = [F.lower("title").like(f"%{w}%") for w in ("금리", "index", "고분")]
    return current_posts(spark, folder, "title").where(reduce(Column.__or__, wanted)).select("id")


@registry.add("title_relevance", f"WITH {HEADS}, q(qid, q) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in QUERIES.items()) + ") SELECT qid, id FROM p JOIN q ON NOT starts_with(title, '틀:') AND NOT starts_with(title, '분류:') AND len(list_filter(string_split(q, ' '), lambda w: contains(title, w))) >= ceil(len(string_split(q, ' ')) / 2.0)")
def title_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of which a title holds at least half of the words; titles of other namespaces are never relevant."""
    title = F.col("title")
    asked = F.array(*[F.struct(F.lit(q).alias("qid"), F.array(*map(F.lit, t.split())).alias("words")) for q, t in QUERIES.items()])
    enough = lambda a: F.size(F.filter(a["words"], lambda w: F.contains(title, w))) >= F.ceil(F.size(a["words"]) / 2)
    posts = current_posts(spark, folder, "title").where(~title.startswith("틀:") & ~title.startswith("분류:"))
    return posts.select(F.explode(F.filter(asked, enough)).alias("a"), "id").select("a.qid", "id")


# The words that tell what a query is after.
NAVIGATION = ("네이버", "다음", "구글", "유튜브", "쿠팡", "인스타그램", "카카오톡", "naver", "google", "youtube", "facebook", "instagram", "twitter")
TRADE = ("구매", "가격", "할인", "예약", "배송", "최저가", "주문", "결제", "buy", "price", "order", "cheap", "discount", "shop")
ADDRESS = r"\.(com|net|co\.kr|org|io|dev)"
DECISION = (
    "CASE WHEN length(query) < 2 THEN 'short' WHEN is_banned THEN 'banned' WHEN query IN (" + ", ".join(f"'{w}'" for w in NAVIGATION) + f") THEN 'navigation' WHEN regexp_matches(query, '{ADDRESS}') THEN 'address' WHEN regexp_matches(query, '"
    + "|".join(TRADE) + "') THEN 'trade' WHEN lines < CASE WHEN contains(query, '?') THEN 1 ELSE 3 END THEN 'few hits' ELSE 'proceed' END"
)


@registry.add("summary_decision", f"WITH {LOGS}, {BANNED}, q AS (SELECT query, count(*) AS lines FROM l GROUP BY query), d AS (SELECT *, EXISTS (SELECT 1 FROM b WHERE {IS_BANNED}) AS is_banned FROM q) SELECT query, {DECISION} AS reason FROM d")
def summary_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a query gets a summary, by the first rule that applies; the times it was asked stand for hits."""
    counted = logs(spark, folder).groupBy("query").agg(F.count("*").alias("lines"))
    counted = with_banned(counted, banned(spark, folder))
    q = F.col("query")
    reason = (
        F.when(F.length(q) < 2, "short")
        .when(F.col("is_banned"), "banned")
        .when(q.isin(*NAVIGATION), "navigation")
        .when(q.rlike(ADDRESS), "address")
        .when(q.rlike("|".join(TRADE)), "trade")
        .when(F.col("lines") < F.when(F.contains(q, F.lit("?")), 1).otherwise(3), "few hits")
        .otherwise("proceed")
    )
    return counted.select("query", reason.alias("reason"))


CONTEXT = "'[' || place || '] ' || coalesce(title, '') || chr(10) || 'id: ' || id || chr(10) || coalesce(source, '')"


@registry.add("context_block", f"WITH {POSTS}, {_rank_sql()}, {_top('fr', 5)}, r AS (SELECT t.qid, t.place, t.id, p.title, {markup.snippet_source_sql('p.content')} AS source FROM top t JOIN p USING (id)) SELECT qid, string_agg({CONTEXT}, chr(10) || chr(10) ORDER BY place) AS context FROM r GROUP BY qid")
def context_block(spark: SparkSession, folder: str) -> DataFrame:
    """The five best posts of every query as numbered blocks."""
    index = index_of(spark, folder)
    top = F.broadcast(S.ranked(full_rank(index), 5).select("qid", "place", "id"))
    rows = index.docs().select("id", "title", F.col("source_text").alias("source")).join(top, "id")
    block = F.concat(F.lit("["), "place", F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\nid: "), F.col("id").cast("string"), F.lit("\n"), F.coalesce("source", F.lit("")))
    blocks = F.array_sort(F.collect_list(F.struct("place", block.alias("text"))))  # five at most
    return rows.groupBy("qid").agg(F.array_join(F.transform(blocks, lambda x: x["text"]), "\n\n").alias("context"))


@registry.add("citations", f"""WITH {HEADS}, a AS (SELECT id, '설명 [문서 ' || (id % 7) || '] 그리고 [문서 2] 또 [문서 ' || (id % 4) || '].' AS answer FROM p),
m AS (SELECT id, unnest(regexp_extract_all(answer, '\\[문서 (\\d+)\\]', 1)) AS no, unnest(generate_series(1, len(regexp_extract_all(answer, '\\[문서 (\\d+)\\]', 1)))) AS spot FROM a)
SELECT id, CAST(no AS INT) AS doc_no, CAST(min(spot) - 1 AS INT) AS first_at FROM m WHERE CAST(no AS INT) BETWEEN 1 AND 5 GROUP BY id, no""")
def citations(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that answers cite, once each, by where they are cited first; numbers beyond the five given are left out."""
    n = F.col("id")
    answer = F.concat(F.lit("설명 [문서 "), (n % 7).cast("string"), F.lit("] 그리고 [문서 2] 또 [문서 "), (n % 4).cast("string"), F.lit("]."))
    cited = current_posts(spark, folder).select("id", F.posexplode(F.regexp_extract_all(answer, F.lit(r"\[문서 (\d+)\]"), F.lit(1))).alias("at", "no"))
    return cited.select("id", F.col("no").cast("int").alias("doc_no"), "at").where("doc_no between 1 and 5").groupBy("id", "doc_no").agg(F.min("at").alias("first_at"))


@registry.add("score_parse", f"""WITH {HEADS}, a AS (SELECT id, CASE WHEN id % 3 = 0 THEN '{{"score": ' || (id % 10) || ', "why": "-"}}' WHEN id % 3 = 1 THEN 'grade ' || (id % 6) || ' of 3' ELSE 'none' END AS said FROM p)
SELECT id, coalesce(list_min([CAST(nullif(regexp_extract(said, '"score"\\s*:\\s*(\\d)', 1), '') AS INT), CASE WHEN regexp_matches(said, '"score"\\s*:\\s*\\d') THEN 3 END]), CAST(nullif(regexp_extract(said, '\\b([0-3])\\b', 1), '') AS INT), -1) AS score FROM a""")
def score_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Grades read from answers: a score field cut to 3, else the first single digit up to 3, else -1."""
    n = F.col("id")
    said = F.when(n % 3 == 0, F.concat(F.lit('{"score": '), (n % 10).cast("string"), F.lit(', "why": "-"}'))).when(n % 3 == 1, F.concat(F.lit("grade "), (n % 6).cast("string"), F.lit(" of 3"))).otherwise("none")
    field = F.nullif(F.regexp_extract(said, r'"score"\s*:\s*(\d)', 1), F.lit("")).cast("int")
    digit = F.nullif(F.regexp_extract(said, r"\b([0-3])\b", 1), F.lit("")).cast("int")
    return current_posts(spark, folder).select("id", F.coalesce(F.when(field > 3, 3).otherwise(field), digit, F.lit(-1)).alias("score"))
