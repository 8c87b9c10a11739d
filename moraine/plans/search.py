"""Queries of full-text search: scoring, ranking, paging, facets, suggestions and evaluation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import korean, markup, words
from moraine.operators import search as S
from moraine.operators.alike import nearest
from moraine.operators.index import field_stats, field_words, postings
from moraine.operators.stored import Index, standing
from moraine.plans.common import AS_OF, HEADS, POSTS, REPEATED, as_of, current_posts
from moraine.plans.registry import Registry
from moraine.storage import file_stamp, fresh_path, materialize
from moraine.tables import table

registry = Registry()

QUERIES = {1: "금리 세금", 2: "database index", 3: "고분 왕조", 4: "orchestra chord", 5: "재무제표", 6: "안방 구장", 7: "mountain range"}
TITLE_SQL, CONTENT_SQL = words.tokens_sql("title"), words.tokens_sql("content")
GRAMS_SQL = words.ngrams_sql(TITLE_SQL)


def _terms(split, boost: float = 1.0) -> S.Terms:
    return [(q, t, boost) for q, text in QUERIES.items() for t in dict.fromkeys(split(text))]


WORD_TERMS, GRAM_TERMS = _terms(S.words_of_query), _terms(S.grams_of_query)


def _values(name: str, terms: S.Terms) -> str:
    return f"{name}(qid, term, boost) AS (VALUES " + ", ".join(f"({q}, {markup.quoted(t)}, CAST({b} AS DOUBLE))" for q, t, b in terms) + ")"


def _bm25(name: str, ws: str, terms: str) -> str:
    return f"""{name}_t AS (SELECT id, {ws} AS ws FROM p),
{name}_s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM {name}_t WHERE len(ws) > 0),
{name}_h AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM {name}_t) WHERE term IN (SELECT term FROM {terms}) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_h GROUP BY term),
{name} AS (SELECT q.qid, h.id, sum(q.boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {S.K1} * (1 - {S.B} + {S.B} * dl / avgdl))) AS score
  FROM {name}_h h JOIN {name}_d USING (term) JOIN {terms} q USING (term) CROSS JOIN {name}_s GROUP BY q.qid, h.id)"""


def _top(source: str, most: int) -> str:
    return f"top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM (SELECT * REPLACE (round(score, 6) AS score) FROM {source}) QUALIFY place <= {most})"


def title_words() -> Column:
    return words.tokens(F.col("title"))


def content_words() -> Column:
    return words.tokens(F.col("content"))


def title_grams() -> Column:
    return words.ngrams(title_words())


def telling_words() -> Column:
    """Words of the title and of the first 500 characters, by which posts are held to be alike."""
    return words.tokens(F.concat_ws(" ", "title", F.substring("content", 1, 500)))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return current_posts(spark, folder, "title", "content", "category_id", "view_count", "like_count", "blinded", "author_id", "created_at")


def sourced(docs: DataFrame) -> DataFrame:
    """Documents as the index takes them: with the text without markup, taken out once."""
    return docs.withColumn("source_text", markup.snippet_source(F.col("content")))


def fields() -> dict[str, Column]:
    return {"title": title_words(), "content": content_words(), "gram": title_grams(), "snippet": words.tokens(F.col("source_text"))}


def stored() -> list[Column]:
    content = F.col("content")
    plain = [F.col(c) for c in ("title", "category_id", "view_count", "like_count", "blinded", "author_id", "created_at")]
    return [*plain, markup.snippet(content).alias("snippet"), F.col("source_text"), markup.tags(content).alias("tags")]


def index_of(spark: SparkSession, folder: str) -> Index:
    """The standing index of the posts of a folder: built by the first query that needs it, again if the table has changed."""
    source = f"{folder}/posts.parquet"

    def make() -> Index:
        return Index(spark, fresh_path(spark, "search-index"), fields(), stored()).create(sourced(_docs(spark, folder)))

    return standing(spark, (source, file_stamp(spark, source)), make)


def boosted(boost: float) -> S.Terms:
    return [(q, t, boost) for q, t, _ in WORD_TERMS]


def title_scores(index: Index) -> DataFrame:
    return index.scored({"score": [("title", WORD_TERMS)]})


TEXT_FIELDS = [("title", boosted(3.0)), ("content", WORD_TERMS)]


def text_scores(index: Index) -> DataFrame:
    """Words of the query in title, three times, and content."""
    return index.scored({"score": TEXT_FIELDS})


def matched(index: Index) -> DataFrame:
    """The higher of the scores by words and by n-grams of the title, and a share of the lower, from one pass."""
    both = index.scored({"text": TEXT_FIELDS, "gram": [("gram", GRAM_TERMS)]})
    return both.select("qid", "id", S.best_of(F.col("text"), F.col("gram")).alias("score"))


def full_rank(index: Index, category: int | None = None) -> DataFrame:
    """Matches that are not blinded, by relevance, popularity and recency."""
    kept = index.docs().where(~F.coalesce("blinded", F.lit(False)))
    if category is not None:
        kept = kept.where(F.col("category_id") == category)
    age = S.age_days(F.col("created_at"), as_of())
    extra = S.saturation(F.col("view_count"), 3.0, 1000.0) + S.saturation(F.col("like_count"), 2.0, 100.0) + S.recency(age)
    return matched(index).join(kept.select("id", "category_id", extra.alias("extra")), "id").select("qid", "id", "category_id", (F.col("score") + F.col("extra")).alias("score"))


TEXT_SQL = f"""{_values('w', WORD_TERMS)}, {_bm25('bt', TITLE_SQL, 'w')}, {_bm25('bc', CONTENT_SQL, 'w')},
tx AS (SELECT qid, id, sum(score) AS score FROM (SELECT qid, id, 3 * score AS score FROM bt UNION ALL SELECT qid, id, score FROM bc) GROUP BY qid, id)"""
MATCH_SQL = f"""{TEXT_SQL}, {_values('g', GRAM_TERMS)}, {_bm25('bg', GRAMS_SQL, 'g')},
mt AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id,
  greatest(coalesce(a.score, 0), 2 * coalesce(b.score, 0)) + 0.1 * least(coalesce(a.score, 0), 2 * coalesce(b.score, 0)) AS score
  FROM tx a FULL JOIN bg b ON a.qid = b.qid AND a.id = b.id)"""
AGE_SQL = f"(date_diff('microsecond', created_at, TIMESTAMP '{AS_OF}') / 86400000000.0)"
EXTRA_SQL = f"(3.0 * greatest(view_count, 1) / (greatest(view_count, 1) + 1000.0) + 2.0 * greatest(like_count, 1) / (greatest(like_count, 1) + 100.0) + 5.0 * exp(-ln(2) / 30.0 * greatest({AGE_SQL}, 0)))"


def _rank_sql(where: str = "") -> str:
    return f"{MATCH_SQL}, fr AS (SELECT m.qid, m.id, p.category_id, m.score + {EXTRA_SQL} AS score FROM mt m JOIN p USING (id) WHERE NOT coalesce(blinded, false){where})"


@registry.add("search_bm25", f"WITH {POSTS}, {_values('w', WORD_TERMS)}, {_bm25('bt', TITLE_SQL, 'w')}, {_top('bt', 10)} SELECT qid, id, score, place FROM top")
def search_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return S.ranked(title_scores(index_of(spark, folder)), 10)


@registry.add("search_multifield", f"WITH {POSTS}, {TEXT_SQL}, {_top('tx', 10)} SELECT qid, id, score, place FROM top")
def search_multifield(spark: SparkSession, folder: str) -> DataFrame:
    return S.ranked(text_scores(index_of(spark, folder)), 10)


@registry.add("search_ngram", f"WITH {POSTS}, {_values('g', GRAM_TERMS)}, {_bm25('bg', GRAMS_SQL, 'g')}, {_top('bg', 10)} SELECT qid, id, score, place FROM top")
def search_ngram(spark: SparkSession, folder: str) -> DataFrame:
    return S.ranked(index_of(spark, folder).scored({"score": [("gram", GRAM_TERMS)]}), 10)


@registry.add("search_dismax", f"WITH {POSTS}, {MATCH_SQL}, {_top('mt', 10)} SELECT qid, id, score, place FROM top")
def search_dismax(spark: SparkSession, folder: str) -> DataFrame:
    return S.ranked(matched(index_of(spark, folder)), 10)


@registry.add("search_full_rank", f"WITH {POSTS}, {_rank_sql()}, {_top('fr', 20)} SELECT qid, id, category_id, score, place FROM top")
def search_full_rank(spark: SparkSession, folder: str) -> DataFrame:
    return S.ranked(full_rank(index_of(spark, folder)), 20)


@registry.add("search_category_filter", f"WITH {POSTS}, {_rank_sql(' AND category_id = 10')}, {_top('fr', 20)} SELECT qid, id, category_id, score, place FROM top")
def search_category_filter(spark: SparkSession, folder: str) -> DataFrame:
    return S.ranked(full_rank(index_of(spark, folder), 10), 20)


@registry.add("search_exclude_blinded", f"WITH {POSTS}, {TEXT_SQL}, ok AS (SELECT tx.* FROM tx JOIN p USING (id) WHERE NOT coalesce(blinded, false)), {_top('ok', 10)} SELECT qid, id, score, place FROM top")
def search_exclude_blinded(spark: SparkSession, folder: str) -> DataFrame:
    index = index_of(spark, folder)
    seen = index.docs().where(~F.coalesce("blinded", F.lit(False))).select("id")
    return S.ranked(text_scores(index).join(seen, "id"), 10)


@registry.add("search_page", f"WITH {POSTS}, {_rank_sql()}, {_top('fr', 21)} SELECT qid, id, category_id, score, place, max(place) OVER (PARTITION BY qid) > 20 AS has_next FROM top QUALIFY place BETWEEN 11 AND 20")
def search_page(spark: SparkSession, folder: str) -> DataFrame:
    return S.page(full_rank(index_of(spark, folder)), 10, 10)


FACETS = f"WITH {POSTS}, {_rank_sql()}, f AS (SELECT qid, coalesce(c.name, '기타') AS category, count(*) AS hits FROM fr LEFT JOIN categories c ON fr.category_id = c.id WHERE fr.category_id IS NOT NULL GROUP BY ALL)"


@registry.add("search_facets", f"{FACETS} SELECT qid, category, hits FROM f QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hits DESC, category) <= 30")
def search_facets(spark: SparkSession, folder: str) -> DataFrame:
    return facets(full_rank(index_of(spark, folder)), category_names(spark, folder))


def category_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "categories").select(F.col("id").alias("category_id"), "name")


def facets(scored: DataFrame, names: DataFrame, most: int = 30) -> DataFrame:
    """The categories with the most hits of every query."""
    counted = scored.where("category_id is not null").groupBy("qid", "category_id").agg(F.count("*").alias("n"))
    named = counted.join(names, "category_id", "left").groupBy("qid", F.coalesce("name", F.lit("기타")).alias("category")).agg(F.sum("n").alias("hits"))
    order = Window.partitionBy("qid").orderBy(F.col("hits").desc(), "category")
    return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


@registry.add(
    "search_hydrated",
    f"WITH {POSTS}, {_rank_sql()}, {_top('fr', 10)} SELECT t.qid, t.place, t.id, p.title, u.nickname, coalesce(c.name, '기타') AS category, {markup.snippet_sql('p.content')} AS snippet, p.view_count FROM top t JOIN p USING (id) LEFT JOIN users u ON p.author_id = u.id LEFT JOIN categories c ON p.category_id = c.id",
)
def search_hydrated(spark: SparkSession, folder: str) -> DataFrame:
    index = index_of(spark, folder)
    users = table(spark, folder, "users").select(F.col("id").alias("author_id"), "nickname")
    # ten rows a query are left by now
    top = F.broadcast(S.ranked(full_rank(index), 10).select("qid", "place", "id"))
    rows = index.docs().select("id", "title", "snippet", "author_id", "category_id", "view_count").join(top, "id")
    shown = rows.join(users, "author_id", "left").join(category_names(spark, folder), "category_id", "left")
    return shown.select("qid", "place", "id", "title", "nickname", F.coalesce("name", F.lit("기타")).alias("category"), "snippet", "view_count")


@registry.add(
    "search_response",
    f"""{FACETS}, {_top('fr', 11)}, hits AS (SELECT t.qid, 'hit' AS part, t.place, t.id, p.title AS label, {markup.snippet_sql('p.content')} AS snippet, CAST(NULL AS BIGINT) AS hits, (SELECT max(place) > 10 FROM top u WHERE u.qid = t.qid) AS has_next FROM top t JOIN p USING (id) WHERE t.place <= 10),
fc AS (SELECT qid, 'facet' AS part, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, category) AS place, CAST(NULL AS BIGINT) AS id, category AS label, CAST(NULL AS VARCHAR) AS snippet, hits, CAST(NULL AS BOOLEAN) AS has_next FROM f QUALIFY place <= 30)
SELECT qid, part, CAST(place AS INT) AS place, id, label, snippet, hits, has_next FROM hits UNION ALL SELECT qid, part, CAST(place AS INT), id, label, snippet, hits, has_next FROM fc""",
)
def search_response(spark: SparkSession, folder: str) -> DataFrame:
    """What one search answers: the first page with snippets and whether another follows, and the facets of all hits, from one scoring."""
    index = index_of(spark, folder)
    scored = materialize(full_rank(index), "hits")
    top = F.broadcast(S.page(scored, 0, 10).select("qid", "place", "id", "has_next"))  # ten rows a query
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = index.docs().select("id", F.col("title").alias("label"), "snippet").join(top, "id")
    rows = rows.select("qid", F.lit("hit").alias("part"), "place", "id", "label", "snippet", none("bigint", "hits"), "has_next")
    order = Window.partitionBy("qid").orderBy(F.col("hits").desc(), "category")
    counts = facets(scored, category_names(spark, folder)).withColumn("place", F.row_number().over(order))
    counts = counts.select("qid", F.lit("facet").alias("part"), "place", none("bigint", "id"), F.col("category").alias("label"), none("string", "snippet"), "hits", none("boolean", "has_next"))
    return rows.unionByName(counts)


PHRASES = ((1, "database", "index"), (2, "interest", "rate"), (3, "보스", "단계"), (4, "mountain", "range"))


@registry.add(
    "search_phrase",
    f"WITH {POSTS}, ph(qid, a, b) AS (VALUES " + ", ".join(f"({q}, '{a}', '{b}')" for q, a, b in PHRASES) + f"""),
t AS (SELECT id, unnest(ws) AS term, unnest(generate_series(1, len(ws))) AS pos FROM (SELECT id, {CONTENT_SQL} AS ws FROM p)),
h AS (SELECT * FROM t WHERE term IN (SELECT a FROM ph UNION SELECT b FROM ph))
SELECT qid, x.id, count(*) AS places, min(y.pos - x.pos - 1) AS slop FROM ph JOIN h x ON x.term = ph.a JOIN h y ON y.term = ph.b AND y.id = x.id AND y.pos > x.pos AND y.pos - x.pos - 1 <= 2 GROUP BY qid, x.id""",
)
def search_phrase(spark: SparkSession, folder: str) -> DataFrame:
    """Two words in order with at most two words between them."""
    terms = sorted({t for _, a, b in PHRASES for t in (a, b)})
    at = current_posts(spark, folder, "content").select("id", F.posexplode(content_words()).alias("pos", "term")).where(F.col("term").isin(terms))
    phrases = F.broadcast(spark.createDataFrame(list(PHRASES), "qid int, a string, b string"))
    first = at.withColumnRenamed("term", "a").join(phrases, "a")
    second = at.select("id", F.col("term").alias("b"), F.col("pos").alias("end"))
    gap = F.col("end") - F.col("pos") - 1
    return first.join(second, ["id", "b"]).where(gap.between(0, 2)).groupBy("qid", "id").agg(F.count("*").alias("places"), F.min(gap).cast("bigint").alias("slop"))


@registry.add("term_stats", f"WITH {POSTS} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest({CONTENT_SQL}) AS term FROM p) GROUP BY term")
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and occurrences of every term."""
    return postings(field_words(current_posts(spark, folder, "content"), content_words())).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@registry.add("field_stats", f"WITH {POSTS} SELECT count(*) AS n, round(avg(len({TITLE_SQL})), 6) AS avgdl FROM p WHERE len({TITLE_SQL}) > 0")
def title_stats(spark: SparkSession, folder: str) -> DataFrame:
    return field_stats(field_words(current_posts(spark, folder, "title"), title_words())).select("n", F.round("avgdl", 6).alias("avgdl"))


@registry.add("recency_decay", f"WITH {HEADS} SELECT id, round(5.0 * exp(-ln(2) / 30.0 * greatest({AGE_SQL}, 0)), 6) AS boost, CAST(floor({AGE_SQL}) AS BIGINT) AS age FROM p")
def recency_decay(spark: SparkSession, folder: str) -> DataFrame:
    age = S.age_days(F.col("created_at"), as_of())
    return current_posts(spark, folder, "created_at").select("id", F.round(S.recency(age), 6).alias("boost"), F.floor(age).alias("age"))


@registry.add("saturation_boost", f"WITH {HEADS} SELECT id, round(3.0 * greatest(view_count, 1) / (greatest(view_count, 1) + 1000.0), 6) AS views, round(2.0 * greatest(like_count, 1) / (greatest(like_count, 1) + 100.0), 6) AS likes FROM p")
def saturation_boost(spark: SparkSession, folder: str) -> DataFrame:
    posts = current_posts(spark, folder, "view_count", "like_count")
    return posts.select("id", F.round(S.saturation(F.col("view_count"), 3.0, 1000.0), 6).alias("views"), F.round(S.saturation(F.col("like_count"), 2.0, 100.0), 6).alias("likes"))


QUERY_VALUES = "qs(qid, q) AS (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in QUERIES.items()) + ")"
#: A title is relevant if it holds at least half of the words of the query.
RELEVANT = "CAST(len(list_filter(string_split(q, ' '), lambda w: contains(title, w))) >= ceil(len(string_split(q, ' ')) / 2.0) AS INT)"


def _judged(spark: SparkSession, folder: str, scored, most: int) -> DataFrame:
    queries = F.broadcast(spark.createDataFrame(list(QUERIES.items()), "qid int, q string"))
    index = index_of(spark, folder)
    top = F.broadcast(S.ranked(scored(index), most).select("qid", "id", "place"))
    asked = F.split("q", " ")
    share = F.size(F.filter(asked, lambda w: F.contains("title", w)))
    return index.docs().select("id", "title").join(top, "id").join(queries, "qid").select("qid", "id", "place", F.coalesce((share >= F.ceil(F.size(asked) / 2)).cast("int"), F.lit(0)).alias("rel"))


def _judged_sql(source: str, scored: str, most: int) -> str:
    return f"WITH {POSTS}, {source}, {_top(scored, most)}, {QUERY_VALUES}, j AS (SELECT qid, top.id, place, coalesce({RELEVANT}, 0) AS rel FROM top JOIN p USING (id) JOIN qs USING (qid))"


AP_SQL = "ap AS (SELECT qid, sum(rel * running / CAST(place AS DOUBLE)) / greatest(sum(rel), 1) AS ap FROM (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY place) AS running FROM j) GROUP BY qid)"


def average_precision(judged: DataFrame) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    at = judged.withColumn("running", F.sum("rel").over(order))
    return at.groupBy("qid").agg((F.sum(F.col("rel") * F.col("running") / F.col("place")) / F.greatest(F.sum("rel"), F.lit(1))).alias("ap"))


@registry.add("eval_precision_at_10", _judged_sql(_rank_sql(), "fr", 10) + " SELECT qid, round(sum(rel) / CAST(least(10, greatest(count(*), 1)) AS DOUBLE), 3) AS p10 FROM j GROUP BY qid")
def precision_at_10(spark: SparkSession, folder: str) -> DataFrame:
    judged = _judged(spark, folder, full_rank, 10)
    return judged.groupBy("qid").agg(F.round(F.sum("rel") / F.least(F.lit(10), F.greatest(F.count("*"), F.lit(1))), 3).alias("p10"))


@registry.add("eval_average_precision", f"{_judged_sql(TEXT_SQL, 'tx', 50)}, {AP_SQL} SELECT qid, round(ap, 3) AS ap FROM ap")
def eval_average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return average_precision(_judged(spark, folder, text_scores, 50)).select("qid", F.round("ap", 3).alias("ap"))


@registry.add("eval_map", f"{_judged_sql(_rank_sql(), 'fr', 50)}, {AP_SQL} SELECT round(avg(ap), 3) AS map, count(*) AS queries FROM ap")
def eval_map(spark: SparkSession, folder: str) -> DataFrame:
    return average_precision(_judged(spark, folder, full_rank, 50)).agg(F.round(F.avg("ap"), 3).alias("map"), F.count("*").alias("queries"))


SYNONYMS = """syn AS (SELECT DISTINCT lower(trim(a.keyword)) AS term, lower(trim(b.keyword)) AS synonym, b.weight FROM category_keywords a JOIN category_keywords b ON a.category_name = b.category_name AND lower(trim(a.keyword)) <> lower(trim(b.keyword)) WHERE NOT contains(trim(b.keyword), ' ')),
s3 AS (SELECT term, synonym, max(weight) AS weight FROM syn GROUP BY term, synonym QUALIFY row_number() OVER (PARTITION BY term ORDER BY max(weight) DESC, synonym) <= 3)"""


def synonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three synonyms of every term, the keywords of its subject with the highest weight."""
    keywords = table(spark, folder, "category_keywords").select("category_name", F.lower(F.trim("keyword")).alias("term"), "weight")
    other = keywords.select("category_name", F.col("term").alias("synonym"), "weight").where(~F.contains("synonym", F.lit(" ")))
    pairs = keywords.drop("weight").join(other, "category_name").where("term <> synonym").groupBy("term", "synonym").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("term").orderBy(F.col("weight").desc(), "synonym")
    return pairs.withColumn("place", F.row_number().over(order)).where("place <= 3").drop("place")


@registry.add("synonym_expand", f"WITH {_values('w', WORD_TERMS)}, {SYNONYMS} SELECT qid, term, boost FROM w UNION ALL SELECT qid, synonym, weight FROM w JOIN s3 USING (term)")
def synonym_expand(spark: SparkSession, folder: str) -> DataFrame:
    asked = S.terms_frame(spark, WORD_TERMS)
    more = synonyms(spark, folder).join(asked.select("qid", "term"), "term").select("qid", F.col("synonym").alias("term"), F.col("weight").alias("boost"))
    return asked.unionByName(more)


@registry.add(
    "search_synonyms",
    f"WITH {POSTS}, {_values('w', WORD_TERMS)}, {SYNONYMS}, e AS (SELECT qid, term, max(boost) AS boost FROM (SELECT qid, term, boost FROM w UNION ALL SELECT qid, synonym, weight FROM w JOIN s3 USING (term)) GROUP BY qid, term), {_bm25('be', CONTENT_SQL, 'e')}, {_top('be', 10)} SELECT qid, id, score, place FROM top",
)
def search_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Content scored for the words of the query and, with their weights, their synonyms."""
    expanded = synonym_expand(spark, folder).groupBy("qid", "term").agg(F.max("boost").alias("boost"))
    terms = [tuple(r) for r in expanded.collect()]  # four a word of the query at most
    return S.ranked(index_of(spark, folder).scored({"score": [("content", terms)]}), 10)


MISSPELT = ("databse", "orchesta", "comipler", "galaxi", "dinasty", "goalkeper", "notes", "Recipy")
DICTIONARY = f"d AS (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest({TITLE_SQL}) AS term FROM p) GROUP BY term)"


@registry.add(
    "spell_suggest",
    f"WITH {POSTS}, {DICTIONARY}, m(word) AS (VALUES " + ", ".join(f"('{w}')" for w in MISSPELT) + """)
SELECT word, term AS suggestion, levenshtein(lower(word), term) AS distance FROM m JOIN d ON substring(lower(word), 1, 1) = substring(term, 1, 1) AND abs(length(word) - length(term)) <= 2
WHERE lower(word) NOT IN (SELECT term FROM d) AND length(term) >= 2 AND levenshtein(lower(word), term) <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY levenshtein(lower(word), term), df DESC, term) = 1""",
)
def spell_suggest(spark: SparkSession, folder: str) -> DataFrame:
    """For words that no title holds, the nearest term within two edits and with the same first letter."""
    dictionary = postings(field_words(current_posts(spark, folder, "title"), title_words())).groupBy("term").agg(F.count("*").alias("df"))
    wanted = F.broadcast(spark.createDataFrame([(w, w.lower()[0]) for w in MISSPELT], "word string, head string"))
    known = F.broadcast(dictionary.where(F.col("term").isin([w.lower() for w in MISSPELT])).select(F.col("term").alias("known")))
    near = dictionary.where(F.length("term") >= 2).withColumn("head", F.substring("term", 1, 1)).join(wanted, "head").where(F.abs(F.length("word") - F.length("term")) <= 2)
    near = near.withColumn("distance", F.levenshtein(F.lower("word"), "term", 2)).where("distance >= 0").join(known, F.lower("word") == F.col("known"), "left_anti")
    order = Window.partitionBy("word").orderBy("distance", F.col("df").desc(), "term")
    return near.withColumn("place", F.row_number().over(order)).where("place = 1").select("word", F.col("term").alias("suggestion"), F.col("distance").cast("bigint"))


LIKE_WORDS_SQL = words.tokens_sql("concat_ws(' ', title, substring(content, 1, 500))")
LIKE_SQL = f"""t AS (SELECT id, {LIKE_WORDS_SQL} AS ws FROM p), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM t) WHERE length(term) >= 2 GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 5), n AS (SELECT count(*) AS n FROM t),
best AS (SELECT id AS seed, term, idf FROM (SELECT tf.id, term, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM tf JOIN df USING (term) CROSS JOIN n WHERE tf.id % 50 = 0 AND tf >= 2) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(tf * idf, 6) DESC, term) <= 25),
near AS (SELECT seed, tf.id, round(sum(idf * tf / (tf + 1.2)), 6) AS score FROM best JOIN tf USING (term) WHERE tf.id <> seed GROUP BY seed, tf.id QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(sum(idf * tf / (tf + 1.2)), 6) DESC, tf.id) <= 10)"""


def more_like(spark: SparkSession, folder: str) -> DataFrame:
    """The ten posts nearest to every post whose id is divisible by 50, by its 25 most telling words."""
    docs = current_posts(spark, folder, "title", "content", first=500, repeated=REPEATED)
    docs = materialize(docs.select("id", F.filter(telling_words(), lambda w: F.length(w) >= 2).alias("ws")), "telling")  # read four times
    df = docs.select(F.explode(F.array_distinct("ws")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df >= 5")
    n = F.broadcast(docs.agg(F.count("*").alias("n")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = docs.where("id % 50 = 0").select("id", F.explode("ws").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf")).where("tf >= 2")
    seeds = tf.join(df, "term").crossJoin(n).select(F.col("id").alias("seed"), "term", "tf", idf.alias("idf"))
    order = Window.partitionBy("seed").orderBy(F.round(F.col("tf") * F.col("idf"), 6).desc(), "term")
    best = seeds.withColumn("place", F.row_number().over(order)).where("place <= 25").select("seed", "term", "idf")
    return nearest(docs, materialize(best, "seeds"))


@registry.add("more_like_this", f"WITH {POSTS}, {LIKE_SQL} SELECT seed, id, score FROM near")
def more_like_this(spark: SparkSession, folder: str) -> DataFrame:
    return more_like(spark, folder)


@registry.add("recommend_category", f"WITH {POSTS}, {LIKE_SQL} SELECT seed, category_id FROM (SELECT seed, category_id, count(*) AS votes FROM near JOIN p USING (id) WHERE category_id IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY seed ORDER BY votes DESC, category_id) = 1")
def recommend_category(spark: SparkSession, folder: str) -> DataFrame:
    """The category that most of the nearest posts have, the lower id if there are as many."""
    votes = more_like(spark, folder).join(current_posts(spark, folder, "category_id"), "id").where("category_id is not null").groupBy("seed", "category_id").agg(F.count("*").alias("votes"))
    return votes.groupBy("seed").agg(F.max(F.struct("votes", -F.col("category_id"), "category_id")).alias("v")).select("seed", "v.category_id")


TYPED = ("Notes on", "ㅂㅓㄷ", "버들", "choir of", "index database", "금리 정리", "미르재단의", "zzzz")


def by_prefix(posts: DataFrame, typed: str, most: int = 10) -> DataFrame:
    """Titles for what has been typed so far: all words of it if there are several, else the letters or the text they begin with.

    Text without a single word falls back to the prefix of the title as it is.
    """
    asked, low = S.words_of_query(typed), F.lower("title")
    if " " in typed.strip() and asked:
        found = posts.where(F.size(F.array_intersect(F.array(*[F.lit(w) for w in dict.fromkeys(asked)]), title_words())) == len(dict.fromkeys(asked)))
    elif re.search("[ㄱ-ㅎㅏ-ㅣ]", typed):
        found = posts.where(korean.decompose(low).startswith(typed.lower()))
    else:
        found = posts.where(low.startswith(typed.lower()))
    return found.orderBy(F.col("view_count").desc(), "id").limit(most).select(F.lit(typed).alias("typed"), "id", "title")


def _prefix_sql(typed: str) -> str:
    asked = list(dict.fromkeys(S.words_of_query(typed)))
    if " " in typed.strip() and asked:
        test = " AND ".join(f"list_contains({TITLE_SQL}, {markup.quoted(w)})" for w in asked)
    elif re.search("[ㄱ-ㅎㅏ-ㅣ]", typed):
        test = f"starts_with({korean.decompose_sql('lower(title)')}, {markup.quoted(typed.lower())})"
    else:
        test = f"starts_with(lower(title), {markup.quoted(typed.lower())})"
    return f"(SELECT {markup.quoted(typed)} AS typed, id, title FROM p WHERE {test} ORDER BY view_count DESC, id LIMIT 10)"


@registry.add("prefix_titles", f"WITH {POSTS} " + " UNION ALL ".join(map(_prefix_sql, TYPED)))
def prefix_titles(spark: SparkSession, folder: str) -> DataFrame:
    posts = current_posts(spark, folder, "title", "view_count")
    return reduce(DataFrame.unionByName, [by_prefix(posts, t) for t in TYPED])


ESCAPED = ("c++ (draft)", 'say "a+b" & c', 'open "quote+', "", "금리/세금", "a:b~2", "plain words")


@registry.add("escape_queries", "SELECT q AS query, escaped FROM (VALUES " + ", ".join(f"({markup.quoted(q)}, {markup.quoted(S.escape_query(q))})" for q in ESCAPED) + ") t(q, escaped)")
def escape_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Queries with the characters of the query syntax escaped outside of phrases, by one expression."""
    parts = F.regexp_extract_all("query", F.lit(r'"[^"]*"|[^"]+|"'), F.lit(0))
    escaped = F.transform(parts, lambda x: F.when((F.length(x) > 1) & x.startswith('"'), x).otherwise(F.regexp_replace(x, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")))
    return spark.createDataFrame([(q,) for q in ESCAPED], "query string").select("query", F.array_join(escaped, "").alias("escaped"))


@registry.add(
    "prefix_highlight",
    f"WITH {POSTS}, a(typed) AS (VALUES ('notes'), ('버들'), ('zzzz')) SELECT typed, id, substring(title, 1, length(typed)) AS marked, substring(title, length(typed) + 1) AS rest FROM p JOIN a ON starts_with(lower(title), typed)",
)
def prefix_highlight(spark: SparkSession, folder: str) -> DataFrame:
    """Suggested titles cut behind what has been typed, which is shown in bold."""
    posts = current_posts(spark, folder, "title")
    asked = F.array(*map(F.lit, ("notes", "버들", "zzzz")))
    rows = posts.select("id", "title", F.explode(F.filter(asked, lambda t: F.startswith(F.lower("title"), t))).alias("typed"))
    return rows.select("typed", "id", F.substring("title", F.lit(1), F.length("typed")).alias("marked"), F.substring("title", F.length("typed") + 1, F.length("title")).alias("rest"))


#: Queries of which two hold no word at all.
RAW = {1: "금리 세금", 2: "'", 3: "(", 4: "..."}


@registry.add(
    "search_fallback",
    f"WITH {POSTS}, {_values('w', [(1, t, 1.0) for t in S.words_of_query(RAW[1])])}, {_bm25('bt', TITLE_SQL, 'w')}, r AS (SELECT qid, id, score FROM bt UNION ALL "
    + " UNION ALL ".join(f"SELECT {q}, id, 1.0 FROM p WHERE starts_with(lower(title), {markup.quoted(t.lower())})" for q, t in RAW.items() if q > 1)
    + f"), {_top('r', 10)} SELECT qid, id, score, place FROM top",
)
def search_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Titles by the words of the query; a query of which no word is left is taken as the beginning of a title."""
    index = index_of(spark, folder)
    terms = [(q, t, 1.0) for q, text in RAW.items() for t in dict.fromkeys(S.words_of_query(text))]
    found = index.scored({"score": [("title", terms)]})
    bare = F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(t.lower()).alias("t")) for q, t in RAW.items() if not S.words_of_query(t)])
    hits = index.docs().select("id", F.explode(F.filter(bare, lambda b: F.startswith(F.lower("title"), b["t"]))).alias("b")).select("b.qid", "id", F.lit(1.0).alias("score"))
    return S.ranked(found.unionByName(hits), 10)


@registry.add(
    "index_document",
    f"""WITH {POSTS} SELECT p.id, title, lower(title) AS title_raw, {korean.decompose_sql('lower(title)')} AS title_jamo, array_to_string({GRAMS_SQL}, ' ') AS title_ngram, {markup.snippet_source_sql('content')} AS snippet_source,
category_id, coalesce(c.name, '기타') AS category, coalesce(blinded, false) AS blinded, epoch_us(created_at) // 1000 AS created_ms, array_to_string({markup.tags_sql('content')}, ' ') AS tags, greatest(view_count, 1) AS feature_views, greatest(like_count, 1) AS feature_likes
FROM p LEFT JOIN categories c ON p.category_id = c.id WHERE trim(coalesce(content, '')) <> ''""",
)
def index_document(spark: SparkSession, folder: str) -> DataFrame:
    """What the index stores of every post with content."""
    names = table(spark, folder, "categories").select(F.col("id").alias("category_id"), "name")
    posts = _docs(spark, folder).where(F.trim(F.coalesce("content", F.lit(""))) != "").join(names, "category_id", "left")
    return posts.select(
        "id", "title", F.lower("title").alias("title_raw"), korean.decompose(F.lower("title")).alias("title_jamo"), F.array_join(title_grams(), " ").alias("title_ngram"), markup.snippet_source(F.col("content")).alias("snippet_source"),
        "category_id", F.coalesce("name", F.lit("기타")).alias("category"), F.coalesce("blinded", F.lit(False)).alias("blinded"), F.unix_millis(F.col("created_at").cast("timestamp")).alias("created_ms"),
        F.array_join(markup.tags(F.col("content")), " ").alias("tags"), F.greatest("view_count", F.lit(1)).alias("feature_views"), F.greatest("like_count", F.lit(1)).alias("feature_likes"),
    )
