"""Queries of search, click and view logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import korean
from moraine.operators import logs as L
from moraine.plans.common import HEADS, LOGS_AS_OF, as_of, current_posts
from moraine.plans.registry import Registry
from moraine.tables import table

registry = Registry()

LOGS = """l AS (SELECT DISTINCT id, lower(trim(query, ' ' || chr(9) || chr(10) || chr(13))) AS query, time_bucket, "count" AS n FROM search_logs WHERE "count" > 0 AND trim(query, ' ' || chr(9) || chr(10) || chr(13)) <> '')"""
WEEK = f"TIMESTAMP '{LOGS_AS_OF}' - INTERVAL 7 DAY"
CLICKS = "c AS (SELECT DISTINCT * FROM click_logs)"


def logs(spark: SparkSession, folder: str) -> DataFrame:
    return L.deliveries(table(spark, folder, "search_logs"))


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "click_logs").distinct()


def week_ago():
    return as_of(LOGS_AS_OF) - F.expr("INTERVAL 7 DAYS")


@registry.add("search_log_buckets", f"WITH {LOGS} SELECT query, date_trunc('hour', time_bucket) AS bucket, CAST(sum(n) AS BIGINT) AS total FROM l GROUP BY ALL")
def search_log_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return L.hourly(logs(spark, folder))


@registry.add("query_counts", f"WITH {LOGS} SELECT query, count(*) AS lines FROM l GROUP BY query")
def query_counts(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).groupBy("query").agg(F.count("*").alias("lines"))


@registry.add("top_queries_7d", f"WITH {LOGS} SELECT query, CAST(sum(n) AS BIGINT) AS total, max(time_bucket) AS last_bucket FROM l WHERE time_bucket >= {WEEK} GROUP BY query ORDER BY total DESC, query LIMIT 50")
def top_queries_7d(spark: SparkSession, folder: str) -> DataFrame:
    return L.top_queries(logs(spark, folder), week_ago(), 50)


PREFIX_SQL = f"""t AS (SELECT query, CAST(sum(n) AS BIGINT) AS total FROM l WHERE time_bucket >= {WEEK} GROUP BY query ORDER BY total DESC, query LIMIT 10000),
f AS (SELECT query, total, query AS form, 1 AS least FROM t UNION ALL SELECT query, total, {korean.decompose_sql('query')}, 1 FROM t UNION ALL SELECT query, total, {korean.initials_sql('query')}, 2 FROM t),
x AS (SELECT DISTINCT query, total, substring(form, 1, k) AS prefix FROM (SELECT *, unnest(generate_series(1, least(length(form), 10))) AS k FROM f WHERE length(form) >= least)),
pt AS (SELECT prefix, query, total, row_number() OVER (PARTITION BY prefix ORDER BY total DESC, query) AS place FROM x QUALIFY place <= 10)"""


def published(spark: SparkSession, folder: str) -> DataFrame:
    # the reference's own bound: the 10,000 most frequent queries of the week
    return L.prefix_top(L.top_queries(logs(spark, folder), week_ago(), 10_000).select("query", "total"))


@registry.add("autocomplete_topk", f"WITH {LOGS}, {PREFIX_SQL} SELECT prefix, query, total, place FROM pt")
def autocomplete_topk(spark: SparkSession, folder: str) -> DataFrame:
    return published(spark, folder).select("prefix", "query", "total", "place")


ASKED = ("재", "ㅈㅁ", "안방", "lim", "ㅂㅓㄷ", "두레", "zzz", "database in")
ASKED_SQL = "a(asked) AS (VALUES " + ", ".join(f"('{x}')" for x in ASKED) + ")"
BANNED = "b AS (SELECT DISTINCT lower(trim(word)) AS word, regexp_matches(trim(word), '[가-힣]') AS hangul FROM banned_words WHERE length(trim(word)) >= 2)"
IS_BANNED = "((hangul AND contains(query, word)) OR (NOT hangul AND regexp_matches(query, '(^|[^a-z0-9_])' || word || '($|[^a-z0-9_])')))"


@registry.add("autocomplete_serve", f"WITH {LOGS}, {PREFIX_SQL}, {ASKED_SQL}, k AS (SELECT asked, CASE WHEN {korean.has_letters_sql('asked')} THEN {korean.decompose_sql('asked')} ELSE lower(asked) END AS prefix FROM a) SELECT asked, query, total, place FROM k JOIN pt USING (prefix)")
def autocomplete_serve(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions for typed prefixes: by letters if single letters are among them."""
    asked = spark.createDataFrame([(x,) for x in ASKED], "asked string")
    key = F.when(korean.has_letters(F.col("asked")), korean.decompose(F.col("asked"))).otherwise(F.lower("asked"))
    return published(spark, folder).join(F.broadcast(asked.withColumn("prefix", key)), "prefix").select("asked", "query", "total", "place")


def banned(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "banned_words").select(F.lower(F.trim("word")).alias("word")).where(F.length("word") >= 2).distinct()
    return words.withColumn("hangul", F.col("word").rlike("[가-힣]"))


#: Listed words up to which one pattern tests a text; more are looked up in a table.
PATTERN_WORDS = 1000
BOUND = "(^|[^a-z0-9_])", "($|[^a-z0-9_])"


def with_banned(rows: DataFrame, words: DataFrame, column: str = "query", flag: str = "is_banned", most: int = PATTERN_WORDS) -> DataFrame:
    """Rows with a flag: whether the text holds a listed word, Korean ones anywhere, others as whole words.

    A short list becomes two patterns. A longer one stays a table: of every different text the substrings that are
    as long as some listed word are looked up in it, so the work grows with the text and not with the list.
    """
    listed = words.limit(most + 1).collect()
    if len(listed) <= most:
        quoted = lambda w: r"\Q" + w + r"\E"
        inside = "|".join(sorted(quoted(r["word"]) for r in listed if r["hangul"])) or "(?!)"
        whole = "|".join(sorted(quoted(r["word"]) for r in listed if not r["hangul"])) or "(?!)"
        return rows.withColumn(flag, F.coalesce(F.col(column).rlike(inside) | F.col(column).rlike(f"{BOUND[0]}({whole}){BOUND[1]}"), F.lit(False)))
    text = F.col("_text")
    lengths = F.array(*[F.lit(r[0]) for r in words.select(F.length("word")).distinct().collect()])  # one row a length of words
    starts = lambda n: F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.flatten(F.transform(lengths, lambda n: F.transform(starts(n), lambda i: F.struct(F.substring(text, i, n).alias("word"), F.substring(text, i - 1, F.when(i > 1, 1).otherwise(0)).alias("before"), F.substring(text, i + n, F.lit(1)).alias("after")))))
    texts = rows.select(F.col(column).alias("_text")).where("_text is not null").distinct()
    apart = ~F.col("p.before").rlike("[a-z0-9_]") & ~F.col("p.after").rlike("[a-z0-9_]")
    held = texts.select("_text", F.explode(pieces).alias("p")).select("_text", F.col("p.word").alias("word"), apart.alias("apart")).join(words, "word").where("hangul or apart").select(F.col("_text").alias(column)).distinct()
    return rows.join(held.withColumn(flag, F.lit(True)), column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def without_banned(rows: DataFrame, words: DataFrame, column: str = "query") -> DataFrame:
    """Rows whose text holds no listed word."""
    return with_banned(rows, words, column, "_banned").where("not _banned").select(*rows.columns)


@registry.add("banned_filter", f"WITH {LOGS}, {BANNED} SELECT DISTINCT query FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE {IS_BANNED})")
def banned_filter(spark: SparkSession, folder: str) -> DataFrame:
    return without_banned(logs(spark, folder).select("query").distinct(), banned(spark, folder))


@registry.add("autocomplete_filtered", f"WITH {LOGS}, {PREFIX_SQL}, {BANNED} SELECT prefix, query, place FROM pt WHERE length(prefix) <= 2 AND NOT EXISTS (SELECT 1 FROM b WHERE {IS_BANNED})")
def autocomplete_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return without_banned(published(spark, folder).where(F.length("prefix") <= 2).select("prefix", "query", "place"), banned(spark, folder))


@registry.add("autocomplete_filtered_all", f"WITH {LOGS}, {PREFIX_SQL}, {BANNED}, g AS (SELECT query FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE {IS_BANNED})) SELECT prefix, query, place FROM pt SEMI JOIN g USING (query)")
def autocomplete_filtered_all(spark: SparkSession, folder: str) -> DataFrame:
    """Suggestions for prefixes of all lengths, without the banned ones."""
    return without_banned(published(spark, folder).select("prefix", "query", "place"), banned(spark, folder))


@registry.add("log_retention", f"SELECT count(*) AS kept FROM search_logs WHERE time_bucket >= TIMESTAMP '{LOGS_AS_OF}' - INTERVAL 30 DAY")
def log_retention(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_logs").where(F.col("time_bucket") >= as_of(LOGS_AS_OF) - F.expr("INTERVAL 30 DAYS")).agg(F.count("*").alias("kept"))


@registry.add("click_retention", f"WITH {CLICKS} SELECT id, query, created_at FROM c WHERE created_at >= TIMESTAMP '{LOGS_AS_OF}' - INTERVAL 30 DAY")
def click_retention(spark: SparkSession, folder: str) -> DataFrame:
    return clicks(spark, folder).where(F.col("created_at") >= as_of(LOGS_AS_OF) - F.expr("INTERVAL 30 DAYS")).select("id", "query", "created_at")


@registry.add("view_count_flush", f"WITH {HEADS}, {CLICKS}, d AS (SELECT post_id, count(*) AS delta FROM c GROUP BY post_id) SELECT p.id, coalesce(view_count, 0) + coalesce(delta, 0) AS view_count FROM p LEFT JOIN d ON p.id = d.post_id")
def view_count_flush(spark: SparkSession, folder: str) -> DataFrame:
    """View counts with the clicks since the last flush added; deltas are counted before the join."""
    delta = clicks(spark, folder).groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("delta"))
    posts = current_posts(spark, folder, "view_count").join(delta, "id", "left")
    return posts.select("id", (F.coalesce("view_count", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("view_count"))


@registry.add("like_counts", f"WITH {CLICKS} SELECT post_id, count(DISTINCT user_id) AS likes FROM c WHERE user_id IS NOT NULL AND dwell_time_ms >= 30000 GROUP BY post_id")
def like_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users of a post; a long visit stands for a like."""
    return clicks(spark, folder).where("user_id is not null and dwell_time_ms >= 30000").groupBy("post_id").agg(F.countDistinct("user_id").alias("likes"))


@registry.add("like_state", f"WITH {HEADS} SELECT id, CASE WHEN like_count > 0 THEN like_count - 1 ELSE like_count END AS like_count FROM p")
def like_state(spark: SparkSession, folder: str) -> DataFrame:
    """One like taken back from every post, never below zero."""
    n = F.col("like_count")
    return current_posts(spark, folder, "like_count").select("id", F.when(n > 0, n - 1).otherwise(n).alias("like_count"))


@registry.add("has_liked", f"WITH {HEADS}, {CLICKS} SELECT p.id, EXISTS (SELECT 1 FROM c WHERE c.post_id = p.id AND c.user_id % 7 = 0) AS liked FROM p")
def has_liked(spark: SparkSession, folder: str) -> DataFrame:
    mine = clicks(spark, folder).where("user_id % 7 = 0").select(F.col("post_id").alias("id"), F.lit(True).alias("liked")).distinct()
    return current_posts(spark, folder).join(mine, "id", "left").select("id", F.coalesce("liked", F.lit(False)).alias("liked"))


@registry.add("latest_click_dwell", f"WITH {CLICKS} SELECT session_id, post_id, created_at, id, query, click_position, dwell_time_ms FROM c WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, post_id ORDER BY created_at DESC, id DESC) = 1")
def latest_click_dwell(spark: SparkSession, folder: str) -> DataFrame:
    return L.latest_click(clicks(spark, folder))


GRADE_SQL = "CASE WHEN coalesce(dwell_time_ms, -1) < 0 AND click_position <= 3 THEN 0 WHEN coalesce(dwell_time_ms, -1) < 0 THEN NULL WHEN dwell_time_ms > 120000 THEN 3 WHEN dwell_time_ms >= 30000 THEN 2 WHEN dwell_time_ms >= 10000 THEN 1 ELSE 0 END"


@registry.add("dwell_grade", f"WITH {CLICKS} SELECT id, {GRADE_SQL} AS grade FROM c")
def dwell_grade(spark: SparkSession, folder: str) -> DataFrame:
    return clicks(spark, folder).select("id", L.dwell_grade(F.col("dwell_time_ms"), F.col("click_position")).alias("grade"))


@registry.add("short_dwell_drop", f"WITH {CLICKS} SELECT id, dwell_time_ms FROM c WHERE dwell_time_ms >= 500")
def short_dwell_drop(spark: SparkSession, folder: str) -> DataFrame:
    return clicks(spark, folder).where("dwell_time_ms >= 500").select("id", "dwell_time_ms")


@registry.add("rate_limit_window", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 10")
def rate_limit_window(spark: SparkSession, folder: str) -> DataFrame:
    return L.rate_limited(table(spark, folder, "events"), "user_id", "ts", "event_id").select("event_id", "user_id")


@registry.add("latency_summary", f"""WITH {CLICKS}, s AS (SELECT click_position, dwell_time_ms AS ms, row_number() OVER (PARTITION BY click_position ORDER BY dwell_time_ms) - 1 AS i, count(*) OVER (PARTITION BY click_position) AS n FROM c WHERE dwell_time_ms >= 0)
SELECT click_position, round(avg(ms), 3) AS mean, max(CASE WHEN i = n // 2 THEN ms END) AS p50, max(CASE WHEN i = least(CAST(floor(0.95 * n) AS BIGINT), n - 1) THEN ms END) AS p95 FROM s GROUP BY click_position""")
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, median and 95th percentile of dwell by position, the percentiles as the values at those places.

    Values are counted first: a place is found in the running count of the distinct values.
    """
    from pyspark.sql import Window

    rows = clicks(spark, folder).where("dwell_time_ms >= 0").groupBy("click_position", F.col("dwell_time_ms").alias("ms")).agg(F.count("*").alias("k"))
    key = Window.partitionBy("click_position")
    run = rows.withColumn("upto", F.sum("k").over(key.orderBy("ms"))).withColumn("n", F.sum("k").over(key))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("ms")))
    mean = F.round(F.sum(F.col("ms") * F.col("k")) / F.sum("k"), 3).alias("mean")
    return run.groupBy("click_position").agg(mean, at(F.floor(F.col("n") / 2)).alias("p50"), at(F.least(F.floor(F.lit(0.95) * F.col("n")), F.col("n") - 1)).alias("p95"))


@registry.add("feedback_counters", f"WITH {CLICKS} SELECT query, count(*) FILTER (WHERE dwell_time_ms >= 30000) AS up, count(*) FILTER (WHERE coalesce(dwell_time_ms, 0) < 30000) AS down FROM c GROUP BY query")
def feedback_counters(spark: SparkSession, folder: str) -> DataFrame:
    return clicks(spark, folder).groupBy("query").agg(F.count_if(F.col("dwell_time_ms") >= 30000).alias("up"), F.count_if(F.coalesce("dwell_time_ms", F.lit(0)) < 30000).alias("down"))


@registry.add("click_positions", f"WITH {CLICKS} SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) - 1 AS position FROM c WHERE session_id IS NOT NULL")
def click_positions(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    return clicks(spark, folder).where("session_id is not null").select("session_id", "id", (F.row_number().over(order) - 1).cast("bigint").alias("position"))
