"""Queries of lists, pages, lookups, joins and hash sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moraine.functions import markup
from moraine.plans.common import HEADS, POSTS, current_posts
from moraine.plans.registry import Registry
from moraine.tables import table

registry = Registry()
LIST = ("title", "author_id", "category_id", "view_count", "like_count", "created_at")


def named(posts: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Posts with the nickname of the author (null if unknown) and the name of the category ('기타' if unknown)."""
    users = table(spark, folder, "users").select(F.col("id").alias("author_id"), "nickname")
    names = table(spark, folder, "categories").select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return posts.join(users, "author_id", "left").join(names, "category_id", "left").withColumn("category", F.coalesce("category", F.lit("기타")))


NAMED = "LEFT JOIN users u ON p.author_id = u.id LEFT JOIN categories c ON p.category_id = c.id"


@registry.add("post_list", f"WITH {HEADS} SELECT p.id, title, nickname, coalesce(c.name, '기타') AS category, view_count, like_count, p.created_at FROM p {NAMED}")
def post_list(spark: SparkSession, folder: str) -> DataFrame:
    return named(current_posts(spark, folder, *LIST), spark, folder).select("id", "title", "nickname", "category", "view_count", "like_count", "created_at")


@registry.add("post_detail", f"WITH {POSTS}, l AS (SELECT DISTINCT post_id FROM click_logs WHERE user_id % 7 = 0) SELECT p.id, title, content, nickname, coalesce(c.name, '기타') AS category, p.updated_at, l.post_id IS NOT NULL AS liked FROM p {NAMED} LEFT JOIN l ON p.id = l.post_id WHERE p.id % 50 = 0")
def post_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Full rows of the posts asked for, with whether the reader likes them."""
    asked = current_posts(spark, folder, *LIST, "content", "updated_at").where("id % 50 = 0")
    liked = table(spark, folder, "click_logs").where("user_id % 7 = 0").select(F.col("post_id").alias("id"), F.lit(True).alias("liked")).distinct()
    return named(asked, spark, folder).join(liked, "id", "left").select("id", "title", "content", "nickname", "category", "updated_at", F.coalesce("liked", F.lit(False)).alias("liked"))


@registry.add("recent_posts", f"WITH {HEADS} SELECT id, title, created_at FROM p ORDER BY created_at DESC, id DESC LIMIT 21 OFFSET 20")
def recent_posts(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of twenty, and one row more that tells whether a third follows."""
    return current_posts(spark, folder, "title", "created_at").orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(20).limit(21)


@registry.add("recent_posts_by_category", f"WITH {HEADS} SELECT category_id, id, created_at FROM p WHERE category_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY created_at DESC, id DESC) <= 20")
def recent_posts_by_category(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("category_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    posts = current_posts(spark, folder, "category_id", "created_at").where("category_id is not null")
    return posts.withColumn("place", F.row_number().over(order)).where("place <= 20").select("category_id", "id", "created_at")


@registry.add("deferred_join_page", f"WITH {POSTS}, i AS (SELECT id FROM p ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40) SELECT p.id, p.title, p.content, p.created_at FROM i JOIN p USING (id)")
def deferred_join_page(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of a page first, then their full rows."""
    ids = current_posts(spark, folder, "created_at").orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(40).limit(20).select("id")
    return current_posts(spark, folder, "title", "content", "created_at").join(F.broadcast(ids), "id").select("id", "title", "content", "created_at")


@registry.add("keyset_page", f"WITH {HEADS} SELECT id, title FROM p WHERE id > 700 ORDER BY id LIMIT 100")
def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "posts").where("id > 700")  # on the stored column, so that the scan skips
    newest = rows.groupBy("id").agg(F.max_by("title", F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")), "view_count")).alias("title"))
    return newest.orderBy("id").limit(100)


@registry.add("batch_lookup", f"WITH {HEADS}, k AS (SELECT DISTINCT post_id AS id FROM click_logs WHERE click_position = 0) SELECT p.id, title FROM p SEMI JOIN k USING (id)")
def batch_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Posts by a set of ids, missing ones left out."""
    ids = table(spark, folder, "click_logs").where("click_position = 0").select(F.col("post_id").alias("id"))
    return current_posts(spark, folder, "title").join(ids, "id", "left_semi")


@registry.add("point_lookup", f"WITH {POSTS} SELECT id, title, content FROM p WHERE id = 500")
def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "posts").where("id = 500")
    version = F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")), "view_count", "title", "content")
    return rows.groupBy("id").agg(F.max(version).alias("v")).select("id", "v.title", "v.content")


@registry.add("category_counts", f"WITH {HEADS} SELECT coalesce(c.name, '기타') AS category, count(*) AS posts FROM p LEFT JOIN categories c ON p.category_id = c.id GROUP BY 1")
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = current_posts(spark, folder, "category_id").groupBy("category_id").agg(F.count("*").alias("n"))
    names = table(spark, folder, "categories").select(F.col("id").alias("category_id"), "name")
    return counted.join(names, "category_id", "left").groupBy(F.coalesce("name", F.lit("기타")).alias("category")).agg(F.sum("n").alias("posts"))


@registry.add("root_categories", "SELECT id, name FROM categories WHERE parent_id IS NULL")
def root_categories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "categories").where("parent_id is null").select("id", "name")


@registry.add("category_children", "SELECT a.id AS parent, a.name AS parent_name, b.id, b.name FROM categories a JOIN categories b ON b.parent_id = a.id")
def category_children(spark: SparkSession, folder: str) -> DataFrame:
    all_of = table(spark, folder, "categories")
    parents = all_of.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return all_of.where("parent_id is not null").join(parents, F.col("parent_id") == F.col("parent")).select("parent", "parent_name", "id", "name")


@registry.add("category_delete", "SELECT id, name FROM categories WHERE name NOT IN ('그 밖', '새 소식', '웹에서 모음')")
def category_delete(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "categories").where(~F.col("name").isin("그 밖", "새 소식", "웹에서 모음")).select("id", "name")


@registry.add("author_names", f"WITH {HEADS} SELECT a.author_id, u.nickname FROM (SELECT DISTINCT author_id FROM p) a LEFT JOIN users u ON a.author_id = u.id")
def author_names(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "users").select(F.col("id").alias("author_id"), "nickname")
    return current_posts(spark, folder, "author_id").select("author_id").distinct().join(users, "author_id", "left")


@registry.add("names_available", "SELECT DISTINCT lower(u.username) || '_x' AS name FROM users u ANTI JOIN (SELECT nickname FROM users) n ON lower(u.username) || '_x' = n.nickname")
def names_available(spark: SparkSession, folder: str) -> DataFrame:
    """Wished names that no nickname takes."""
    users = table(spark, folder, "users")
    wished = users.select(F.concat(F.lower("username"), F.lit("_x")).alias("name")).distinct()
    return wished.join(users.select(F.col("nickname").alias("name")), "name", "left_anti")


@registry.add("id_allocation", "SELECT count(*) AS rows, coalesce(max(id), 0) + 1 AS next_id FROM posts")
def id_allocation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "posts").agg(F.count("*").alias("rows"), (F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


USERNAME, NICKNAME = "^[A-Za-z][A-Za-z0-9_.]{3,29}$", "^.{2,12}$"


@registry.add("input_validation", f"SELECT id, regexp_matches(username, '{USERNAME}') AND regexp_matches(coalesce(nickname, ''), '{NICKNAME}') AS valid FROM users")
def input_validation(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "users").select("id", (F.col("username").rlike(USERNAME) & F.coalesce("nickname", F.lit("")).rlike(NICKNAME)).alias("valid"))


NODES, VIRTUAL = 3, 150


def ring_place(key: Column) -> Column:
    """Place of a key on the ring: the first 32 bits of its digest."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def node_of(place: Column, ring: list[tuple[int, int]]) -> Column:
    """The node at the first place of the sorted ring that isn't before the key's, or the first node of all."""
    points = F.array(*[F.struct(F.lit(p).cast("bigint").alias("place"), F.lit(n).alias("node")) for p, n in ring])
    return F.coalesce(F.get(F.filter(points, lambda x: x["place"] >= place), F.lit(0))["node"], F.lit(ring[0][1]))


RING = "r AS (SELECT n AS node, CAST('0x' || substring(md5('node' || n || '#' || v), 1, 8) AS BIGINT) AS place FROM range(3) a(n), range(150) b(v))"


@registry.add("ring_lookup", f"WITH {RING}, k AS (SELECT DISTINCT username AS key, CAST('0x' || substring(md5(username), 1, 8) AS BIGINT) AS spot FROM users), h AS (SELECT key, min(place) AS place FROM k LEFT JOIN r ON place >= spot GROUP BY key) SELECT key, CAST(coalesce(arg_min(r.node, r.node), (SELECT arg_min(node, place) FROM r)) AS INT) AS node FROM h LEFT JOIN r ON h.place = r.place GROUP BY key")
def ring_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every user on a ring of three nodes with 150 virtual places each."""
    import hashlib

    ring = sorted((int(hashlib.md5(f"node{n}#{v}".encode()).hexdigest()[:8], 16), n) for n in range(NODES) for v in range(VIRTUAL))
    keys = table(spark, folder, "users").select(F.col("username").alias("key")).distinct()
    return keys.select("key", node_of(ring_place(F.col("key")), ring).cast("int").alias("node"))


@registry.add("operational_top", """SELECT query, count(*) AS calls, CAST(sum(coalesce(dwell_time_ms, 0)) AS BIGINT) AS total_ms, round(sum(coalesce(dwell_time_ms, 0)) / CAST(nullif(count(*), 0) AS DOUBLE), 2) AS avg_ms, substring(query, 1, 20) AS digest
FROM click_logs WHERE query LIKE '%a%' AND query NOT LIKE 'z%' GROUP BY query ORDER BY total_ms DESC, query LIMIT 10""")
def operational_top(spark: SparkSession, folder: str) -> DataFrame:
    """The ten groups with the highest total time."""
    ms = F.coalesce("dwell_time_ms", F.lit(0))
    rows = table(spark, folder, "click_logs").where(F.col("query").like("%a%") & ~F.col("query").like("z%"))
    out = rows.groupBy("query").agg(F.count("*").alias("calls"), F.sum(ms).alias("total_ms"), F.round(F.try_divide(F.sum(ms), F.count("*")), 2).alias("avg_ms"))
    return out.withColumn("digest", F.substring("query", 1, 20)).orderBy(F.col("total_ms").desc(), "query").limit(10)


@registry.add("scalar_ratio", "SELECT round((1 - (SELECT count(*) FROM click_logs WHERE dwell_time_ms IS NULL) / CAST(nullif((SELECT count(*) FROM click_logs), 0) AS DOUBLE)) * 100, 4) AS percent")
def scalar_ratio(spark: SparkSession, folder: str) -> DataFrame:
    # both counts come from one scan
    return table(spark, folder, "click_logs").agg(F.round((1 - F.try_divide(F.count_if(F.col("dwell_time_ms").isNull()), F.count("*"))) * 100, 4).alias("percent"))


@registry.add("cache_keys", "SELECT DISTINCT 'search:' || query || ':all:0:20' AS key, 'rag:' || lower(trim(query)) AS summary_key FROM search_logs WHERE query IS NOT NULL")
def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("query")
    logs = table(spark, folder, "search_logs").where(q.isNotNull())
    return logs.select(F.concat_ws(":", F.lit("search"), q, F.lit("all"), F.lit("0"), F.lit("20")).alias("key"), F.concat(F.lit("rag:"), F.lower(F.trim(q))).alias("summary_key")).distinct()


@registry.add("doc_snippet_json", f"WITH {POSTS} SELECT id, CAST(to_json(struct_pack(id := id, title := title, snippet := {markup.snippet_sql('content')})) AS VARCHAR) AS doc FROM p WHERE title IS NOT NULL")
def doc_snippet_json(spark: SparkSession, folder: str) -> DataFrame:
    posts = current_posts(spark, folder, "title", "content").where("title is not null")
    return posts.select("id", F.to_json(F.struct("id", "title", markup.snippet(F.col("content")).alias("snippet"))).alias("doc"))
