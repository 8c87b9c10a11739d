"""Queries of imports, dictionaries and index maintenance; files go through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.functions import markup, words
from moraine.operators import maintenance as M
from moraine.operators import search
from moraine.operators.numbering import numbered
from moraine.operators.stored import Index
from moraine.plans.changes import MESSAGES
from moraine.plans.common import HEADS, POSTS, current_posts
from moraine.plans.registry import Registry
from moraine.plans.search import TEXT_SQL, TITLE_SQL, _docs as full_docs, _top, fields, sourced, stored, text_scores
from moraine.sources import dumps
from moraine.storage import fresh_path
from moraine.streaming import cdc
from moraine.tables import table

registry = Registry()


@registry.add("xml_dump_scan", f"WITH {POSTS} SELECT id, title, CAST(0 AS INT) AS namespace, content, date_trunc('second', created_at) AS created_at FROM p WHERE title IS NOT NULL")
def xml_dump_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Posts written as a dump of pages with two revisions and read back."""
    path = fresh_path(spark, "dump")
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisions = F.array(F.struct((F.col("id") * 2).alias("id"), stamp.alias("timestamp"), F.lit("first").alias("text")), F.struct((F.col("id") * 2 + 1).alias("id"), F.lit("2030-01-01T00:00:00Z").alias("timestamp"), F.col("content").alias("text")))
    pages = current_posts(spark, folder, "title", "content", "created_at").select("id", "title", F.lit(0).alias("ns"), revisions.alias("revision"))
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return dumps.mediawiki(spark, path).select("id", "title", "namespace", "content", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@registry.add("wiki_json_scan", f"WITH {POSTS} SELECT title, CAST(id % 2 AS INT) AS namespace, content, nullif(trim(regexp_extract(trim(content), '(?i)#(?:redirect|넘겨주기)\\s+(.+)', 1)), '') AS redirect_to FROM p WHERE title IS NOT NULL")
def wiki_json_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "articles")
    posts = current_posts(spark, folder, "title", "content")
    posts.select((F.col("id") % 2).cast("int").alias("namespace"), "title", F.col("content").alias("text"), F.array(F.lit("x")).alias("contributors")).write.json(path)
    return dumps.wiki_json(spark, path, multi_line=False)


@registry.add("wiki_json_numbers", f"WITH {HEADS} SELECT count(*) AS articles, count(*) AS numbers, CAST(1 AS BIGINT) AS lowest, count(*) AS highest FROM p WHERE title IS NOT NULL")
def wiki_json_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Running ids for articles that have a title."""
    titled = current_posts(spark, folder, "title").where("title is not null")
    return numbered(titled, ["title", "id"], "number").agg(F.count("*").alias("articles"), F.countDistinct("number").alias("numbers"), F.min("number").alias("lowest"), F.max("number").alias("highest"))


@registry.add("two_column_scan", "SELECT coalesce(title, '') AS title, coalesce(text, '') AS text, CAST(0 AS INT) AS namespace FROM documents")
def two_column_scan(spark: SparkSession, folder: str) -> DataFrame:
    return dumps.two_columns(spark, f"{folder}/documents.parquet")


LINES = """n AS (SELECT id // 200 AS file, id, '제목: ' || coalesce(title, '') AS head, string_split(content, chr(10)) AS ps FROM p),
li AS (SELECT file, id * 10000 AS row, head AS line FROM n UNION ALL SELECT file, id * 10000 + k, CASE WHEN k = 1 THEN '내용: ' ELSE '' END || ps[k] FROM (SELECT *, unnest(generate_series(1, len(ps))) AS k FROM n))"""


@registry.add(
    "news_regroup",
    f"""WITH {POSTS}, {LINES}, s AS (SELECT file, row, trim(line) AS line, starts_with(trim(line), '제목:') AS begins, sum(CAST(starts_with(trim(line), '제목:') AS INT)) OVER (PARTITION BY file ORDER BY row) AS island FROM li),
a AS (SELECT file, island, substring(max(CASE WHEN begins THEN trim(substring(line, 4)) END), 1, 512) AS title, string_agg(CASE WHEN NOT begins AND trim(regexp_replace(line, '^내용:', '')) <> '' THEN trim(regexp_replace(line, '^내용:', '')) END, chr(10) || chr(10) ORDER BY row) AS body FROM s WHERE island > 0 GROUP BY ALL)
SELECT title, body FROM a WHERE title <> '' AND length(body) >= 50""",
)
def news_regroup(spark: SparkSession, folder: str) -> DataFrame:
    """Posts written out as news lines and put together again."""
    posts = current_posts(spark, folder, "title", "content").withColumn("file", F.floor(F.col("id") / 200))
    head = posts.select("file", (F.col("id") * 10_000).alias("row"), F.concat(F.lit("제목: "), F.coalesce("title", F.lit(""))).alias("line"))
    rest = posts.select("file", "id", F.posexplode(F.split("content", "\n")).alias("k", "line"))
    rest = rest.select("file", (F.col("id") * 10_000 + F.col("k") + 1).alias("row"), F.concat(F.when(F.col("k") == 0, "내용: ").otherwise(""), "line").alias("line"))
    return dumps.articles_of_lines(head.unionByName(rest)).select("title", "body")


@registry.add("webtext_import", f"SELECT doc_id, t.title AS new_title, t.body AS body FROM (SELECT doc_id, {words.title_parts_sql('text')} AS t FROM documents WHERE length(text) >= 100) WHERE t.title <> '' AND length(t.body) >= 50")
def webtext_import(spark: SparkSession, folder: str) -> DataFrame:
    return dumps.titled_texts(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "new_title", "body")


@registry.add("word_list_scan", "SELECT DISTINCT trim(word) AS word FROM banned_words WHERE trim(word) <> '' AND NOT starts_with(trim(word), '#')")
def word_list_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "words")
    rows = table(spark, folder, "banned_words").select(F.col("word").alias("value"))
    rows.unionByName(spark.createDataFrame([("# a comment",), ("",), ("  ",)], "value string")).write.text(path)
    return dumps.word_list(spark, path)


@registry.add("bulk_insert", f"WITH {POSTS} SELECT id, substring(title, 1, 512) AS title, 1 + id % 100000 AS author_id, CAST(0 AS BIGINT) AS view_count, coalesce(updated_at, TIMESTAMP '2025-01-01') AS created_at FROM p WHERE trim(coalesce(content, '')) <> ''")
def bulk_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as an import writes them: cut titles, assigned authors, counters at zero."""
    path = fresh_path(spark, "posts")
    posts = current_posts(spark, folder, "title", "content", "updated_at").where(F.trim(F.coalesce("content", F.lit(""))) != "")
    created = F.coalesce("updated_at", F.lit("2025-01-01").cast("timestamp_ntz"))
    posts.select("id", F.substring("title", 1, 512).alias("title"), (1 + F.col("id") % 100_000).alias("author_id"), F.lit(0).cast("bigint").alias("view_count"), created.alias("created_at")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


TAGS = f"g AS (SELECT id, unnest({markup.tags_sql('content')}) AS tag FROM p)"


def post_tags(spark: SparkSession, folder: str) -> DataFrame:
    return current_posts(spark, folder, "content").select("id", F.explode(markup.tags(F.col("content"))).alias("tag"))


@registry.add("insert_ignore_tags", f"WITH {POSTS}, {TAGS} SELECT DISTINCT id, tag FROM g")
def insert_ignore_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of post and tag after an import that meets pairs already stored."""
    pairs = post_tags(spark, folder)
    stored = pairs.where("id % 2 = 0").distinct()
    return stored.unionByName(pairs.distinct().join(stored, ["id", "tag"], "left_anti"))


@registry.add("tag_lists", f"WITH {POSTS}, {TAGS} SELECT id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM g GROUP BY id")
def tag_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of every post by way of the dictionary."""
    pairs = post_tags(spark, folder).distinct()
    names = numbered(pairs.select("tag").distinct(), ["tag"], "tag_id")
    bridge = pairs.join(names, "tag").select("id", "tag_id")
    return bridge.join(names, "tag_id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), "|").alias("tags"))


@registry.add(
    "tag_dictionary",
    f"WITH {POSTS}, {TAGS}, o AS (SELECT tag, row_number() OVER (ORDER BY tag) AS tag_id FROM (SELECT DISTINCT tag FROM g WHERE id % 2 = 0)), n AS (SELECT tag, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY tag) AS tag_id FROM (SELECT DISTINCT tag FROM g WHERE tag NOT IN (SELECT tag FROM o))) SELECT substring(tag, 1, 255) AS tag, tag_id FROM (SELECT * FROM o UNION ALL SELECT * FROM n)",
)
def tag_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of tags: those of a first import stay, new tags get the next numbers."""
    pairs = post_tags(spark, folder).select("id", F.substring("tag", 1, 255).alias("tag"))
    old = numbered(pairs.where("id % 2 = 0").select("tag").distinct(), ["tag"], "tag_id")
    next_id = (old.agg(F.max("tag_id")).first()[0] or 0) + 1
    new = pairs.select("tag").distinct().join(old.select("tag"), "tag", "left_anti")
    return old.unionByName(numbered(new, ["tag"], "tag_id", next_id))


@registry.add("index_build", f"WITH {POSTS}, t AS (SELECT id, 'title' AS field, unnest({words.tokens_sql('title')}) AS term FROM p WHERE trim(coalesce(content, '')) <> '' UNION ALL SELECT id, 'content', unnest({words.tokens_sql('content')}) FROM p WHERE trim(coalesce(content, '')) <> '') SELECT field, count(DISTINCT (term, id)) AS postings, count(DISTINCT term) AS terms, count(*) AS occurrences FROM t GROUP BY field")
def index_build(spark: SparkSession, folder: str) -> DataFrame:
    """All fields of the posts with content, written as they are for search."""
    docs = full_docs(spark, folder).where(F.trim(F.coalesce("content", F.lit(""))) != "")
    index = Index(spark, fresh_path(spark, "index"), fields(), stored()).create(sourced(docs))
    rows = index.postings(fields=["title", "content"])
    return rows.groupBy("field").agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"), F.sum("tf").alias("occurrences"))


@registry.add("search_stored_index", f"WITH {POSTS}, {TEXT_SQL}, {_top('tx', 10)} SELECT qid, id, score, place FROM top")
def search_stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """The batch of queries answered from an index that has just been built and compacted."""
    title_and_content = {k: v for k, v in fields().items() if k in ("title", "content")}
    built = Index(spark, fresh_path(spark, "index"), title_and_content).create(current_posts(spark, folder, "title", "content"))
    return search.ranked(text_scores(built.compact(fresh_path(spark, "index"))), 10)


@registry.add("index_upsert", f"WITH {POSTS} SELECT id, title, CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN 'new text ' || id ELSE content END AS content FROM p UNION ALL SELECT id + 10000000, title, 'added' FROM p WHERE id % 100 = 0")
def index_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Changed posts replace the old, blank ones leave them, unknown ones are added."""
    base = current_posts(spark, folder, "title", "content")
    text = F.when(F.col("id") % 10 == 0, "  ").otherwise(F.concat(F.lit("new text "), F.col("id").cast("string")))
    changed = base.where("id % 5 = 0").select("id", "title", text.alias("content"))
    added = base.where("id % 100 = 0").select((F.col("id") + 10_000_000).alias("id"), "title", F.lit("added").alias("content"))
    return M.upserted(base, changed.unionByName(added))


FED = f"""d AS (SELECT post_id AS id, json_extract_string(st.image, '$.title') AS title, json_extract_string(st.image, '$.content') AS content FROM s WHERE NOT st.deleted),
t AS (SELECT id, 'title' AS field, unnest({words.tokens_sql('title')}) AS term FROM d UNION ALL SELECT id, 'content', unnest({words.tokens_sql('content')}) FROM d)"""


def fed_index(spark: SparkSession, folder: str, batches: int = 3) -> Index:
    """An index that starts empty and follows the change feed, one segment a micro-batch."""
    only = {k: v for k, v in fields().items() if k in ("title", "content")}
    docs = "id BIGINT, title STRING, content STRING"
    index = Index(spark, fresh_path(spark, "fed-index"), only).create(spark.createDataFrame([], docs), 0)

    def follow(states: DataFrame, batch: int) -> None:
        there = states.where("not deleted").select(F.from_json("payload", docs).alias("d")).select("d.*")
        index.apply(there, states.where("deleted").select(F.col("post_id").alias("id")), batch + 1)

    cdc.ChangeTable(spark, fresh_path(spark, "changes")).apply(cdc.pieces(spark, folder, batches), follow)
    return index


@registry.add("index_feed_terms", f"{MESSAGES.rstrip()}, {FED} SELECT field, term, count(DISTINCT id) AS df, count(*) AS cf FROM t GROUP BY ALL")
def index_feed_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and occurrences of every term in an index that has followed the feed through several micro-batches."""
    return fed_index(spark, folder).postings().groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@registry.add("index_feed_stats", f"{MESSAGES.rstrip()}, {FED}, l AS (SELECT field, id, count(*) AS dl FROM t GROUP BY ALL) SELECT field, count(*) AS n, round(avg(dl), 6) AS avgdl FROM l GROUP BY field")
def index_feed_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that the segments of such an index have added up."""
    return fed_index(spark, folder).stats().select("field", "n", F.round("avgdl", 6).alias("avgdl"))


@registry.add("index_delete", f"WITH {HEADS} SELECT id, title FROM p WHERE id NOT IN (SELECT post_id FROM click_logs WHERE click_position = 0)")
def index_delete(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "click_logs").where("click_position = 0").select(F.col("post_id").alias("id"))
    return M.deleted(current_posts(spark, folder, "title"), gone)


@registry.add("reindex_report", f"WITH {HEADS}, a AS (SELECT DISTINCT post_id AS id FROM click_logs) SELECT a.id, CASE WHEN p.id IS NULL THEN 'not found' ELSE 'indexed' END AS state FROM a LEFT JOIN p USING (id)")
def reindex_report(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "click_logs").select(F.col("post_id").alias("id"))
    return M.report(asked, current_posts(spark, folder))


@registry.add("snapshot_read", f"WITH {HEADS} SELECT id, view_count + 1 AS view_count FROM p")
def snapshot_read(spark: SparkSession, folder: str) -> DataFrame:
    """The version that the pointer names after two have been published."""
    store = M.Snapshots(spark, fresh_path(spark, "snapshots"))
    posts = current_posts(spark, folder, "view_count")
    store.publish(posts, 1)
    store.publish(store.read(1).withColumn("view_count", F.col("view_count") + 1), 2)
    return store.read()


@registry.add("csv_resume", f"WITH {HEADS} SELECT id, title FROM p WHERE id % 3 <> 0")
def csv_resume(spark: SparkSession, folder: str) -> DataFrame:
    """Rows not yet in an appended CSV file, whose text has quotes, commas and line breaks."""
    path = fresh_path(spark, "csv")
    posts = current_posts(spark, folder, "title")
    done = posts.where("id % 3 = 0").withColumn("note", F.concat(F.lit('say "x", then\nstop '), F.coalesce("title", F.lit(""))))
    for part in (0, 1):
        done.where(f"id % 2 = {part}").write.mode("append").option("header", True).option("escape", '"').csv(path)
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("id BIGINT, title STRING, note STRING").csv(path)
    return posts.join(read.where("startswith(note, 'say')").select("id"), "id", "left_anti")


@registry.add("cdc_apply", MESSAGES + "SELECT post_id AS id FROM s WHERE NOT st.deleted")
def cdc_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the index after the feed; a batch over the same messages as the stream of problem 1."""
    return cdc.latest(table(spark, folder, "post_changes")).where("not deleted").select(F.col("post_id").alias("id"))


@registry.add("synthetic_users", "SELECT CAST(i AS BIGINT) AS id, 'user' || i AS username, CASE WHEN i % 2 = 0 THEN '사용자' || i ELSE 'user' || i END AS nickname FROM range(1, 100001) t(i)")
def synthetic_users(spark: SparkSession, folder: str) -> DataFrame:
    return dumps.synthetic_users(spark, 100_000).select("id", "username", "nickname")
