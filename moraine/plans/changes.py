"""Queries of problem 1: the posts table rebuilt from its change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.plans.registry import Registry
from moraine.storage import fresh_path
from moraine.streaming import cdc
from moraine.tables import table

registry = Registry()

MESSAGES = r"""
WITH m AS (
  SELECT coalesce(op, 'none') AS op, op IN ('c', 'r', 'u', 'd') AS known, binlog_file, binlog_pos,
    CASE WHEN op = 'd' THEN before WHEN op IN ('c', 'r', 'u') THEN after END AS image
  FROM post_changes),
p AS (
  SELECT *, try_cast(regexp_extract(binlog_file, '\.([0-9]+)$', 1) AS BIGINT) AS file_no,
    coalesce(json_valid(image), false) AS readable,
    CASE WHEN json_valid(image) THEN try_cast(json_extract_string(image, '$.id') AS BIGINT) END AS post_id
  FROM m),
v AS (
  SELECT *, coalesce(post_id > 0 AND file_no IS NOT NULL AND binlog_pos IS NOT NULL, false) AS ok FROM p),
s AS (
  SELECT post_id, max(struct_pack(file_no := file_no, pos := binlog_pos, deleted := op = 'd', f := binlog_file,
    image := CASE WHEN op <> 'd' THEN image END)) AS st
  FROM v WHERE ok GROUP BY post_id)
"""


@registry.add("p1_found", MESSAGES + "SELECT post_id, st.f AS binlog_file, st.pos AS binlog_pos FROM s WHERE NOT st.deleted")
def found(spark: SparkSession, folder: str) -> DataFrame:
    return cdc.replay(spark, folder).current("post_id", "binlog_file", "binlog_pos")


FIELDS = {"title": "VARCHAR", "content": "VARCHAR", "author_id": "BIGINT", "category_id": "BIGINT", "view_count": "BIGINT", "like_count": "BIGINT", "blinded": "INT", "created_at": "BIGINT", "updated_at": "BIGINT"}


@registry.add(
    "p1_posts",
    MESSAGES + "SELECT post_id AS id, " + ", ".join(f"CAST(json_extract_string(st.image, '$.{c}') AS {t}) AS {c}" for c, t in FIELDS.items()) + " FROM s WHERE NOT st.deleted",
)
def posts(spark: SparkSession, folder: str) -> DataFrame:
    return cdc.replay(spark, folder).rows()


@registry.add(
    "p1_rejected",
    MESSAGES
    + """SELECT op, CASE WHEN NOT coalesce(known, false) THEN 'op' WHEN image IS NULL THEN 'image missing' WHEN NOT readable THEN 'image unreadable'
    WHEN coalesce(post_id, 0) <= 0 THEN 'id' ELSE 'place' END AS reason, count(*) AS messages FROM v WHERE NOT ok GROUP BY ALL""",
)
def rejected(spark: SparkSession, folder: str) -> DataFrame:
    return cdc.rejected(table(spark, folder, "post_changes"))


LETTERS = MESSAGES.replace("SELECT coalesce(op, 'none') AS op,", "SELECT kafka_partition, kafka_offset, op AS raw_op, before, after, coalesce(op, 'none') AS op,")


@registry.add(
    "dead_letter_split",
    LETTERS
    + """SELECT kafka_partition, kafka_offset, raw_op AS op, before, after, binlog_file, binlog_pos, CASE WHEN NOT coalesce(known, false) THEN 'op' WHEN image IS NULL THEN 'image missing'
    WHEN NOT readable THEN 'image unreadable' WHEN coalesce(post_id, 0) <= 0 THEN 'id' ELSE 'place' END AS reason FROM v WHERE NOT ok""",
)
def dead_letter_split(spark: SparkSession, folder: str) -> DataFrame:
    """The messages that change nothing, kept by a stream beside the one that applies the rest."""
    changes = cdc.ChangeTable(spark, fresh_path(spark, "letters"))
    changes.divert(cdc.feed(spark, folder))
    return changes.diverted().drop("version")


@registry.add("p1_batch_state", MESSAGES + "SELECT post_id, st.file_no AS file_no, st.pos AS binlog_pos, st.deleted AS deleted FROM s")
def batch_state(spark: SparkSession, folder: str) -> DataFrame:
    """The same state by one batch aggregate, tombstones included."""
    return cdc.latest(table(spark, folder, "post_changes")).select("post_id", "file_no", "binlog_pos", F.col("deleted"))
