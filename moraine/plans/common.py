"""What several queries read: the current posts and fixed points in time, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.storage import materialize
from moraine.tables import table

AS_OF = "2025-12-01 00:00:00"
LOGS_AS_OF = "2025-05-01 00:00:00"
FIELDS = ("title", "content", "author_id", "category_id", "view_count", "like_count", "blinded", "source", "created_at", "updated_at")

POSTS = (
    "p AS (SELECT id, " + ", ".join(f"v.{c} AS {c}" for c in FIELDS) + " FROM (SELECT id, max(struct_pack(_u := coalesce(updated_at, TIMESTAMP '0001-01-01'), _v := view_count, "
    + ", ".join(f"{c} := {c}" for c in FIELDS) + ")) AS v FROM posts GROUP BY id))"
)
#: The same without the long text, for queries that don't read it.
HEADS = POSTS.replace(", content := content", "").replace(", v.content AS content", "")


#: So many ids that stand more than once are sent to every task at most (some 40 MB); if there are more, all rows are shuffled.
REPEATED = 1_000_000


def current_posts(spark: SparkSession, folder: str, *columns: str, first: int | None = None, repeated: int = 0) -> DataFrame:
    """The latest version of every post (rows may stand more than once), with the columns asked for.

    Only those columns and the version are read and shuffled; versions are combined on the map side.
    first: so many characters of the content are enough; of versions that tie, the greatest content also has the greatest beginning.
    repeated: if so many ids at most stand more than once, only their rows are shuffled, at the price of a first look at the ids.
    """
    version = F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    keep = [c for c in FIELDS if c in columns]
    taken = [F.substring(c, 1, first).alias(c) if c == "content" and first is not None else F.col(c) for c in keep]
    row = F.struct(version.alias("_u"), F.col("view_count").alias("_v"), *taken)

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("id").agg(F.max(row).alias("v")).select("id", *[f"v.{c}" for c in keep])

    posts = table(spark, folder, "posts")
    if not repeated:
        return latest(posts)
    again = materialize(posts.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_again")), "repeated")
    if again.count() > repeated:
        return latest(posts)
    marked = posts.join(F.broadcast(again), F.col("id") == F.col("_again"), "left")
    return marked.where("id is not null and _again is null").select("id", *taken).unionByName(latest(marked.where("id is null or _again is not null")))


def as_of(text: str = AS_OF):
    return F.lit(text).cast("timestamp_ntz")
