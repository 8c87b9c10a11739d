"""A change feed applied to keyed streaming state.

Each message is an insert, update or delete with a place in the log. The state of a key is
its last applied place, a tombstone flag and the row image; a message counts only if its
place is higher than the one in the state, so repeated and late deliveries change nothing.
Every micro-batch writes the keys it touched to a folder named after the batch, which a
replayed batch overwrites; the current table is the highest place of each key over all
batches.

The state is an aggregate kept by the engine (max over a struct led by the place), so there
is no Python in the path, and a key that changes very often is reduced on the map side
before anything is shuffled.

Defined results
* null, empty or unreadable image, or one that is not a single JSON object with an id above
  0: the message changes nothing; it is counted by `rejected` and kept by `ChangeTable.divert`.
* op other than c, r, u, d (also null): the same.
* a binlog_file without a number at its end or a null binlog_pos: no place, the same.
* equal places are one change; if such messages differ, the delete and then the greater
  image text win, whatever the order of delivery.
* an empty feed gives an empty table; columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.operators.maintenance import move_pointer, pointer
from moraine.storage import fresh_path, in_use

FEED_COLUMNS = ("op", "before", "after", "binlog_file", "binlog_pos")
ROW = (
    "id BIGINT, title STRING, content STRING, author_id BIGINT, category_id BIGINT, view_count BIGINT, "
    "like_count BIGINT, blinded INT, created_at BIGINT, updated_at BIGINT"
)
STATE = "post_id BIGINT, file_no BIGINT, binlog_pos BIGINT, deleted BOOLEAN, binlog_file STRING, payload STRING"
#: A message that changes nothing, as it came.
LETTER = "kafka_partition INT, kafka_offset BIGINT, op STRING, before STRING, after STRING, binlog_file STRING, binlog_pos BIGINT, reason STRING"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def image() -> Column:
    """The row image that the op needs; null for an op that is none of the four."""
    return F.when(F.col("op") == "d", F.col("before")).when(F.col("op").isin("c", "r", "u"), F.col("after"))


def parsed(changes: DataFrame, *more: str) -> DataFrame:
    """Messages with place and key, and further columns as they came."""
    # in brackets, text after the object or a second object is a syntax error or a second element
    doc = F.try_parse_json(F.concat(F.lit("["), F.col("payload"), F.lit("]")))
    return (
        changes.select(*dict.fromkeys([*FEED_COLUMNS, *more]))
        .withColumn("payload", image())
        .withColumn("doc", doc)
        .select(
            F.when(F.try_variant_get("doc", "$[1]", "variant").isNull(), F.try_variant_get("doc", "$[0].id", "bigint")).alias("post_id"),
            F.regexp_extract("binlog_file", r"\.([0-9]+)$", 1).try_cast("bigint").alias("file_no"),
            "binlog_pos",
            (F.col("op") == "d").alias("deleted"),
            "binlog_file",
            "payload",
            "op",
            F.col("doc").isNotNull().alias("readable"),
            *more,
        )
    )


def valid() -> Column:
    return (F.col("post_id") > 0) & F.col("file_no").isNotNull() & F.col("binlog_pos").isNotNull()


def latest(changes: DataFrame) -> DataFrame:
    """One row for each key: the state after its change with the highest place."""
    state = F.struct("file_no", "binlog_pos", "deleted", "binlog_file", F.when(~F.col("deleted"), F.col("payload")).alias("payload"))
    return parsed(changes).where(valid()).groupBy("post_id").agg(F.max(state).alias("state")).select("post_id", "state.*")


@contextmanager
def _settings(spark: SparkSession, **conf: str):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What batches have written to a folder, by numbered version; a folder that no batch has written yet is an empty table."""
    if not in_use(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


class ChangeTable:
    """State and batch-versioned output of one feed, both below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.out, self.letters = spark, folder, f"{folder}/versions", f"{folder}/letters"

    def apply(self, feed: DataFrame, then: Callable[[DataFrame, int], None] | None = None) -> None:
        """Run the streaming feed until what is available now has been applied.

        then: called with what each batch has written, the state of the keys it touched, and the number of the batch.
        """

        def publish(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.out}/version={batch_id}")
            if then is not None:
                then(self.spark.read.schema(STATE).parquet(f"{self.out}/version={batch_id}"), batch_id)

        with _settings(self.spark, **{"spark.sql.streaming.stateStore.providerClass": ROCKSDB}):
            (
                latest(feed)
                .writeStream.outputMode("update")
                .foreachBatch(publish)
                .option("checkpointLocation", f"{self.folder}/state")
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )

    def divert(self, feed: DataFrame) -> None:
        """Write the messages of the feed that change nothing to a folder of their own, one version for each micro-batch.

        A stream beside `apply` with its own checkpoint; a replayed batch overwrites its version.
        """

        def publish(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.letters}/version={batch_id}")

        dead_letters(feed).writeStream.outputMode("append").foreachBatch(publish).option("checkpointLocation", f"{self.folder}/letters-state").trigger(availableNow=True).start().awaitTermination()

    def diverted(self) -> DataFrame:
        """The messages that `divert` has kept, with the reason."""
        return written(self.spark, self.letters, T._parse_datatype_string(LETTER + ", version BIGINT"))

    def compact(self) -> None:
        """Fold the versions written so far into one table of the last state of every key; later ones are read beside it.

        The fold is named after the last version in it and counts once it is whole; tombstones stay, as late changes need them.
        """
        last = self.versions().agg(F.max("version")).first()[0]
        if last is None:
            return
        state = F.struct("file_no", "binlog_pos", "deleted", "binlog_file", "payload")
        newest = self.versions().groupBy("post_id").agg(F.max(state).alias("s")).select("post_id", "s.*")
        newest.write.mode("overwrite").parquet(f"{self.folder}/folds/fold={last}")
        move_pointer(self.spark, f"{self.folder}/folds", last)

    def versions(self) -> DataFrame:
        rows = written(self.spark, self.out, T._parse_datatype_string(STATE + ", version BIGINT"))
        if not in_use(self.spark, f"{self.folder}/folds/CURRENT"):
            return rows
        last = pointer(self.spark, f"{self.folder}/folds")
        fold = self.spark.read.schema(STATE).parquet(f"{self.folder}/folds/fold={last}").withColumn("version", F.lit(last).cast("bigint"))
        return rows.where(F.col("version") > last).unionByName(fold)

    def current(self, *columns: str) -> DataFrame:
        """Keys that exist now, with the given columns of the state."""
        keep = [c for c in ("file_no", "binlog_pos", "deleted", *columns) if c != "post_id"]
        newest = F.max(F.struct(*dict.fromkeys(keep))).alias("state")
        return self.versions().groupBy("post_id").agg(newest).where("not state.deleted").select("post_id", *[f"state.{c}" for c in columns if c != "post_id"])

    def rows(self) -> DataFrame:
        """The rebuilt table: the row images of the keys that exist now."""
        return self.current("payload").select(F.from_json("payload", ROW).alias("row")).select("row.*")


def feed(spark: SparkSession, folder: str, max_bytes: int = 64 << 30) -> DataFrame:
    """post_changes as a stream; max_bytes bounds what one micro-batch takes."""
    schema = spark.read.parquet(f"{folder}/post_changes.parquet").schema
    # the pattern also matches a table that is one file, which a stream can't open by name
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(f"{folder}/post_changes.parque[t]")


def pieces(spark: SparkSession, folder: str, files: int) -> DataFrame:
    """post_changes as a stream of as many micro-batches as files, with messages of one post in any of them."""
    changes, path = spark.read.parquet(f"{folder}/post_changes.parquet"), fresh_path(spark, "feed")
    changes.repartition(files, F.xxhash64("kafka_partition", "kafka_offset")).write.parquet(path)
    return spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(path)


def replay(spark: SparkSession, folder: str) -> ChangeTable:
    """Apply the whole feed of a data folder to an empty table."""
    table = ChangeTable(spark, fresh_path(spark, "changes"))
    table.apply(feed(spark, folder))
    return table


def reason() -> Column:
    """Why a parsed message changes nothing."""
    return (
        F.when(F.col("op").isNull() | ~F.col("op").isin("c", "r", "u", "d"), "op")
        .when(F.col("payload").isNull(), "image missing")
        .when(~F.col("readable"), "image unreadable")
        .when(F.coalesce(F.col("post_id"), F.lit(0)) <= 0, "id")
        .otherwise("place")
    )


def refused(messages: DataFrame) -> DataFrame:
    return messages.where(~F.coalesce(valid(), F.lit(False)))


def rejected(changes: DataFrame) -> DataFrame:
    """How many messages changed nothing, by op and reason."""
    return refused(parsed(changes)).groupBy(F.coalesce("op", F.lit("none")).alias("op"), reason().alias("reason")).agg(F.count("*").alias("messages"))


def dead_letters(changes: DataFrame) -> DataFrame:
    """The messages that change nothing, as they came, with partition, offset and reason."""
    return refused(parsed(changes, "kafka_partition", "kafka_offset", "before", "after")).select("kafka_partition", "kafka_offset", "op", "before", "after", "binlog_file", "binlog_pos", reason().alias("reason"))
