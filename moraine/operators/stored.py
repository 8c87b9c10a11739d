"""The stored index: postings of all fields, stored columns and statistics, kept in segments.

A segment holds the documents of one build or one micro-batch of changes, and the ids that it takes
the place of. A reader sees the segments up to the one that a pointer names: a document counts in its
last segment, unless a later one only takes it away. Segments are named after their batch, so that a
replayed batch overwrites its own; `compact` writes what counts as the first segment of a new index.

Postings lie in folders by a bucket of the term, in each of them spread by document, so that a term
that a third of all documents hold is many files, and sorted by field and term: a search reads the
buckets of its terms, and in them the row groups that hold them. How many there are of both follows
from the size of the source. Document frequencies are counted over the postings that are read; number
and mean length of the documents of a field come from sums that every segment adds or takes away.

Defined results
* null text: the field has no words; a document without any words is stored but never found.
* a repeated id within a segment counts as it stands there: give each id once.
* no documents, no terms: empty results. A search for more terms than MOST_TERMS goes in parts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.operators import search
from moraine.operators.maintenance import move_pointer, pointer
from moraine.storage import in_use

POSTINGS = "field STRING, term STRING, id BIGINT, dl INT, tf BIGINT, seg INT, bucket INT"
STATS = "field STRING, n BIGINT, total BIGINT, seg INT"
DEAD = "id BIGINT, seg INT"
#: Bytes of source for one file of postings.
FILE_BYTES = 32 << 20


def spread(source_bytes: int) -> int:
    """Buckets of terms for a source of this size; each of them has half as many files, four at least."""
    return max(4, math.ceil(math.sqrt(2 * source_bytes / FILE_BYTES)))


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that a DataFrame reads."""
    jvm, total = df.sparkSession._jvm, 0
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    """fields: the analysed words of every field, as expressions over the documents. stored: what is kept beside them."""

    def __init__(self, spark: SparkSession, path: str, fields: Mapping[str, Column], stored: list[Column] | None = None) -> None:
        self.spark, self.path, self.fields, self.stored_columns = spark, path, dict(fields), list(stored or [])

    def _write(self, docs: DataFrame, seg: int, buckets: int, files: int) -> None:
        """Documents with their words in order, analysed once, then the postings from what is written."""
        named = docs.select("id", *[w.alias(f"words_{f}") for f, w in self.fields.items()], *self.stored_columns)
        counted = {f"words_{f}": F.struct(F.size(f"words_{f}").alias("n"), F.col(f"words_{f}").alias("ws")) for f in self.fields}
        named.withColumns(counted).write.mode("overwrite").parquet(f"{self.path}/docs/seg={seg}")
        written = self.spark.read.parquet(f"{self.path}/docs/seg={seg}")
        self._write_postings(written, f"{self.path}/postings/seg={seg}", buckets, files)

    def _write_postings(self, docs: DataFrame, path: str, buckets: int, files: int) -> None:
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"words_{f}.n").alias("dl"), F.col(f"words_{f}.ws").alias("ws")) for f in self.fields])
        rows = docs.select("id", F.explode(each).alias("f")).select("id", "f.field", "f.dl", F.explode("f.ws").alias("term"))
        placed = rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(files)))
        # one shuffle: the count finds its groups where the files are to be
        counted = placed.repartition(buckets * files, "bucket", "part").groupBy("bucket", "part", "field", "term", "id", "dl").agg(F.count("*").alias("tf"))
        sorted_rows = counted.sortWithinPartitions("bucket", "part", "field", "term", "id").select("field", "term", "id", "dl", "tf", "bucket")
        sorted_rows.write.partitionBy("bucket").mode("overwrite").parquet(path)

    def _sums(self, docs: DataFrame, sign: int) -> DataFrame:
        """For each field the documents that have it and their words, with a sign."""
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"words_{f}.n").alias("dl")) for f in self.fields])).alias("x")
        return docs.select(pairs).where("x.dl > 0").groupBy("x.field").agg((sign * F.count("*")).alias("n"), (sign * F.sum("x.dl")).alias("total"))

    def create(self, docs: DataFrame, size: int | None = None) -> Index:
        """Write the first segment; size: bytes of the source, if not those of the files that docs reads."""
        spread_over = spread(source_bytes(docs) if size is None else size)
        self._write(docs, 0, spread_over, max(4, spread_over // 2))
        self._sums(self.spark.read.parquet(f"{self.path}/docs/seg=0"), 1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/seg=0")
        self.spark.createDataFrame([], "id BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/dead/seg=0")
        self.spark.createDataFrame([(spread_over,)], "buckets INT").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/layout")
        move_pointer(self.spark, self.path, 0)
        return self

    def apply(self, docs: DataFrame, gone: DataFrame, seg: int) -> None:
        """One batch of changes: docs take the place of what has their ids, the ids in gone are taken away; unknown ones are no fault."""
        if seg < 1:
            raise ValueError("the first segment is that of the build")
        old = self.docs(seg - 1)
        dead = docs.select("id").unionByName(gone.select("id")).distinct()
        dead.write.mode("overwrite").parquet(f"{self.path}/dead/seg={seg}")
        dead = self.spark.read.parquet(f"{self.path}/dead/seg={seg}")
        self._write(docs, seg, self.buckets(), 1)
        new = self.spark.read.parquet(f"{self.path}/docs/seg={seg}")
        sums = self._sums(new, 1).unionByName(self._sums(old.join(dead, "id", "left_semi"), -1))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/seg={seg}")
        if seg > pointer(self.spark, self.path):  # a replay must not take readers back
            move_pointer(self.spark, self.path, seg)

    def buckets(self) -> int:
        return self.spark.read.schema("buckets INT").parquet(f"{self.path}/layout").first()[0]

    def version(self) -> int:
        return pointer(self.spark, self.path)

    def _read(self, name: str, schema: str | None, version: int) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.path}/{name}")
        return (reader.schema(schema) if schema else reader).parquet(f"{self.path}/{name}").where(F.col("seg") <= version)

    def _live(self, rows: DataFrame, version: int) -> DataFrame:
        """Rows of documents that no later segment has taken away; the first segment alone has nothing to lose."""
        if version == 0:
            return rows
        ended = self._read("dead", DEAD, version).groupBy("id").agg(F.max("seg").alias("ended"))
        return rows.join(ended, "id", "left").where(F.col("ended").isNull() | (F.col("seg") >= F.col("ended"))).drop("ended")

    def docs(self, version: int | None = None) -> DataFrame:
        """The documents that count, with the stored columns."""
        version = self.version() if version is None else version
        return self._live(self._read("docs", None, version), version).drop("seg")

    def postings(self, version: int | None = None, terms: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
        version = self.version() if version is None else version
        rows = self._read("postings", POSTINGS, version)
        if terms is not None:
            numbers = self.spark.createDataFrame([(t,) for t in terms], "term STRING").select(bucket_of(F.col("term"), self.buckets())).distinct().collect()
            rows = rows.where(F.col("bucket").isin([r[0] for r in numbers]) & F.col("term").isin(terms))
        if fields is not None:
            rows = rows.where(F.col("field").isin(fields))
        return self._live(rows, version).drop("bucket", "seg")

    def stats(self, version: int | None = None) -> DataFrame:
        """field, n, avgdl of the documents that count."""
        rows = self._read("stats", STATS, self.version() if version is None else version).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        return rows.where("n > 0").select("field", "n", (F.col("total") / F.col("n")).alias("avgdl"))

    def scored(self, wanted: dict[str, list[tuple[str, search.Terms]]], version: int | None = None) -> DataFrame:
        """qid, id and one score for each name: the sum over its (field, terms), all from one pass over the postings of the terms."""
        rows = [(name, field, q, t, float(b)) for name, of in wanted.items() for field, terms in of for q, t, b in terms]
        version = self.version() if version is None else version
        parts = [rows[i : i + search.MOST_TERMS] for i in range(0, len(rows), search.MOST_TERMS)] or [[]]
        sums = [F.sum(F.when(F.col("name") == n, F.col("part"))).alias(n) for n in wanted]
        out = None
        for part in parts:
            asked = F.broadcast(self.spark.createDataFrame(part, "name STRING, field STRING, qid INT, term STRING, boost DOUBLE"))  # at most MOST_TERMS rows
            found = self.postings(version, sorted({r[3] for r in part}), sorted({r[1] for r in part}))
            df = found.groupBy("field", "term").agg(F.count("*").alias("df"))
            joined = found.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(self.stats(version)), "field").join(asked, ["field", "term"])
            one = joined.select("qid", "id", "name", search.weight().alias("part"))
            out = one if out is None else out.unionByName(one)
        return out.groupBy("qid", "id").agg(*sums)

    def compact(self, path: str) -> Index:
        """What counts now as an index of one segment elsewhere; readers move when they open it."""
        fresh, version = Index(self.spark, path, self.fields, self.stored_columns), self.version()
        buckets = self.buckets()
        self.docs(version).write.mode("overwrite").parquet(f"{path}/docs/seg=0")
        fresh._write_postings(self.spark.read.parquet(f"{path}/docs/seg=0"), f"{path}/postings/seg=0", buckets, max(4, buckets // 2))
        self._sums(self.spark.read.parquet(f"{path}/docs/seg=0"), 1).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/seg=0")
        self.spark.createDataFrame([], "id BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{path}/dead/seg=0")
        self.spark.createDataFrame([(buckets,)], "buckets INT").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
        move_pointer(self.spark, path, 0)
        return fresh


_standing: dict[tuple, Index] = {}


def standing(spark: SparkSession, key: tuple, make) -> Index:
    """The index of this session for a key, made at first use and again if its folder is gone."""
    key = (spark.sparkContext.applicationId, *key)
    index = _standing.get(key)
    if index is None or not in_use(spark, f"{index.path}/CURRENT"):
        index = _standing[key] = make()
    return Index(spark, index.path, index.fields, index.stored_columns)
