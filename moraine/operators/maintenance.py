"""Tables under change: upsert, delete, report, versions with a pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """base with the changed rows in place of the old; a change with blank content leaves the old row."""
    real = changes.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(*base.columns)
    return base.join(real.select(key), key, "left_anti").unionByName(real)


def deleted(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def report(asked: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """For every key asked for whether it is there to be indexed."""
    there = base.select(key, F.lit(True).alias("there"))
    return asked.select(key).distinct().join(there, key, "left").select(key, F.when(F.col("there"), "indexed").otherwise("not found").alias("state"))


def move_pointer(spark: SparkSession, folder: str, version: int) -> None:
    """Let the folder's pointer name a version; readers see the old one or the new one."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT.{version}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(str(version).encode())
    out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def pointer(spark: SparkSession, folder: str) -> int:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


class Snapshots:
    """Numbered versions of a table below one folder; a pointer names the one that new readers take."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def publish(self, df: DataFrame, version: int) -> None:
        """Write a version, then move the pointer; a failed write leaves readers on the old version."""
        df.write.mode("overwrite").parquet(f"{self.folder}/version={version}")
        move_pointer(self.spark, self.folder, version)

    def pinned(self) -> int:
        return pointer(self.spark, self.folder)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/version={self.pinned() if version is None else version}")
