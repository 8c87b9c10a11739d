"""Written tables and checkpoints in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir of the session.

    Only a local master without that setting gets a folder of its own (tests); on a
    cluster a missing setting is an error, since machine-local paths are not shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="moraine-"))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has yet, in the application's own part of the shared folder, which goes when the application ends."""
    application = spark.sparkContext.applicationId
    own = _own.get(application)
    if own is None or not own.startswith(shared_dir(spark)):
        own = _own[application] = f"{shared_dir(spark)}/{application}-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def in_use(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def file_stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and time of change of a table's file or folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength(), fs.getFileStatus(target).getModificationTime()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back.

    Unlike a cached table it survives the loss of an executor, and unlike a row checkpoint
    it keeps columns, so later scans prune and push filters down.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
