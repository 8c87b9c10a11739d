"""Consecutive numbers for rows in an order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.storage import materialize

_IN_PARTITION = (1 << 33) - 1


def numbered(df: DataFrame, keys: list[str], column: str, start: int = 1) -> DataFrame:
    """df with the place of each row in the order of keys, from start.

    The rows are range-partitioned and sorted, written once with their place in the partition, and
    moved by the sizes of the partitions before theirs: one number a partition reaches the driver.
    """
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(_IN_PARTITION).alias("_pos"))
    placed = materialize(placed, "numbered")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, start
    for part in sorted(sizes):
        offsets[part] = total
        total += sizes[part]
    if not offsets:
        return placed.withColumn(column, F.lit(None).cast("bigint")).drop("_part", "_pos")
    table = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o))])
    return placed.withColumn(column, F.element_at(table, F.col("_part")) + F.col("_pos")).drop("_part", "_pos")
