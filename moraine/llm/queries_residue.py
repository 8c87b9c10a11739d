"""Queries of problem 8: documents that are residue of templates, fillers, errors or script notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.residue import residue
from moraine.plans.registry import Registry
from moraine.tables import table

registry = Registry()


@registry.add("p8_found")
def found(spark: SparkSession, folder: str) -> DataFrame:
    return residue(table(spark, folder, "documents")).select("doc_id")


@registry.add("p8_kinds")
def kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents of each source are excluded for each kind of evidence."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "source").distinct().join(residue(docs), "doc_id").groupBy("source", "kind").agg(F.count("*").alias("documents"))
