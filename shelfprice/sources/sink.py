"""Batches of snapshots into a stored table: only the partitions that a batch touches are read and written.

The outcome is staged first and then swapped in. A batch has a name; a run that broke off between the two
goes on from what was staged, whatever state the table is in by then, and a batch that is done is done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import upsert_snapshots


def _path(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _there(spark: SparkSession, path: str) -> bool:
    files, where = _path(spark, path)
    return files.exists(where)


def stage(stored: DataFrame | None, batch: DataFrame, folder: str, part: Column, order: str) -> None:
    """The touched partitions as they are to be: stored rows of the batch's partitions, found by a semi-join that prunes all others, merged with the batch."""
    incoming = batch.withColumn("part", part)
    touched = incoming.select("part").distinct()
    old = incoming.limit(0) if stored is None else stored.select(*incoming.columns).join(F.broadcast(touched), "part", "left_semi").select(*incoming.columns)
    upsert_snapshots(old, incoming, order).write.mode("overwrite").parquet(folder)


def swap(spark: SparkSession, folder: str, path: str, schema) -> None:
    """Staged partitions take the place of the table's; others are not touched. A partition that is too large for a task is written by several."""
    ready = spark.read.schema(schema).parquet(folder)
    ready.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def write_batch(batch: DataFrame, path: str, work: str, name: str, *, part: Column | None = None, order: str = "written_at") -> None:
    """Merges a batch (offer_id, captured_on, order, ...) into the Parquet table at path, one row an offer and day, the last write's; created_at stays the first write's.

    part: the partition of a row, by default the first day of its month. work: a shared folder for what is
    staged; name: the batch's, under which the same batch may come again. An empty batch touches nothing.
    """
    spark = batch.sparkSession
    part = F.trunc("captured_on", "month") if part is None else part
    staged, done = f"{work}/{name}/staged", f"{work}/{name}/done"
    if _there(spark, done):
        return
    incoming = batch.withColumn("part", part)
    if not _there(spark, f"{staged}/_SUCCESS"):
        stored = spark.read.schema(incoming.schema).parquet(path) if _there(spark, path) else None
        stage(stored, batch, staged, part, order)
    swap(spark, staged, path, incoming.schema)
    files, where = _path(spark, done)
    files.create(where, True).close()
    files.delete(_path(spark, staged)[1], True)


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path by the schema of its batches, without the partition column."""
    fields = spark.createDataFrame([], schema).schema.add("part", "date")
    return spark.read.schema(fields).parquet(path).drop("part")
