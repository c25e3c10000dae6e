"""Snapshots as they arrive: a stream of written prices kept as a table of one row an offer and day.

An extension of the batch rule (the last write of a day counts) to Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import upsert_snapshots


def read_writes(spark, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream, new files in each trigger."""
    return spark.readStream.schema(schema).parquet(path)


def daily_counts(writes: DataFrame, late: str = "1 day") -> DataFrame:
    """Writes per day of written_at, rows later than ``late`` left out; offers that write twice count once."""
    once = writes.withWatermark("written_at", late).dropDuplicatesWithinWatermark(["offer_id", "captured_on"])
    return once.groupBy(F.window("written_at", "1 day")).agg(F.count("*").alias("writes"))


def keep_snapshots(writes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged into the table's days that it touches; the same batch again changes nothing.

    The table is partitioned by captured_on: only the days of the batch are read and written, under a
    dynamic overwrite that replaces whole partitions.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = [r["captured_on"] for r in batch.select("captured_on").distinct().collect()]  # as many as the days a batch brings
        if not days:
            return
        there = spark.catalog.tableExists(table)
        stored = spark.table(table).where(F.col("captured_on").isin(days)).select(batch.columns) if there else batch.limit(0)
        stage = f"{checkpoint}/merged"  # the table's days are replaced by what was read from them
        upsert_snapshots(stored, batch).write.mode("overwrite").parquet(stage)
        ready = spark.read.schema(batch.schema).parquet(stage)
        if there:
            ready.select(spark.table(table).columns).write.option("partitionOverwriteMode", "dynamic").insertInto(table, overwrite=True)
        else:
            ready.write.partitionBy("captured_on").format("parquet").saveAsTable(table)

    return writes.writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
