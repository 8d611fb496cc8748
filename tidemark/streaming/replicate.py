"""Replication: the log folder is the stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import merge
from tidemark.schema import COLUMNS, LOG_SCHEMA


def pull_page(log: DataFrame, since: int, limit: int = 1000) -> DataFrame:
    """At most ``limit`` versions after a clock, in order; ``has_more`` tells whether others follow."""
    order = ["lamport", "actor_id", "id"]
    page = log.where(F.col("lamport") > since).orderBy(*order).limit(limit + 1)  # bounded, so one task may number it
    numbered = page.withColumns({"place": F.row_number().over(Window.orderBy(*order)), "has_more": F.count("*").over(Window.partitionBy()) > limit})
    return numbered.where(F.col("place") <= limit).drop("place")


def stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    except AnalysisException:  # nothing there yet
        return spark.createDataFrame([], LOG_SCHEMA)


def apply_batch(spark: SparkSession, incoming: DataFrame, target: str) -> None:
    """Appends what the target does not hold yet; a batch that is run again adds nothing.

    Of the target only the clocks and, unless there are many, the collections of the batch are read.
    """
    rows = incoming.select(*COLUMNS)
    span = rows.agg(F.min("lamport").alias("least"), F.max("lamport").alias("most")).first()
    if span["least"] is None:
        return
    held = stored(spark, target).where(F.col("lamport").between(span["least"], span["most"]))
    names = [r[0] for r in rows.select("collection").distinct().limit(1001).collect()]
    if len(names) <= 1000:
        held = held.where(F.col("collection").isin(names))
    merge.unseen(held, rows).write.mode("append").partitionBy("collection").parquet(target)


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps ``target`` a replica of the log at ``source``.

    Late versions are always taken and placed by their clock, so there is no watermark. Without
    ``every`` (such as ``500 milliseconds``) it takes what there is and ends.
    """
    stream = spark.readStream.schema(LOG_SCHEMA).parquet(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: apply_batch(batch.sparkSession, batch, target))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def catch_up(spark: SparkSession, snapshot: str, source: str, target: str, checkpoint: str) -> None:
    """A snapshot first, then the log; what both hold is written once."""
    apply_batch(spark, stored(spark, snapshot), target)
    follow(spark, source, target, checkpoint).awaitTermination()
