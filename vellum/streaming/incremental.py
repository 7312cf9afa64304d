"""Streams: new PDF files into the ledger, and keyed last-wins of a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.plans import batch
from vellum.session import ship
from vellum.sources import pdf


def start(spark: SparkSession, options: batch.Options, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Processes files as they come. A file at a known path is seen once; rewritten ones need a batch run. A
    micro-batch that is repeated after a failure finds its files in the ledger and does nothing twice."""
    ship(spark)

    def each(files: DataFrame, number: int) -> None:
        batch.resume(files, batch.ledger(files.sparkSession, options.output), options, number + 1)

    writer = pdf.stream(spark, options.input).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def windows(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by type and window of time, with a watermark for late ones; for a stream or a table."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
