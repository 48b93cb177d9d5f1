"""Incremental ingest: articles as a stream, once each, counted per ticker and day in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, schema, late: str | None = None, files: int = 100) -> DataFrame:
    """The rows of the folder's Parquet files, each id once however late and in whatever batch it comes.

    The ids seen are state that nothing ages out. ``late`` drops nothing here; it marks _date after the deduplication, so that
    windows counted on the stream may close, which leaves out of those counts what comes later than that.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    once = raw.withColumn("_date", F.col("_date").cast("timestamp")).dropDuplicates(["article_id"])
    return once.withWatermark("_date", late) if late else once


def window_counts(rows: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    """ticker, first, n: articles per ticker and sliding window."""
    return rows.groupBy(F.window("_date", size, step).alias("w"), F.upper(F.trim("_ticker")).alias("ticker")).agg(F.count("*").alias("n")).select("ticker", F.col("w.start").alias("first"), "n")


def ingest(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows to a table and stops when all that has arrived is in; a batch written again after a failure replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
