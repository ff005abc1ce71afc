"""Incremental ingestion: new chunk files stream in, each micro-batch is written under its number, so a repeated batch
replaces itself; pausing is stopping the query, resuming is starting it from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import word_windows


def ingest(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files_per_batch: int = 100, make=None) -> StreamingQuery:
    """Runs over what is there (``availableNow``); ``make`` turns a batch of rows into the derived table."""
    make = make or (lambda df: word_windows(df, ["doc_id"]))

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Monitoring of events: counts per window and kind; works on streams and tables alike."""
    with_mark = stream.withWatermark(time, late) if stream.isStreaming else stream
    return with_mark.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
