"""Streams: files into an index as they arrive, and counts over windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrymill.session import shared_folder
from quarrymill.sources.files import TEXT_SUFFIXES, suffix, texts_of
from quarrymill.system import RetrievalSystem


def ingest_stream(spark: SparkSession, folder: str, system: RetrievalSystem, checkpoint: str) -> StreamingQuery:
    """Takes in the text files that arrive in a folder, UTF-8 or else GBK; a batch that is repeated after a failure finds its files known and skips them."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    known = files.where(suffix(F.col("path")).isin(*TEXT_SUFFIXES)).select("path", "content")
    return known.writeStream.foreachBatch(lambda batch, _: system.ingest(texts_of(batch), force=True)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in each window; what comes later than `late` after the newest event is left out."""
    timed = events.withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, counted by hour, as far as the watermark closes the hours."""
    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counted = window_counts(stream.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    rows = counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("value", 2).alias("value"))
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")
