"""Streams: each line, or each document, by itself, as Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): new files' lines as they come."""
    return spark.readStream.text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.option("wholetext", True).text(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, key, n), with a watermark; timestamps without a zone are taken as the session's."""
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return own.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def write(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """Start writing each new row once; the checkpoint folder has to be shared."""
    return stream.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append").start(path)


def grep_once(spark: SparkSession, rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows written as files, streamed back line by line, and kept where the pattern matches."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nodeloom-stream-")
    run = f"{base.rstrip('/')}/lines-{uuid.uuid4().hex}"
    rows.select(F.col(column).alias("value")).write.text(f"{run}/in")
    found = read_lines(spark, f"{run}/in").where(F.rlike("value", F.lit(pattern)))
    found.writeStream.format("parquet").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start(f"{run}/out").awaitTermination()
    return spark.read.schema("value string").parquet(f"{run}/out")
