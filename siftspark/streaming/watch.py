"""Structured Streaming: the same scans over arriving files, windowed counts, and incremental state by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.plans import scans


def arriving_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of each file that arrives in a folder."""
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def watch(spark: SparkSession, folder: str, sink, checkpoint: str):
    """Scans arriving files in micro-batches; sink(findings, batch id) gets each. Returns the running query."""
    stream = scans.snippet(arriving_texts(spark, folder), "file")
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Tumbling counts with a watermark, on a stream or a table."""
    by = F.window(ts, width)
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(by, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def hashed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256))


def changed(files: DataFrame, state: DataFrame, path: str = "path") -> DataFrame:
    """Files with a hash that state(path, hash) does not have."""
    return files.join(state.select(F.col("path").alias(path), "hash").distinct(), [path, "hash"], "left_anti")


def advanced(state: DataFrame, scanned: DataFrame, now) -> DataFrame:
    """The next state: scanned files replace their old rows."""
    new = scanned.select("path", "hash", F.lit(now).cast("timestamp").alias("scanned_at"))
    return state.join(new.select("path"), "path", "left_anti").unionByName(new)


def forget(state: DataFrame, paths: list[str]) -> DataFrame:
    return state.where(~F.col("path").isin(*paths)) if paths else state


def state_counts(state: DataFrame, now) -> DataFrame:
    recent = F.col("scanned_at") >= F.lit(now).cast("timestamp") - F.expr("interval 24 hours")
    return state.agg(F.count("*").alias("total"), F.count_if(recent).alias("last_day"))


def alerts(validated: DataFrame) -> DataFrame:
    """Findings that are live, for a monitor that runs on a schedule: it has something to say if there is any row."""
    return validated.where(F.col("valid") & F.col("checked"))
