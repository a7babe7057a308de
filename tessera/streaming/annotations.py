"""Streaming over an event log (beyond the batch operators): windowed and session counts with a watermark, upserts of annotations,
and a log of feedback that learns concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and value sums by window and event type; works on streams and on tables."""
    counted = _marked(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, n, total): a user's events with less than `gap` between neighbours are one session, which
    ends `gap` after its last event. On a stream, rows later than the watermark are dropped, earlier ones still join their session."""
    counted = _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", F.round("total", 2).alias("total"))


def latest(annotations: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key."""
    return annotations.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in annotations.columns if c not in keys]), F.col(at)).alias("v")).select(*keys, "v.*")


# --- tables that follow a stream ----------------------------------------------------------------------------------------------------
def _versions(stream: DataFrame, path: str, checkpoint: str, reduce) -> StreamingQuery:
    """Each micro-batch, reduced, becomes one part of the table at path, named by its number: a batch that runs again after a crash
    replaces its own part, so every row counts once. Runs until the given input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], at: str) -> StreamingQuery:
    """Follows a stream of annotations: each micro-batch adds the newest row of each of its keys to the table of current()."""
    return _versions(stream, path, checkpoint, lambda batch: latest(batch, keys, at))


def current(spark: SparkSession, path: str, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key over all micro-batches so far, whatever order they came in."""
    return latest(spark.read.parquet(path).drop("batch"), keys, at)


def compacted(spark: SparkSession, path: str, into: str, keys: list[str], at: str) -> None:
    """Writes current() as the one part of a new table, for a log that has grown long."""
    current(spark, path, keys, at).write.mode("overwrite").parquet(f"{into}/batch=-1")


def follow_feedback(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Follows a log of feedback(concept, term, helpful boolean): each micro-batch adds its counts for every pair to the table of learned()."""
    counts = lambda batch: batch.groupBy("concept", "term").agg(F.count_if("helpful").alias("good"), F.count("*").alias("n"))
    return _versions(stream, path, checkpoint, counts)


def learned(spark: SparkSession, path: str, least: int = 3, share: float = 0.6) -> DataFrame:
    """(concept, term, good, n, confidence): pairs told at least `least` times and found helpful in over `share` of them.
    confidence: the share drawn towards one half, (good + 1) / (n + 2)."""
    told = spark.read.parquet(path).groupBy("concept", "term").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    return told.where((F.col("n") >= least) & (F.col("good") > share * F.col("n"))).withColumn("confidence", F.round((F.col("good") + 1) / (F.col("n") + 2), 6))
