"""Streaming forms of the counters. Rows later than the watermark are left out; closed windows are final."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators.history import prune_tags


def clip_counts_stream(events: DataFrame, late: str = "1 day", period: str = "weekly") -> DataFrame:
    """Saves by day, or by week from Monday, for a streaming or batch table of events."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    span = F.window("ts", "1 week", "1 week", "4 days") if period == "weekly" else F.window("ts", "1 day")
    return timed.groupBy(span.alias("w")).agg(F.count("*").alias("saves")).select(F.to_date("w.start").alias("period_start"), "saves")


def tag_usage_stream(events: DataFrame) -> DataFrame:
    """Use of each tag, in lower case, for update or complete mode; the state has a row per tag."""
    tag = F.trim("event_type")
    return events.where(tag != "").groupBy(F.lower(tag).alias("tag_key")).agg(F.count("*").alias("uses"), F.max("ts").alias("last_used"), F.min_by(tag, F.struct("ts", "event_id")).alias("tag"))


def merged_usage(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Use of each tag in both; the spelling is that of the state, which came first."""
    both = state.withColumn("_old", F.lit(0)).unionByName(batch.withColumn("_old", F.lit(1)))
    return both.groupBy("tag_key").agg(F.sum("uses").alias("uses"), F.max("last_used").alias("last_used"), F.min_by("tag", "_old").alias("tag"))


def merge_tag_usage(batch: DataFrame, number: int, path: str, keep: int = 200) -> None:
    """Add a batch of events to the usage that is kept in path, and keep the `keep` tags used most and last. Each batch writes a
    version of its own from the one before, so a batch that comes again leaves the usage as it is. Versions are dealt by
    tag, and only keep + 1 tags at most are ever sorted in a task."""
    spark = batch.sparkSession
    usage = tag_usage_stream(batch)
    if number:
        usage = merged_usage(spark.read.parquet(f"{path}/{number - 1}"), usage)
    prune_tags(usage, keep).repartition("tag_key").write.mode("overwrite").parquet(f"{path}/{number}")


def keep_tag_usage(events: DataFrame, path: str, keep: int = 200):
    """A writer that merges a stream's tags into the versioned usage in path."""
    return events.writeStream.foreachBatch(lambda batch, number: merge_tag_usage(batch, number, path, keep))


def dedupe_stream(pages: DataFrame, seen: str, within: str = "7 days") -> DataFrame:
    """Pages whose normalised URL hasn't come within this time; `seen` is the column with a page's time."""
    d = pages.withColumn("norm_url", urls.normalized(F.col("url"))).withColumn(seen, F.col(seen).cast("timestamp"))
    return d.withWatermark(seen, within).dropDuplicatesWithinWatermark(["norm_url"])


def keep_history(events: DataFrame, path: str, keep: int = 50):
    """A writer that keeps the newest `keep` events of a stream in a Parquet folder, one version per batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.where("event_type is not null and ts is not null").select("event_id", "ts", "user_id", "event_type")
        if number:
            newest = newest.unionByName(spark.read.parquet(f"{path}/{number - 1}"))
        newest.dropDuplicates(["event_id"]).orderBy(F.desc("ts"), F.desc("event_id")).limit(keep).write.mode("overwrite").parquet(f"{path}/{number}")

    return events.writeStream.foreachBatch(merge)
