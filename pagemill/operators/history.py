"""Save events, tag usage and conversations. An event's type is its tag; a value of 50 or more means success."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import collapsed


def tag_usage(events: DataFrame) -> DataFrame:
    """Per tag in lower case: how often, last use, spelling of the first use."""
    tag = F.trim("event_type")
    return events.where(tag != "").groupBy(F.lower(tag).alias("tag_key")).agg(F.count("*").alias("uses"), F.max("ts").alias("last_used"), F.min_by(tag, F.struct("ts", "event_id")).alias("tag"))


def top_tags(events: DataFrame, k: int = 10, min_count: int = 2) -> DataFrame:
    return tag_usage(events).where(F.col("uses") >= min_count).orderBy(F.desc("uses"), F.desc("last_used"), "tag_key").limit(k)


def tag_prefix(events: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """The k tags used most whose key begins with the prefix, whatever its case; for an empty prefix the top tags."""
    if not prefix.strip():
        return top_tags(events, k)
    return tag_usage(events).where(F.col("tag_key").startswith(prefix.strip().lower())).orderBy(F.desc("uses"), F.desc("last_used"), "tag_key").limit(k)


def recent_tags(events: DataFrame, k: int = 10) -> DataFrame:
    return tag_usage(events).orderBy(F.desc("last_used"), "tag_key").limit(k)


def prune_tags(usage: DataFrame, keep: int = 200) -> DataFrame:
    """The `keep` tags used most and last; the rest is forgotten."""
    return usage.orderBy(F.desc("uses"), F.desc("last_used"), "tag_key").limit(keep)


def clip_counts(events: DataFrame, period: str = "daily") -> DataFrame:
    """Saves per day, or per week from Monday, with the label of a badge."""
    day = F.to_date("ts")
    start = day if period == "daily" else F.trunc(day, "week").cast("date")
    n = events.groupBy(start.alias("period_start")).agg(F.count("*").alias("saves"))
    return n.withColumn("label", F.when(F.col("saves") > 999, "999+").otherwise(F.col("saves").cast("string")))


def clip_history(events: DataFrame, keep: int = 50) -> DataFrame:
    """The newest events."""
    return events.select("event_id", "ts", "user_id", "event_type").where("event_type is not null and ts is not null").orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)


def filter_history(history: DataFrame, query: str = "", start: str | None = None, end: str | None = None) -> DataFrame:
    """Entries (title, url, tags, date as text) that hold the query in title, url or tags, whatever its case, on the days from
    start to end. A date that can't be read fails only where a bound is set."""
    out = history
    if query.strip():
        whole = F.lower(F.concat_ws(" ", "title", "url", F.array_join("tags", " ")))
        out = out.where(F.contains(whole, F.lit(query.strip().lower())))
    day = F.to_date(F.try_to_timestamp("date"))
    if start:
        out = out.where(day >= F.lit(start).cast("date"))
    if end:
        out = out.where(day <= F.lit(end).cast("date"))
    return out


def run_summary(results: DataFrame) -> DataFrame:
    """One row for results (success, depth): total, succeeded, failed, max_depth, and whether all succeeded."""
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"), F.coalesce(F.every("success"), F.lit(True)).alias("success"))


def user_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("value") >= 50).alias("succeeded"), F.count_if(F.col("value") < 50).alias("failed"), F.max("ts").alias("last_ts"))


def fail_fast(events: DataFrame, bad: str = "purchase") -> DataFrame:
    """Each user's events up to and including the first of the type that ends a run."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.sum(F.when(F.col("event_type") == bad, 1).otherwise(0)).over(before)
    return events.withColumn("_failed", F.coalesce(failed, F.lit(0))).where("_failed = 0").select("event_id", "user_id", "ts", "event_type")


def responses(conversations: DataFrame) -> DataFrame:
    """Assistant turns numbered from 1, with the first line that isn't blank as preview."""
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda v: F.trim(v) != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit("Response"))
    preview = F.substring(F.trim(F.regexp_replace(first, "^#+[ \t]*", "")), 1, 80)
    return conversations.where("role = 'assistant'").select("conv_id", "turn", order.cast("long").alias("response_no"), preview.alias("preview"), "text")


def conversation_notes(conversations: DataFrame) -> DataFrame:
    """One note per conversation. A conversation is collected; its turns are few by nature."""
    r = responses(conversations)
    part = F.concat(F.lit("## Response "), F.col("response_no").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct("response_no", part.alias("part"))))
    return r.groupBy("conv_id").agg(F.count("*").alias("responses"), F.array_join(F.transform(parts, lambda p: p.part), "\n\n---\n\n").alias("note"))


def response_notes(conversations: DataFrame, title: str = "Conversation") -> DataFrame:
    """One note per response: (conv_id, response_no, title, note)."""
    r = responses(conversations)
    name = F.concat(F.lit(title + " "), F.col("conv_id").cast("string"), F.lit(" - Response "), F.col("response_no").cast("string"))
    return r.select("conv_id", "response_no", name.alias("title"), F.concat(F.lit("# "), name, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("note"))


def reading_stats(docs: DataFrame) -> DataFrame:
    """Words, characters and minutes of the text with its white space collapsed; null where nothing is left."""
    d = docs.select("doc_id", F.nullif(collapsed(F.col("text")), F.lit("")).alias("t"))
    words = F.regexp_count("t", F.lit(r"[^\x20]+")).cast("long")
    return d.select("doc_id", words.alias("words"), F.length("t").cast("long").alias("chars"), F.greatest(F.when(F.col("t").isNotNull(), 1), F.ceil(words / 220.0)).cast("long").alias("minutes"))
