"""Ordered things: threads of posts, answers, captions, text items, notes with spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import collapsed


def detect_threads(posts: DataFrame) -> DataFrame:
    """(page_id, ord, position) for posts (page_id, ord, author, reposter, reposter_name, main): the thread of the author
    `main`, from the author's first post on, as long as posts are the author's or reposts of theirs; a single post is none."""
    page = Window.partitionBy("page_id")
    upto = page.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("author") == F.col("main")
    same = lambda c: F.coalesce(F.lower(c) == F.lower("main"), F.lit(False))
    d = posts.withColumn("_begin", F.min(F.when(own, F.col("ord"))).over(page)).where("ord >= _begin")
    ends = F.when(~(own | same("reposter") | same("reposter_name")), 1).otherwise(0)
    d = d.withColumn("_ended", F.sum(ends).over(upto)).where("_ended = 0")
    d = d.withColumn("_n", F.count("*").over(page)).withColumn("position", F.row_number().over(page.orderBy("ord")).cast("long"))
    return d.where("_n > 1").select("page_id", "ord", "position")


def thread_stats(posts: DataFrame) -> DataFrame:
    """Per page: posts, sums of replies, reposts and likes, views and bookmarks where any post has them, rounded means."""
    half_up = lambda c: F.floor(F.sum(F.coalesce(c, F.lit(0))) / F.count("*") + 0.5).cast("long")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return posts.groupBy("page_id").agg(
        F.count("*").alias("posts"), zero("replies").alias("replies"), zero("reposts").alias("reposts"), zero("likes").alias("likes"), F.sum("views").alias("views"), F.sum("bookmarks").alias("bookmarks"),
        half_up("replies").alias("mean_replies"), half_up("reposts").alias("mean_reposts"), half_up("likes").alias("mean_likes"),
    )


def poll_totals(options: DataFrame, clipped_at: Column) -> DataFrame:
    """Per option of polls (poll_id, option, pos, votes, total_said, ends_at) with two options or more: votes, total (what the
    poll says where no option has votes), per cent, and whether the poll has ended."""
    poll = Window.partitionBy("poll_id")
    d = options.withColumn("_n", F.count("*").over(poll)).withColumn("_sum", F.sum("votes").over(poll)).where("_n >= 2")
    total = F.when(F.coalesce("_sum", F.lit(0)) > 0, F.col("_sum")).otherwise(F.coalesce("total_said", F.lit(0)))
    per_cent = F.when(total > 0, F.floor(100.0 * F.col("votes") / total + 0.5)).otherwise(0).cast("long")
    return d.select("poll_id", "pos", "option", F.coalesce("votes", F.lit(0)).alias("votes"), total.alias("total"), per_cent.alias("per_cent"), F.coalesce(F.col("ends_at") <= clipped_at, F.lit(False)).alias("ended"))


def top_answers(answers: DataFrame, k: int = 10) -> DataFrame:
    """The k best answers (question_id, pos, accepted, votes, author, body) of each question, accepted ones first, then by votes
    and place; those without a body are dropped after the cut."""
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("accepted"), F.desc("votes"), "pos"))
    d = answers.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).where(F.trim(F.coalesce("body", F.lit(""))) != "")
    return d.select("question_id", "rank", "accepted", "votes", F.coalesce(F.nullif("author", F.lit("")), F.lit("Community")).alias("author"), "body")


def top_comments(comments: DataFrame, k: int = 20) -> DataFrame:
    """The first k comments (page_id, pos, author, body, indent) of each page, those without a body dropped after the cut; the
    depth is a 40th of the indent."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    d = comments.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).where(F.trim(F.coalesce("body", F.lit(""))) != "")
    return d.select("page_id", "rank", F.coalesce(F.nullif("author", F.lit("")), F.lit("[deleted]")).alias("author"), F.floor(F.coalesce("indent", F.lit(0)) / 40).cast("long").alias("depth"), "body")


def best_caption_track(tracks: DataFrame) -> DataFrame:
    """(video_id, pos): the first track (video_id, pos, kind) that people wrote, else the first."""
    return tracks.groupBy("video_id").agg(F.min_by("pos", F.struct(F.coalesce(F.col("kind") == "asr", F.lit(False)), F.col("pos"))).alias("pos"))


def read_captions(df: DataFrame, col: str = "json") -> DataFrame:
    """(video_id, seq, start_ms, text) from JSON captions: events with segments, their texts joined and trimmed, blank ones
    dropped."""
    schema = "struct<events: array<struct<tStartMs: bigint, segs: array<struct<utf8: string>>>>>"
    d = df.select("video_id", F.posexplode(F.from_json(col, schema).events).alias("seq", "e")).where("e.segs is not null")
    text = F.regexp_replace(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s.utf8, F.lit(""))), ""), r"^\s+|\s+$", "")
    return d.select("video_id", F.col("seq").cast("long").alias("seq"), F.coalesce("e.tStartMs", F.lit(0)).alias("start_ms"), text.alias("text")).where("text <> ''")


def timestamp(seconds: Column) -> Column:
    """m:ss, from an hour on h:mm:ss."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def timestamp_seconds(text: Column) -> Column:
    """Seconds of m:ss or h:mm:ss, else 0."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.when(p.rlike("^[0-9]{1,9}$"), p.cast("long")))
    ok = F.size(parts).isin(2, 3) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 60 + p)).otherwise(F.lit(0).cast("long"))


def transcripts(captions: DataFrame, with_time: bool = True) -> DataFrame:
    """(video_id, transcript) of captions (video_id, seq, start_ms, text): lines with their times by blank lines, or the texts
    by spaces. The captions of one video are gathered."""
    second = F.floor(F.col("start_ms") / 1000).cast("long")
    piece = F.concat(F.lit("**["), timestamp(second), F.lit("]** "), F.col("text")) if with_time else F.col("text")
    parts = F.array_sort(F.collect_list(F.struct("seq", piece.alias("t"))))
    return captions.groupBy("video_id").agg(F.array_join(F.transform(parts, lambda p: p.t), "\n\n" if with_time else " ").alias("transcript"))


def lines_from_items(items: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line) of text items (doc_id, page_no, seq, str, has_eol): items joined by spaces, a new line
    after each has_eol, blank lines dropped."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    ends = F.sum(F.when(F.coalesce("has_eol", F.lit(False)), 1).otherwise(0)).over(page.rowsBetween(Window.unboundedPreceding, -1))
    d = items.withColumn("_line", F.coalesce(ends, F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("seq", "str")))
    d = d.groupBy("doc_id", "page_no", "_line").agg(collapsed(F.array_join(F.transform(parts, lambda p: p["str"]), " ")).alias("line")).where("line <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("_line"))
    return d.select("doc_id", "page_no", number.cast("long").alias("line_no"), "line")


def budget_text(pages: DataFrame, max_pages: int, max_chars: int) -> DataFrame:
    """(doc_id, text, truncated) of pages (doc_id, page_no, text): a heading and the text of each page that has one, until the
    characters are spent; the last page is cut."""
    chunk = F.concat(F.lit("## Page "), F.col("page_no").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n\n"))
    d = pages.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("chunk", chunk)
    before = F.sum(F.length("chunk")).over(Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("room", F.greatest(F.lit(0), max_chars - F.coalesce(before, F.lit(0))).cast("int"))
    cut = F.when(F.col("page_no") <= max_pages, F.substring(F.col("chunk"), F.lit(1), F.col("room"))).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("page_no", cut.alias("c"))))
    over = F.max((F.col("page_no") > max_pages) | (F.length("chunk") > F.col("room")))
    return d.groupBy("doc_id").agg(F.rtrim(F.array_join(F.transform(parts, lambda p: p.c), "")).alias("text"), over.alias("truncated"))


def clip_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, ranges): the selected ranges (doc_id, range_no, start, end) of each document, those that aren't blank, by
    rules."""
    d = docs.select("doc_id", "text").join(spans, "doc_id").withColumn("piece", F.trim(F.substring(F.col("text"), F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0))))).where("piece <> ''")
    parts = F.array_sort(F.collect_list(F.struct("range_no", "piece")))
    return d.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p.piece), "\n\n---\n\n").alias("text"), F.count("*").alias("ranges"))


def image_refs(docs: DataFrame) -> DataFrame:
    """(doc_id, image_no, alt, url, attachment) for the images of Markdown `text`, each http URL once: the attachment's name is
    image-<number> with the path's ending, else img."""
    refs = F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\([^)\s]+(?:\s+\"[^\"]*\")?\)"), F.lit(0))
    d = docs.select("doc_id", F.posexplode(refs).alias("pos", "ref"))
    d = d.select("doc_id", "pos", F.regexp_extract("ref", r"^!\[([^\]]*)\]", 1).alias("alt"), F.regexp_extract("ref", r"\]\(([^)\s]+)", 1).alias("url")).where(F.col("url").rlike("(?i)^https?://"))
    d = d.groupBy("doc_id", "url").agg(F.min("pos").alias("pos"), F.min_by("alt", "pos").alias("alt"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long")
    ending = F.lower(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"(?i)\.(png|jpe?g|gif|webp|svg|avif|bmp)$", 1))
    d = d.withColumn("image_no", number)
    return d.select("doc_id", "image_no", "alt", "url", F.concat(F.lit("image-"), F.col("image_no").cast("string"), F.lit("."), F.when(ending == "", "img").otherwise(ending)).alias("attachment"))


def rewrite_images(docs: DataFrame, refs: DataFrame, folder: str = "attachments") -> DataFrame:
    """(doc_id, text, total, rewritten): images whose URL has a row in refs (doc_id, url, attachment) point to the attachment."""
    known = refs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("url", "attachment"))).alias("known"))
    image = r"!\[[^\]]*\]\([^)\s]+(?:\s+\"[^\"]*\")?\)"
    d = docs.select("doc_id", "text").join(known, "doc_id", "left").withColumn("refs", F.regexp_extract_all("text", F.lit(image), F.lit(0))).withColumn("gaps", F.split("text", image))
    url = lambda r: F.regexp_extract(r, r"\]\(([^)\s]+)", 1)
    to = lambda r: F.element_at("known", url(r))
    new = F.transform("refs", lambda r: F.when(to(r).isNotNull(), F.concat(F.regexp_extract(r, r"^!\[[^\]]*\]", 0), F.lit(f"({folder}/"), to(r), F.lit(")"))).otherwise(r))
    text = F.array_join(F.zip_with("gaps", F.concat(new, F.array(F.lit(""))), lambda g, r: F.concat(g, r)), "")
    return d.select("doc_id", text.alias("text"), F.size("refs").cast("long").alias("total"), F.size(F.filter("refs", lambda r: to(r).isNotNull())).cast("long").alias("rewritten"))


def filter_markdown(docs: DataFrame, images: bool = True, links: bool = True, clean: bool = True) -> DataFrame:
    """(doc_id, text): without images and the blank lines they leave, with links unwrapped, with line ends and blank lines
    tidied, as asked for (False drops)."""
    t = F.col("text")
    if not images:
        t = F.regexp_replace(F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", ""), r"\n{3,}", "\n\n")
    if not links:
        t = F.regexp_replace(t, r"(?<!!)\[([^\]]*)\]\([^)]*\)", "$1")
    if clean:
        t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n"))
    return docs.select("doc_id", t.alias("text"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, body) of Markdown files: the first # heading is the title, else Untitled; white space before the text is
    cut."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\s+", "").alias("body"))
    return d.select("file", F.coalesce(F.nullif(F.trim(F.regexp_extract("body", r"(?m)^#[ \t]+(.+)$", 1)), F.lit("")), F.lit("Untitled")).alias("title"), "body")
