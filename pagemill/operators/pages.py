"""Operators over stored pages (page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.text import decoded

# One token per comment, raw script or style, tag, or run of text.
RAW = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TOKEN = r"(?s)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>|[^<]+"

# Elements without an end, and those that stand on lines of their own.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCKS = "address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()


def normalize_urls(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    return pages.select("page_id", "url", urls.normalized(u).alias("norm_url"), urls.host(u).alias("host"), urls.site_key(u).alias("site_key"))


def dedupe_urls(pages: DataFrame) -> DataFrame:
    """The first page of each normalised URL. An aggregate, so copies meet before the shuffle."""
    first = F.min_by("url", "page_id").alias("url")
    return normalize_urls(pages).groupBy("norm_url").agg(F.min("page_id").alias("page_id"), first, F.count("*").alias("copies"))


def classify_pages(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    return pages.select("page_id", urls.page_type(u).alias("page_type"), urls.crawlable(u).alias("crawlable"), u.rlike("(?i)^https?://").alias("clippable"))


def token_kinds(tokens: DataFrame) -> DataFrame:
    """(page_id, pos, kind, tag, tok) of (page_id, pos, tok)."""
    tok = F.col("tok")
    t = tokens.withColumn("tag", F.lower(F.regexp_extract("tok", r"^</?([A-Za-z][A-Za-z0-9-]*)", 1)))
    kind = F.when(tok.startswith("<!--"), "comment").when(tok.startswith("</"), "close").when(F.col("tag").isin("script", "style"), "raw").when(F.col("tag") != "", "open").when(tok.startswith("<"), "other").otherwise("text")
    return t.select("page_id", "pos", kind.alias("kind"), "tag", "tok")


def page_tokens(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, tag, tok, dep): dep counts the open elements of the same tag. The window is per page and
    tag."""
    t = token_kinds(pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "tok")))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    over = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select("*", F.sum(step).over(over).alias("dep"))


def tag_counts(pages: DataFrame) -> DataFrame:
    t = page_tokens(pages).where("kind in ('open', 'close')")
    return t.groupBy("tag").agg(F.count_if(F.col("kind") == "open").alias("opened"), F.count_if(F.col("kind") == "close").alias("closed"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, dst_url, link_pos): targets of a page's anchors, resolved against its URL, without fragments and other schemes,
    each at its first place."""
    a = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(F.regexp_replace("html", RAW, ""), F.lit(r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))).alias("link_pos", "href"))
    a = a.withColumn("href", F.trim(decoded(F.regexp_replace("href", r"""^["']|["']$""", ""))))
    a = a.where(~F.col("href").rlike("(?i)^(#|mailto:|tel:|javascript:)")).withColumn("href", F.regexp_replace("href", "#.*$", ""))
    a = a.withColumn("dst_url", urls.resolved(F.col("url"), F.col("href"))).where("dst_url is not null")
    return a.groupBy("page_id", "dst_url").agg(F.min("link_pos").alias("link_pos"))


def unseen_links(pages: DataFrame) -> DataFrame:
    """Targets that no stored page has, with the number of pages that link there."""
    known = pages.select(urls.normalized(F.col("url")).alias("dst_url")).distinct()
    links = page_links(pages).where(urls.crawlable(F.col("dst_url"))).withColumn("dst_url", urls.normalized(F.col("dst_url")))
    return links.join(known, "dst_url", "left_anti").groupBy("dst_url").agg(F.countDistinct("page_id").alias("pages"))
