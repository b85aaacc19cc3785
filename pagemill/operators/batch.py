"""Lists of URLs, crawls and chains of steps over the stored pages, which stand in for fetching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.text import collapsed, decoded
from pagemill.operators.pages import RAW, page_links

# Parts of result links that lead nowhere else.
NO_RESULT = ["google.com/search", "google.com/url", "webcache.googleusercontent.com", "accounts.google.com"]


def batch_clip(url_list: DataFrame, pages: DataFrame) -> DataFrame:
    """(seq, url, page_type, success, error, page_id) for every listed (seq, url): the first stored page of the normalised URL, or
    an error where there is none."""
    stored = pages.groupBy(urls.normalized(F.col("url")).alias("norm_url")).agg(F.min("page_id").alias("page_id"))
    d = url_list.withColumn("norm_url", urls.normalized(F.col("url"))).join(stored, "norm_url", "left")
    found = F.col("page_id").isNotNull()
    return d.select("seq", "url", urls.page_type(F.col("url")).alias("page_type"), found.alias("success"), F.when(~found, "page not stored").alias("error"), "page_id")


def search_results(pages: DataFrame, k: int = 5) -> DataFrame:
    """(page_id, rank, url, title): the first k result links of stored result pages: http links that lead elsewhere, each once,
    with a heading in them or else their text, of three signs or more, as title."""
    a = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.regexp_replace("html", RAW, ""), F.lit(r"""(?is)<a\s[^>]*href\s*=\s*["']?http.*?</a>"""), F.lit(0))).alias("pos", "a"))
    href = decoded(F.regexp_replace(F.regexp_extract("a", r"""(?is)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1), r"""^["']|["']$""", ""))
    inner = F.regexp_extract("a", r"(?is)<h3[^>]*>(.*?)</h3>", 1)
    text = lambda t: collapsed(decoded(F.regexp_replace(t, r"<[^>]*>", "")))
    title = F.coalesce(F.nullif(text(inner), F.lit("")), text(F.col("a")))
    d = a.select("page_id", "pos", href.alias("url"), title.alias("title")).where((F.length("title") >= 3) & F.col("url").rlike("^http"))
    for part in NO_RESULT:
        d = d.where(~F.contains("url", F.lit(part)))
    d = d.groupBy("page_id", "url").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return d.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("page_id", "rank", "url", "title")


def crawl(pages: DataFrame, start: str, depth: int = 1, max_pages: int = 20, include_subdomains: bool = True) -> DataFrame:
    """(visit, url, depth, status, page_id): the pages that a breadth-first crawl from `start` visits, in the order of depth,
    parent and link. Each URL once; links to other sites and those not worth a visit are left out; a URL that isn't stored
    is a failed visit and leads nowhere. One join of the frontier with the links per level; the frontier, at most
    `max_pages` URLs, passes the driver."""
    spark = pages.sparkSession
    norm = lambda c: urls.normalized(F.col(c))
    stored = pages.groupBy(norm("url").alias("url")).agg(F.min("page_id").alias("page_id"))
    links = page_links(pages).join(pages.select("page_id", norm("url").alias("src")), "page_id").select("src", norm("dst_url").alias("dst"), "link_pos")
    links = links.where(urls.crawlable(F.col("dst")) & urls.same_site(F.col("dst"), F.lit(start), include_subdomains)).groupBy("src", "dst").agg(F.min("link_pos").alias("link_pos"))
    links, stored = links.persist(), stored.persist()  # read once per level
    schema = "visit long, url string, depth int, status string, page_id long"
    visits: list[tuple] = []
    first = spark.range(1).select(urls.normalized(F.lit(start)).alias("url"))
    frontier = [r.url for r in first.where(urls.crawlable(F.col("url"))).collect()]
    for level in range(depth + 1):
        frontier = frontier[: max_pages - len(visits)]
        if not frontier:
            break
        now = F.broadcast(spark.createDataFrame([(len(visits) + i, u) for i, u in enumerate(frontier)], "visit long, url string"))
        found = {r.url: r.page_id for r in stored.join(now, "url").select("url", "page_id").collect()}
        visits += [(len(visits) + i, u, level, "success" if u in found else "failed", found.get(u)) for i, u in enumerate(frontier)]
        if level == depth:
            break
        seen = F.broadcast(spark.createDataFrame([(v[1],) for v in visits], "url string"))
        new = links.join(now, F.col("src") == F.col("url")).select("visit", "link_pos", F.col("dst").alias("url")).join(seen, "url", "left_anti")
        new = new.groupBy("url").agg(F.min(F.struct("visit", "link_pos")).alias("at")).orderBy("at", "url").limit(max_pages - len(visits))
        frontier = [r.url for r in new.collect()]
    links.unpersist()
    stored.unpersist()
    return spark.createDataFrame(visits, schema)


def crawl_manifest(visits: DataFrame, titles: DataFrame) -> DataFrame:
    """(visit, url, title, depth, status, error, file_path) of visits, with the stored pages' titles (page_id, title)."""
    from pagemill.operators.notes import note_path

    d = visits.join(titles.select("page_id", "title"), "page_id", "left")
    title = F.when(F.col("status") == "success", F.coalesce("title", F.lit("Untitled"))).otherwise("Unknown")
    return d.select("visit", "url", title.alias("title"), "depth", "status", F.when(F.col("status") == "failed", "page not stored").alias("error"), F.when(F.col("status") == "success", note_path(title, "Clips", F.col("depth"))).alias("file_path"))


def step_filter(df: DataFrame, field: str, value: str) -> DataFrame:
    """Rows whose field, or that of `data` where the field is blank or missing, is the value."""
    own = F.nullif(F.col(field).cast("string"), F.lit("")) if field in df.columns else F.lit(None).cast("string")
    inner = F.col(f"data.{field}").cast("string") if "data" in df.columns and field in df.schema["data"].dataType.fieldNames() else F.lit(None).cast("string")
    return df.where(F.coalesce(own, inner) == value)


def step_tags(df: DataFrame, tags: list[str]) -> DataFrame:
    return df.withColumn("tags", F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in tags]).cast("array<string>")))


def step_top(df: DataFrame, n: int | None = None) -> DataFrame:
    """The first n successful rows by seq, or all of them."""
    ok = df.where("success")
    return ok.orderBy("seq").limit(n) if n is not None else ok


def run_steps(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A chain of steps as one lazy plan."""
    for step in steps:
        df = df.transform(step)
    return df
