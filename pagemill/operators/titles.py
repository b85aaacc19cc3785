"""Titles: cleaned, suggested, rendered from templates. All within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.text import collapsed, let, title_decoded

# What is cut from titles, in order; then the prefixes, in order.
SUFFIXES = [
    r"(?i)\s*[-|–—•]\s*Medium$", r"(?i)\s*[-|–—•]\s*YouTube$", r"(?i)\s*[-|–—•]\s*GitHub$", r"(?i)\s*[-|–—•]\s*Reddit$", r"(?i)\s*[-|–—•]\s*Twitter$", r"(?i)\s*[-|–—•]\s*X$",
    r"(?i)\s*[-|–—•]\s*Stack Overflow$", r"(?i)\s*[-|–—•]\s*Stack Exchange$", r"(?i)\s*[-|–—•]\s*Hacker News$", r"(?i)\s*[-|–—•]\s*YouTube$", r"(?i)\s*[-|–—•]\s*Wikipedia$",
    r"(?i)\s*[-|–—•]\s*Substack$", r"(?i)\s*[-|–—•]\s*LinkedIn$", r"(?i)\s*[-|–—•]\s*Facebook$", r"(?i)\s*\|\s*[A-Z][a-zA-Z\s]+$", r"(?i)\s*[-–—]\s*[A-Z][a-zA-Z\s]+$",
    r"(?i)^\s*Breaking:\s*", r"(?i)^\s*News:\s*", r"(?i)^\s*Update:\s*", r"\s*\.\.\.$", r"\s*…$",
]
PREFIXES = [
    r"(?i)^\s*GitHub\s*[-|–—•:]\s*", r"(?i)^\s*Reddit\s*[-|–—•:]\s*", r"(?i)^\s*YouTube\s*[-|–—•:]\s*", r"(?i)^\s*Twitter\s*[-|–—•:]\s*", r"(?i)^\s*Hacker News\s*[-|–—•:]\s*",
    r"(?i)^\s*Stack Overflow\s*[-|–—•:]\s*",
]
# What is cut from the end for the short form, in order; words that stay small.
ENDS = [r"\s*\([^)]*\)\s*$", r"\s*\[[^\]]*\]\s*$", r"\s*[-|–—]\s*\d{4}\s*$", r"\s*[-|–—]\s*[A-Z][a-z]+\s+\d{4}\s*$", r"\s*#\d+\s*$"]
SMALL = "a an the and but or nor for yet so at by in of on to up via with from as is it de la le du da di van von".split()


def capitalised(text: Column) -> Column:
    """Title case as it is done there: only a word that ends in something else than a letter or digit changes. Its first
    letter goes up and the rest down; a small word goes down, but for the first one and in titles in capitals."""
    return let(text, _capitalised)


def _capitalised(text: Column) -> Column:
    loud = (text == F.upper(text)) & text.rlike("[A-Z]")

    def word(w: Column, i: Column) -> Column:
        core = F.regexp_replace(F.regexp_replace(w, "^[^a-zA-Z0-9]+", ""), "[^a-zA-Z0-9]+$", "")
        lead, trail = F.regexp_extract(w, "^[^a-zA-Z0-9]*", 0), F.regexp_extract(w, "[^a-zA-Z0-9]*$", 0)
        up = F.concat(lead, F.upper(F.substring(core, 1, 1)), F.lower(F.substring(core, 2, 1 << 20)), trail)
        low = F.concat(lead, F.lower(core), trail)
        return F.when((trail == "") | (core == ""), w).when((i > 0) & ~loud & F.lower(core).isin(SMALL), low).otherwise(up)

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def cleaned(title: Column, remove: tuple[str, ...] = (), case: bool = True) -> Column:
    for pattern in (*(f"(?i){p}" for p in remove), *SUFFIXES, *PREFIXES):
        title = F.regexp_replace(title, pattern, "")
    title = collapsed(title_decoded(title))
    title = F.regexp_replace(F.regexp_replace(title, r"^[-|–—•:\s]+", ""), r"[-|–—•:\s]+$", "")
    return capitalised(title) if case else title


def deep_cleaned(title: Column, remove: tuple[str, ...] = ()) -> Column:
    title = cleaned(title, remove, False)
    for pattern in ENDS:
        title = F.regexp_replace(title, pattern, "")
    return capitalised(F.trim(title))


def cut(title: Column, most: int = 100) -> Column:
    """At most `most` characters and an ellipsis, between words if that leaves over 60 % of them."""
    return let(title, lambda t: _cut(t, most))


def _cut(title: Column, most: int) -> Column:
    head = F.substring(title, 1, most)
    space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    return F.when(F.length(title) <= most, title).otherwise(F.concat(F.trim(F.when(space > most * 0.6, F.substring(head, F.lit(1), space)).otherwise(head)), F.lit("…")))


def clean_titles(df: DataFrame, col: str = "title") -> DataFrame:
    """df with clean_title and short_title."""
    return df.withColumn("clean_title", cut(cleaned(F.col(col)))).withColumn("short_title", cut(deep_cleaned(F.col(col))))


def first_heading(md: Column) -> Column:
    """The first # heading of a Markdown text, else its first line if that has 6 to 149 characters."""
    heading = F.trim(F.regexp_replace(F.regexp_extract(md, r"(?m)^#{1,6}[ \t]+(.+)$", 1), r"\s+#+$", ""))
    line = F.trim(F.substring_index(md, "\n", 1))
    plain = F.trim(F.regexp_replace(F.regexp_replace(line, r"^#+\s*", ""), "[*_`~]", ""))
    return F.when(heading != "", heading).when(F.length(line).between(6, 149), plain)


def suggest_titles(df: DataFrame, most: int = 3) -> DataFrame:
    """(page_id, rank, title, confidence, source) for pages with title, headline, name, og_title, twitter_title, markdown: the
    best titles, each once whatever its case and spaces; Untitled where there is none."""
    c = {n: F.nullif(F.col(n), F.lit("")) for n in ("title", "headline", "name", "og_title", "twitter_title")}
    differs = lambda a, *others: F.forall(F.array(*[F.coalesce(a != o, F.lit(True)) for o in others]), lambda x: x)
    df = df.withColumns({"_deep": deep_cleaned(c["title"]), "_head": first_heading(F.coalesce("markdown", F.lit("")))})
    head, deep = F.col("_head"), F.col("_deep")
    found = [
        (c["title"].isNotNull(), cleaned(c["title"]), 0.9, "original"), (differs(c["headline"], c["title"]), cleaned(c["headline"]), 0.85, "headline"),
        (differs(c["name"], c["title"], c["headline"]), cleaned(c["name"]), 0.8, "headline"), (differs(c["og_title"], c["title"]), cleaned(c["og_title"]), 0.75, "og"),
        (differs(c["twitter_title"], c["title"], c["og_title"]), cleaned(c["twitter_title"]), 0.7, "twitter"), (deep != c["title"], deep, 0.65, "cleaned"), (differs(head, c["title"]), cleaned(head), 0.5, "generated"),
    ]
    each = F.array(*[F.when(ok, F.struct(cut(t).alias("title"), F.lit(v).alias("confidence"), F.lit(s).alias("source"))) for ok, t, v, s in found])
    each = F.filter(each, lambda x: x.isNotNull() & x.title.isNotNull())
    d = df.select("page_id", each.alias("e")).select("page_id", "e", F.transform("e", lambda x: F.lower(collapsed(x.title))).alias("k"))
    # candidates come by falling confidence, so the first of a key is the best
    kept = F.slice(F.filter("e", lambda x, i: F.array_position(F.col("k"), F.lower(collapsed(x.title))) == i + 1), 1, most)
    none = F.array(F.struct(F.lit("Untitled").alias("title"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("source")))
    d = d.select("page_id", F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(none)).alias("pos", "s"))
    return d.select("page_id", (F.col("pos") + 1).cast("long").alias("rank"), "s.title", "s.confidence", "s.source")


def render_titles(df: DataFrame, template: str) -> DataFrame:
    """df (title, url, page_type, author, site_name, tags, folder, clipped_at) with `rendered`: the template with its
    placeholders filled in and spaces, slashes and double dashes cleaned up."""
    t = F.col("clipped_at")
    domain = F.coalesce(F.nullif(F.regexp_replace(urls.host(F.col("url")), r"^www\.", ""), F.lit("")), F.lit("unknown"))
    or_else = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), v if isinstance(v, Column) else F.lit(v))
    folder = F.coalesce(F.nullif(F.element_at(F.filter(F.split("folder", "/"), lambda p: p != ""), -1), F.lit("")), F.lit("Clips")) if "folder" in df.columns else F.lit("Clips")
    values = {
        "title": or_else("title", "Untitled"), "date": F.date_format(t, "yyyy-MM-dd"), "time": F.date_format(t, "HH-mm"), "datetime": F.date_format(t, "yyyy-MM-dd-HH-mm"), "year": F.date_format(t, "yyyy"),
        "month": F.date_format(t, "MM"), "day": F.date_format(t, "dd"), "domain": domain, "type": or_else("page_type", "web"), "author": or_else("author", "Unknown"), "siteName": or_else("site_name", domain),
        "tags": F.coalesce(F.get("tags", F.lit(0)), F.lit("untagged")), "folder": folder,
    }
    out: Column = F.lit(template)
    for name, value in values.items():
        if f"{{{name}}}" in template:
            out = F.replace(out, F.lit(f"{{{name}}}"), value)
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), "/+", "/"), r"\s*-\s*-\s*", " - ")
    return df.withColumn("rendered", F.regexp_replace(F.trim(out), r"^[\s/-]+|[\s/-]+$", ""))
