"""What a page says about itself: meta and link tags, keywords, JSON-LD. Within a row, without any shuffle but the choice
of the best JSON-LD node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.text import blank_as_null, collapsed, decoded, first_of_each
from pagemill.operators.html import attribute, raw_attribute
from pagemill.operators.structure import once

# Where author and publishing time are looked for, in order; the types of JSON-LD that are preferred.
AUTHOR = ["author", "article:author", "byl", "parsely-author", "sailthru.author"]
PUBLISHED = ["article:published_time", "og:published_time", "date", "publishdate", "pubdate", "datepublished", "dc.date"]
TYPES = ["NewsArticle", "Article", "BlogPosting", "WebPage"]
OG = {"og_title": "og:title", "og_description": "og:description", "og_type": "og:type", "og_site_name": "og:site_name", "og_locale": "og:locale"}
TWITTER = {"twitter_card": "twitter:card", "twitter_title": "twitter:title", "twitter_description": "twitter:description", "twitter_site": "twitter:site", "twitter_creator": "twitter:creator"}

COMMENT_OR_SCRIPT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def with_metas(pages: DataFrame, with_head: bool = False) -> DataFrame:
    """pages with `metas`, the meta tags' (key, content) in order, and `links`, the link tags; both are worked out once, and html is read
    without comments and scripts once."""
    kept, head = pages.columns, F.col("_head")
    pages = once(pages.withColumn("_head", F.regexp_replace("html", COMMENT_OR_SCRIPT, "")), "_head")
    tags = F.regexp_extract_all(head, F.lit(r"(?is)<meta\s[^>]*>"), F.lit(0))

    def meta(tok: Column) -> Column:
        key = F.coalesce(*[F.nullif(raw_attribute(tok, n), F.lit("")) for n in ("property", "name", "http-equiv")])
        return F.struct(F.lower(key).alias("key"), collapsed(attribute(tok, "content")).alias("content"))

    d = pages.select(*kept, "_head", F.filter(F.transform(tags, meta), lambda m: m.key.isNotNull() & (m.content != "")).alias("metas"), F.regexp_extract_all(head, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0)).alias("links"))
    return once(d, "metas", "links").select(*kept, "metas", "links", *(["_head"] if with_head else []))


def contents(*keys: str) -> Column:
    return F.transform(F.filter("metas", lambda m: m.key.isin(*keys)), lambda m: m.content)


def first_meta(*keys: str) -> Column:
    """The first content of the first of the keys that has one."""
    return F.coalesce(*[F.get(contents(k), F.lit(0)) for k in keys])


def link_href(test) -> Column:
    return F.get(F.filter(F.transform(F.filter("links", test), lambda t: attribute(t, "href")), lambda h: h != ""), F.lit(0))


def page_metadata(pages: DataFrame, og: bool = True) -> DataFrame:
    """One row per page: title, headline, description, author, published, canonical URL, Open Graph and Twitter fields, images,
    site name and language; null where the page doesn't tell."""
    base = F.col("url")
    canonical = F.coalesce(link_href(lambda t: F.lower(raw_attribute(t, "rel")) == "canonical"), link_href(lambda t: (F.lower(raw_attribute(t, "rel")) == "alternate") & (F.lower(raw_attribute(t, "hreflang")) == "x-default")))
    og_url = urls.resolved(base, first_meta("og:url"))
    images = first_of_each(F.filter(F.transform(contents("og:image"), lambda u: urls.resolved(base, u)), lambda u: u.isNotNull()), lambda u: u)
    html = F.col("_head")
    site = F.coalesce(first_meta("og:site_name", "application-name"), F.regexp_replace(first_meta("twitter:site"), "^@", ""))
    lang = blank_as_null(collapsed(attribute(F.regexp_extract(html, r"(?is)<html\b[^>]*>", 0), "lang")))
    text = lambda tag: blank_as_null(collapsed(decoded(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), r"<[^>]*>", ""))))
    d = with_metas(pages, with_head=True)
    return d.select(
        "page_id", "url", text("title").alias("title"), text("h1").alias("headline"), first_meta("description", "og:description").alias("description"), first_meta(*AUTHOR).alias("author"), first_meta(*PUBLISHED).alias("published"),
        F.coalesce(urls.resolved(base, canonical), og_url if og else F.lit(None)).alias("canonical_url"), *[first_meta(key).alias(name) for name, key in OG.items()], og_url.alias("og_url"), F.when(F.size(images) > 0, images).alias("og_images"),
        *[first_meta(key).alias(name) for name, key in TWITTER.items()], urls.resolved(base, first_meta("twitter:image", "twitter:image:src")).alias("twitter_image"),
        site.alias("site_name"), F.coalesce(lang, first_meta("og:locale", "content-language")).alias("language"), page_keywords_of("metas").alias("keywords"),
    )


def page_keywords_of(metas: str) -> Column:
    """Keywords of meta tags: keywords, article:tag, news_keywords; each once, in order."""
    split = lambda values: F.flatten(F.transform(values, lambda v: F.split(v, ",")))
    words = F.filter(F.transform(F.concat(split(contents("keywords")), contents("article:tag"), split(contents("news_keywords"))), collapsed), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_distinct(words))


def page_keywords(pages: DataFrame) -> DataFrame:
    """(page_id, pos, keyword)."""
    d = with_metas(pages).select("page_id", page_keywords_of("metas").alias("k"))
    # an inner explode would have the keywords worked out once more, in a filter that is pushed into the tags
    return d.select("page_id", F.posexplode_outer("k").alias("pos", "keyword")).where("pos is not null")


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, seq, node): objects of the JSON-LD scripts as variants. Wrappers are cut, scripts that don't parse dropped;
    arrays are flattened, items of a @graph come before the object that holds it."""
    scripts = F.regexp_extract_all("html", F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""), F.lit(1))
    d = pages.select("page_id", F.posexplode(scripts).alias("script_no", "raw"))
    raw = F.trim("raw")
    for pattern in (r"^\s*<!--", r"-->\s*$", r"(?i)^\s*/\*\s*<!\[CDATA\[\s*\*/\s*", r"(?i)\s*/\*\s*\]\]>\s*\*/\s*$"):
        raw = F.regexp_replace(raw, pattern, "")
    d = d.withColumn("v", F.try_parse_json(F.trim(raw))).where("v is not null")
    d = d.selectExpr("page_id", "script_no", "posexplode(coalesce(try_variant_get(v, '$', 'array<variant>'), array(v))) as (item_no, item)")
    d = d.selectExpr("page_id", "script_no", "item_no", "posexplode(concat(coalesce(try_variant_get(item, '$[\"@graph\"]', 'array<variant>'), array()), array(item))) as (node_no, node)")
    d = d.where("startswith(schema_of_variant(node), 'OBJECT')")
    return d.select("page_id", (F.col("script_no") * (1 << 40) + F.col("item_no") * (1 << 20) + F.col("node_no")).cast("long").alias("seq"), "node")


def _strings(v: str, part: str) -> str:
    """SQL for the strings of a variant that is a string, an object with this part, or an array of these."""
    one = lambda x: f"case when schema_of_variant({x}) = 'STRING' then try_variant_get({x}, '$', 'string') when schema_of_variant(try_variant_get({x}, '$.{part}', 'variant')) = 'STRING' then try_variant_get({x}, '$.{part}', 'string') end"
    return f"filter(transform(coalesce(try_variant_get({v}, '$', 'array<variant>'), array({v})), x -> trim({one('x')})), x -> x <> '')"


def _string(key: str) -> str:
    at = f"try_variant_get(node, '$[\"{key}\"]', 'variant')"
    return f"case when schema_of_variant({at}) = 'STRING' then nullif(trim(try_variant_get(node, '$[\"{key}\"]', 'string')), '') end"


def _variant(*keys: str) -> str:
    return "coalesce(" + ", ".join(f"try_variant_get(node, '$[\"{k}\"]', 'variant')" for k in keys) + ")"


def best_jsonld(pages: DataFrame) -> DataFrame:
    """One row per page with a typed node: the fields of the node with the best type and the most of what matters; of equal
    ones the first."""
    d = jsonld_nodes(pages)
    d = d.withColumn("types", F.expr(f"array_distinct(transform({_strings(_variant('@type'), 'none')}, t -> regexp_replace(t, '(?i)^(https?://(www.)?schema.org/|schema:)', '')))"))
    d = d.where("size(types) > 0")
    fields = {
        "name": _string("name"), "headline": f"coalesce({_string('headline')}, {_string('name')})", "description": _string("description"), "authors": _strings(_variant("author", "creator"), "name"),
        "date_published": f"coalesce({_string('datePublished')}, {_string('dateCreated')})", "date_modified": f"coalesce({_string('dateModified')}, {_string('dateUpdated')})",
        "publisher": f"get({_strings(_variant('publisher'), 'name')}, 0)", "section": f"get({_strings(_variant('articleSection'), 'none')}, 0)", "images": _strings(_variant("image", "thumbnailUrl"), "url"),
        "keywords": f"array_distinct(filter(transform(flatten(transform({_strings(_variant('keywords'), 'none')}, k -> split(k, '[,\n]'))), k -> trim(k)), k -> k <> ''))",
        "word_count": "try_variant_get(node, '$.wordCount', 'double')",
    }
    own_headline = F.expr(_string("headline"))
    for name, sql in fields.items():
        d = d.withColumn(name, F.expr(sql))
    ranks = [F.when(F.array_contains("types", t), len(TYPES) - i).otherwise(0) for i, t in enumerate(TYPES)]
    some = lambda c, n: F.when(c, n).otherwise(0)
    score = F.greatest(*ranks) * 10 + some(F.size("authors") > 0, 2) + some(F.col("date_published").isNotNull(), 2) + some(own_headline.isNotNull(), 2)
    score = score + some(F.col("name").isNotNull(), 1) + some(F.col("description").isNotNull(), 1) + some(F.col("publisher").isNotNull(), 1) + some(F.size("images") > 0, 1)
    d = d.withColumn("score", score).withColumn("schema_type", F.coalesce(*[F.when(F.array_contains("types", t), t) for t in TYPES], F.get("types", F.lit(0))))
    kept = ["score", "schema_type", *fields]
    best = d.groupBy("page_id").agg(F.min_by(F.struct(*kept), F.struct(-F.col("score"), F.col("seq"))).alias("b"))
    return best.select("page_id", *[F.col(f"b.{c}").alias(c) for c in kept])
