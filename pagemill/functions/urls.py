"""URL expressions. All are native, so they stay in generated code and filters on them reach the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let

# The query keys that only track, the file endings and path prefixes that a crawl leaves out.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
BINARY = "pdf zip tar gz rar 7z png jpg jpeg gif webp svg ico mp3 mp4 avi mov wav flac doc docx xls xlsx ppt pptx exe dmg apk app".split()
NO_CONTENT = ["/login", "/signin", "/signup", "/register", "/logout", "/admin", "/api/", "/search", "/tag/", "/tags/"]

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def normalized(url: Column) -> Column:
    """Scheme, host and path without one final slash; the query without tracking keys, a repeated key at its first
    place with its last value; no fragment. What isn't a URL stays as it is."""
    return let(url, _normalized)


def _normalized(url: Column) -> Column:
    pairs = F.filter(F.split(F.regexp_replace(F.regexp_extract(url, PARTS, 4), r"^\?", ""), "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    kept = F.filter(pairs, lambda p: ~F.substring_index(p, "=", 1).isin(TRACKING))
    last = let(kept, lambda kept: F.transform(F.array_distinct(F.transform(kept, lambda p: F.substring_index(p, "=", 1))), lambda k: F.element_at(F.filter(kept, lambda p: F.substring_index(p, "=", 1) == k), -1)))
    query = F.array_join(last, "&")
    base = F.concat(F.lower(F.regexp_extract(url, PARTS, 1)), F.lit("://"), host(url), F.regexp_replace(path(url), "/$", ""))
    return F.when(url.rlike(PARTS), F.concat(base, F.regexp_replace(query, "^(?=.)", "?"))).otherwise(url)


def resolved(base: Column, href: Column) -> Column:
    """The http(s) URL that href means on a page with URL base: absolute, without scheme, from the root, query only,
    fragment only, or relative with `./` and `../` folded. Null for other schemes and where base isn't a URL."""
    return let(F.struct(base.alias("base"), F.trim(href).alias("href")), lambda x: _resolved(x.base, x.href))


def _resolved(base: Column, href: Column) -> Column:
    scheme = F.lower(F.regexp_extract(base, PARTS, 1))

    def folded(whole: Column) -> Column:
        parts = F.split(F.substring(F.regexp_replace(whole, "(^|/)[.]{1,2}$", "$0/"), 2, 1 << 30), "/")
        up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == ".", a).when(p == "..", up(a)).otherwise(F.concat(a, F.array(p))))
        return F.array_join(kept, "/")

    plain = F.regexp_replace(href, r"[?#].*$", "")
    folder = F.regexp_replace(F.regexp_replace(path(base), "^$", "/"), r"[^/]*$", "")
    whole = let(F.when(href.startswith("/"), plain).otherwise(F.concat(folder, plain)), folded)
    return (
        F.when(href.rlike(r"(?i)^https?://[^/]"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | ~base.rlike(r"(?i)^https?://[^/]"), None)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(scheme, F.lit("://"), host(base), F.lit("/"), whole, F.regexp_extract(href, r"[?#].*$", 0)))
    )


# The patterns of page types, in order.
def page_type(url: Column, content_type: Column | None = None) -> Column:
    pdf = url.rlike(r"(?i)^https?://.*\.pdf(\?|$)")
    if content_type is not None:
        pdf = pdf | F.coalesce(F.lower(content_type).startswith("application/pdf"), F.lit(False))
    return (
        F.when(url.rlike(r"^https?://(www\.|mobile\.)?(twitter|x)\.com/"), "twitter")
        .when(url.rlike(r"^https?://(www\.)?youtube\.com/(watch|shorts)"), "youtube")
        .when(pdf, "pdf")
        .otherwise("web")
    )


def crawlable(url: Column) -> Column:
    p = F.lower(path(url))
    return url.rlike(r"(?i)^https?://") & ~p.rlike(rf"\.({'|'.join(BINARY)})$") & ~p.rlike(rf"^({'|'.join(NO_CONTENT)})")


def site_key(url: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def same_site(a: Column, b: Column, include_subdomains: bool = True) -> Column:
    """Whether two URLs are of one site: of one host, or with equal last two labels."""
    same = host(a) == host(b)
    return same | (site_key(a) == site_key(b)) if include_subdomains else same


def host_suffixes(h: Column) -> Column:
    """A host and its parents: a.b.c, b.c, c. Rules that name a host or a parent meet it by equality."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


# Patterns of keys in URLs, as (site, host, pattern of path and query); the first group is the key, the
# second, if there is one, a further key.
SITE_KEYS = [
    ("video", r"youtube\.com$", r"^/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})"), ("video", r"youtube\.com$", r"^/(?:v|shorts|embed|live)/([A-Za-z0-9_-]{11})"), ("video", r"^youtu\.be$", r"^/([A-Za-z0-9_-]{11})"),
    ("post", r"(?:twitter|x)\.com$", r"^/[^/]+/status/([0-9]+)"), ("product", r"amazon\.[a-z.]+$", r"(?i)/(?:dp|gp/product|gp/aw/d|product|asin)/([A-Z0-9]{10})(?:[/?]|$)"),
    ("paper", r"arxiv\.org$", r"^/(?:abs|pdf|html)/([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(v[0-9]+)?"), ("question", r"(?:stackoverflow|stackexchange|serverfault|superuser)\.com$", r"^/(?:questions|q)/([0-9]+)"),
    ("story", r"^news\.ycombinator\.com$", r"^/item\?(?:[^#]*&)?id=([0-9]+)"), ("issue", r"^github\.com$", r"^/([^/]+/[^/]+)/(?:issues|pull)/([0-9]+)"), ("repo", r"^github\.com$", r"^/([^/?]+/[^/?]+)"),
    ("forum", r"reddit\.com$", r"^/r/([^/]+)(?:/comments/([a-z0-9]+))?"), ("wiki", r"wikipedia\.org$", r"^/wiki/([^?]+)"), ("letter", r"substack\.com$", r"^/p/([^/?]+)"),
]


def site_key_of(url: Column) -> Column:
    """(site, key, key2) of a URL, null where no pattern fits."""
    h = F.regexp_replace(host(url), r"^(www|m|old|new|mobile)\.|:[0-9]+$", "")
    tail = F.concat(path(url), F.regexp_extract(url, PARTS, 4))
    one = lambda s, hp, p: F.when(h.rlike(hp) & tail.rlike(p), F.struct(F.lit(s).alias("site"), (F.upper if s == "product" else lambda x: x)(F.regexp_extract(tail, p, 1)).alias("key"), (F.nullif(F.regexp_extract(tail, p, 2), F.lit("")) if p.count("(") - p.count("(?") > 1 else F.lit(None).cast("string")).alias("key2")))
    return F.coalesce(*[one(*k) for k in SITE_KEYS])


# Hosts and paths of recipes.
RECIPE_HOSTS = "allrecipes.com foodnetwork.com seriouseats.com bonappetit.com tasty.co recipetineats.com epicurious.com food52.com simplyrecipes.com".split()


def page_kind(url: Column) -> Column:
    """What a page of a known site is: repo, issue, pr, code, gist; story, listing; recipe; else other."""
    h, p = F.regexp_replace(host(url), r"^www\.", ""), path(url)
    code = h == "github.com"
    return (
        F.when(h == "gist.github.com", "gist").when(code & p.rlike("^/[^/]+/[^/]+/issues/[0-9]+"), "issue").when(code & p.rlike("^/[^/]+/[^/]+/pull/[0-9]+"), "pr").when(code & p.rlike("^/[^/]+/[^/]+/(blob|tree)/"), "code").when(code & p.rlike("^/[^/]+/[^/]+/?$"), "repo")
        .when((h == "news.ycombinator.com") & (p == "/item"), "story").when((h == "news.ycombinator.com") & p.rlike("^/?(news|newest|front|ask|show|best)?$"), "listing")
        .when(F.arrays_overlap(host_suffixes(h), F.array(*[F.lit(r) for r in RECIPE_HOSTS])) | p.rlike("(?i)/recipes?/"), "recipe").otherwise("other")
    )
