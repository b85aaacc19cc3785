"""Records of known sites that need more than the first element of a field: children and siblings, scopes within scopes,
alternatives whose value has to be valid, chains in page order. They are read from the page structure: one scan, one
exchange, windows within a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import collapsed
from pagemill.operators.structure import BREAK, El, Pick, dealt, laid_out, page_hits, page_structure, picks, text_in, written

WHITE = r"[\x20\x09-\x0D\x{A0}]"


def trimmed(text: Column) -> Column:
    """Without white space at the ends; what lies between stays."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def ordered(field: str, value: Column | None = None, more: Column | None = None) -> Column:
    """The values of a field in page order, those that aren't empty, of each element once; `more` restricts them."""
    keep = (F.col("field") == field) & (F.coalesce("value", F.lit("")) != "")
    keep = keep & more if more is not None else keep
    return F.transform(F.array_distinct(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", (F.col("value") if value is None else value).alias("v")))))), lambda x: x.v)


def first_of(field: str) -> Column:
    return F.min_by(F.when(F.col("field") == field, F.col("value")), F.when(F.col("field") == field, F.col("pos")))


# --- block scoring

# What is taken out of a page before its blocks are scored, patterns of unlikely and of likely names, and bonuses.
OUT_TAGS = "script style link iframe nav footer header aside".split()
OUT_CLASSES = "ad advertisement sidebar comments comment navigation menu social share cookie popup modal newsletter".split()
OUT_ROLES = "complementary navigation".split()
UNLIKELY = (
    "ad|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|foot|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplement|ad-break|agegate|pagination|pager|popup|sub-sidebar",
    "print|archive|comment|article|discussion|email|share|login|signup|feedback",
)
LIKELY = "article|body|content|entry|main|post|text"
BONUSES = (("article|body|content|entry|main|page", 2, ("class", "id")), ("post|text|blog|story", 1, ("class",)))
OUT_OF_SCORING = (
    f"tag IN ({', '.join(repr(t) for t in OUT_TAGS)}) OR role IN ({', '.join(repr(r) for r in OUT_ROLES)}) OR arrays_overlap(split(class, '\\\\s+'), array({', '.join(repr(c) for c in OUT_CLASSES)}))"
    f" OR (tag NOT IN ('html', 'head', 'body') AND (class <> '' OR id <> '') AND (class RLIKE '(?i){'|'.join(UNLIKELY)}' OR id RLIKE '(?i){'|'.join(UNLIKELY)}') AND NOT concat(class, ' ', id) RLIKE '{LIKELY}')"
)


def block_scores(pages: DataFrame, least: int = 25) -> DataFrame:
    """(page_id, open_pos, tag, score, seq): every element that a block gives a score. Unlikely elements are removed first, with all
    that they hold, but for html, head and body. A p, pre or td of `least` characters gives its score, by length up to three
    hundreds, commas, full stops and its names, whole to its parent and half to the parent's parent; tables get none, nor
    does what is above them. seq tells which was given a score first."""
    s = page_structure(pages, OUT_OF_SCORING)
    text = F.col("text")

    def points(e: Column) -> Column:
        words = {"class": F.coalesce(F.get(e["values"], (F.array_position(e["names"], "class") - 1).cast("int")), F.lit("")), "id": e["id"]}
        t = trimmed(written(text_in(e)))
        out = F.least(F.length(t) / 100.0, F.lit(3.0)) + 0.5 * F.regexp_count(t, F.lit(",")) + F.regexp_count(t, F.lit(r"\."))
        for pattern, bonus, where in BONUSES:
            for name in where:
                out = out + F.when(words[name].rlike(pattern), bonus).otherwise(0)
        return F.when(F.length(t) >= least, out)

    holder = lambda e, seq: F.when(e.isNotNull(), F.struct(e["pos"].alias("pos"), e["tag"].alias("tag"), seq.alias("seq")))

    def given(e: Column) -> Column:
        up = F.get("elements", e["up"])
        top = F.get("elements", up["up"])
        return F.struct(points(e).alias("points"), holder(up, e["pos"] * 2).alias("up"), F.when(top["tag"] != "table", holder(top, e["pos"] * 2 + 1)).alias("top"))

    blocks = F.filter(F.transform(F.filter("elements", lambda e: e["tag"].isin("p", "pre", "td")), given), lambda g: g["points"].isNotNull() & (g["up"]["tag"] != "table"))
    shares = F.flatten(F.transform(blocks, lambda g: F.array(F.struct(g["up"].alias("to"), g["points"].alias("s")), F.struct(g["top"].alias("to"), (g["points"] / 2).alias("s")))))
    each = s.select("page_id", F.explode(shares).alias("g")).where("g.to is not null").select("page_id", "g.to.*", "g.s")
    return each.groupBy("page_id", F.col("pos").alias("open_pos"), "tag").agg(F.round(F.sum("s"), 6).alias("score"), F.min("seq").alias("seq"))


def best_blocks(pages: DataFrame, least: int = 25) -> DataFrame:
    """(page_id, open_pos, tag, score): of each page the element with the highest score, of equal ones the first given one."""
    b = block_scores(pages, least)
    return b.groupBy("page_id").agg(F.max_by(F.struct("open_pos", "tag", "score"), F.struct("score", -F.col("seq"))).alias("b")).select("page_id", "b.*")


# --- parts of any page

# Where the visible text of a page is looked for, in this order, and what gives a selection its context.
VISIBLE = (El("main"), El("article"), El(role="main"), El(cls="content"), El(cls="article-content"), El(cls="post-content"), El(cls="entry-content"), El(id="content"))
TITLED = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
CONTEXT_TAGS = "p li h1 h2 h3 h4 h5 h6 blockquote td th dd dt".split()
CONTEXT_ENDS = "article main body".split()
VISIBLE_PARTS = [*[Pick("root", x, "none", i) for i, x in enumerate(VISIBLE)], Pick("block", El(tags=TITLED), "raw"), Pick("para", El("p", inside=El("body")), "raw")]


def visible_texts(pages: DataFrame, blocks: int = 2, least: int = 200, longer: int = 50, most: int = 20) -> DataFrame:
    """(page_id, text): what shows of a page: of the first alternative whose first element holds more than `blocks` paragraphs and
    headings, with a text longer than `least`, their texts by blank lines; else the first `most` paragraphs longer than
    `longer`; else that nothing can be extracted. A page's roots, eight at most, meet its blocks within the row."""
    field, pos = F.col("field"), F.col("pos")
    h = page_hits(pages, VISIBLE_PARTS).withColumn("value", trimmed(F.col("value")))
    first = F.row_number().over(Window.partitionBy("page_id", "field", "rank").orderBy("pos")) == 1
    at = lambda name, *cols: F.array_sort(F.collect_list(F.when(field == name, F.struct(*cols))))
    h = h.withColumn("_first", first | (field != "root")).where("_first")
    d = h.groupBy("page_id").agg(at("root", "rank", "pos", "close").alias("roots"), at("block", "pos", "value").alias("blocks"), at("para", "pos", "value").alias("paras"))

    def held(root: Column) -> Column:
        inner = F.filter("blocks", lambda b: (b["pos"] > root["pos"]) & (b["pos"] <= root["close"]))
        text = F.array_join(F.transform(F.filter(inner, lambda b: b["value"] != ""), lambda b: b["value"]), "\n\n")
        return F.when((F.size(inner) > blocks) & (F.length(text) > least), text)

    rest = F.array_join(F.slice(F.transform(F.filter("paras", lambda p: F.length(p["value"]) > longer), lambda p: p["value"]), 1, most), "\n\n")
    text = F.coalesce(F.get(F.array_compact(F.transform("roots", held)), F.lit(0)), F.nullif(rest, F.lit("")), F.lit("No extractable content found."))
    return pages.select("page_id").join(d.select("page_id", text.alias("text")), "page_id", "left").select("page_id", F.coalesce("text", F.lit("No extractable content found.")).alias("text"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text): the text of the whole page, over which ranges are counted in characters; a line ends where a block element
    begins or ends. References count as they are written."""
    return laid_out(dealt(pages), tags=("",)).select("page_id", F.replace(F.decode("text", "UTF-8"), F.lit(BREAK), F.lit("\n")).alias("text"))


def selection_contexts(pages: DataFrame, spans: DataFrame, longest: int = 200) -> DataFrame:
    """(page_id, context) of the first range (page_id, range_no, start, end) of each page that isn't empty, over page_texts():
    the text of the innermost block around the whole range that has one of up to twice `longest` characters, cut to `longest`;
    null where none lies within the innermost article, main or body. A range finds its blocks by offsets in the page's row."""
    first = spans.where("end > start").groupBy("page_id").agg(F.min_by(F.struct("start", "end"), "range_no").alias("r"))
    d = page_structure(pages).join(first, "page_id")
    text = F.decode("text", "UTF-8")
    d = d.withColumn("b0", F.octet_length(F.substring(text, F.lit(1), F.col("r.start").cast("int")))).withColumn("b1", F.octet_length(F.substring(text, F.lit(1), F.col("r.end").cast("int"))))
    around = F.filter("elements", lambda e: (e["start"] <= F.col("b0")) & (e["start"] + e["size"] >= F.col("b1")) & e["tag"].isin(*CONTEXT_TAGS, *CONTEXT_ENDS))
    d = d.withColumn("around", around)
    end = F.coalesce(F.array_max(F.transform(F.filter("around", lambda e: e["tag"].isin(CONTEXT_ENDS)), lambda e: e["pos"])), F.lit(-1))
    texts = F.transform(F.filter("around", lambda e: e["tag"].isin(CONTEXT_TAGS) & (e["pos"] > end)), lambda e: trimmed(written(text_in(e))))
    context = F.get(F.reverse(F.filter(texts, lambda t: F.length(t).between(1, 2 * longest))), F.lit(0))
    return d.select("page_id", F.when(F.length(context) > longest, F.concat(F.substring(context, 1, longest), F.lit("…"))).otherwise(context).alias("context"))


# --- encyclopedia pages

# Where the parts of an article lie.
BOX = El(any_cls=("infobox", "mw-infobox"))
ROW = El("tr", inside=BOX)
BODY = El(cls="mw-parser-output", inside=El(id="mw-content-text"))
LASTMOD = (El(id="footer-info-lastmod"), El(cls="mw-last-modified"))
ENCYCLOPEDIA = [
    *picks("title", El(id="firstHeading"), El(cls="mw-first-heading")), Pick("short", El(cls="shortdescription")), Pick("hatnote", El(cls="hatnote"), "raw"),
    Pick("caption", El("caption", inside=BOX), "raw"), Pick("caption", El(cls="infobox-title", inside=BOX), "raw"), Pick("image", El("img", inside=BOX), "src"),
    Pick("head", El("th", under=ROW), "raw"), Pick("cell", El("td", under=ROW), "raw"),
    Pick("body", BODY, "none"), Pick("para", El("p", under=BODY, without="mw-empty-elt"), "raw"), Pick("stop", El(tags=("h2", "h3", "h4", "h5", "h6"), under=BODY), "none"),
    Pick("category", El("a", inside=El("li", inside=El("ul", inside=El(id="mw-normal-catlinks")))), "raw"), Pick("category", El("a", inside=El(cls="mw-normal-catlinks")), "raw"),
    *[Pick("stamp", El("time", inside=x), "datetime") for x in LASTMOD], *[Pick("stamp_text", El("time", inside=x)) for x in LASTMOD], *[Pick("edited", x) for x in LASTMOD],
    Pick("other", El(any_cls=("disambiguation", "disambig")), "none"), Pick("other", El(id="disambig"), "none"),
    Pick("item", El("li", inside=El("ul", inside=BODY)), "raw"), Pick("item", El("dd", inside=El("dl", inside=BODY)), "raw"), Pick("link", El("a", inside=BODY), "raw"), Pick("href", El("a", inside=BODY), "href"),
]


def article_title(url: Column) -> Column:
    """The title that an article's URL carries; null for other pages."""
    name = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/wiki/([^?#]*)", 1)
    return F.when(url.rlike(r"^[a-z]+://[^/?#]+/wiki/"), F.replace(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" ")))


def article_language(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z]+://([a-z]+)\.wikipedia\.org(?:[/?#:]|$)", 1), F.lit("")), F.lit("en"))


def without_notes(text: Column) -> Column:
    """Without the numbers of notes."""
    return collapsed(F.regexp_replace(text, r"\[[0-9]+\]", ""))


def encyclopedia_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, short, infobox, lead, categories, modified, is_disambiguation, entries). The infobox is an array of (key,
    value) in page order, of equal keys the last value at the first place; th and td of a row are children of it. The lead is up to two
    paragraphs of more than 50 characters, children of the body before its first heading. Entries are the first 20 list items that
    have a link: (title, description of 200 characters at most, link)."""
    page, row = Window.partitionBy("page_id"), Window.partitionBy("page_id", "parent")
    field, pos = F.col("field"), F.col("pos")
    at = lambda name: F.when(field == name, pos)
    h = page_hits(pages, ENCYCLOPEDIA, {"box": BOX})
    in_order = Window.partitionBy("page_id", "field").orderBy("pos")
    # windows over whole pages come first, so that hits are dealt by page, once
    h = h.withColumn("box", F.min(at("scope")).over(page)).withColumn("body", F.min(at("body")).over(page))
    h = h.withColumn("stop", F.min(F.when((field == "stop") & (F.col("parent") == F.col("body")), pos)).over(page))
    # a row's first th is its key, its first td its value
    cell = F.when(field == "cell", F.col("value"))
    h = h.withColumn("cell", F.min_by(cell, at("cell")).over(row)).withColumn("is_key", (field == "head") & (pos == F.min(at("head")).over(row)))
    # an item's link is the next one in page order, if it lies before the item's end
    after = Window.partitionBy("page_id").orderBy(pos.desc(), field).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("link", F.last(F.when(field == "link", F.struct("pos", "value")), ignorenulls=True).over(after)).withColumn("href", F.last(F.when(field == "href", F.struct("pos", "value")), ignorenulls=True).over(after))
    in_box = F.col("scope") == F.col("box")
    key = F.regexp_replace(F.substring(F.regexp_replace(F.lower(trimmed(F.col("value"))), rf"(?:{WHITE}|:)+", "_"), 1, 50), "[^a-z0-9_]", "_")
    value = without_notes(F.coalesce("cell", F.lit("")))
    pair = (
        F.when(F.col("is_key") & in_box & (value != "") & (F.length(value) < 500) & (key != "") & ~key.startswith("infobox"), F.struct(pos.alias("pos"), key.alias("key"), value.alias("value")))
        .when((field == "caption") & in_box & (trimmed(F.col("value")) != ""), F.struct(F.lit(-2).alias("pos"), F.lit("title").alias("key"), trimmed(F.col("value")).alias("value")))
        .when((field == "image") & in_box & (F.col("value") != ""), F.struct(F.lit(-1).alias("pos"), F.lit("image").alias("key"), F.regexp_replace("value", "^//", "https://").alias("value")))
    )
    first_only = F.when(field.isin("caption", "image"), pos == F.min(F.when(in_box, pos)).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).otherwise(True)
    h = h.withColumn("pair", F.when(first_only, pair)).withColumn("item_no", F.when(field == "item", F.row_number().over(in_order)))
    text = trimmed(F.col("value"))
    lead = (F.col("parent") == F.col("body")) & (F.col("stop").isNull() | (pos < F.col("stop"))) & (F.length(text) > 50)
    title = trimmed(F.col("link.value"))
    rest = F.when((title != "") & F.startswith(text, title), trimmed(F.regexp_replace(F.substr(text, F.length(title) + 1), rf"^(?:{WHITE}|[-–—:])+", ""))).otherwise(text)
    entry = F.when(
        (F.col("item_no") <= 20) & (F.col("link.pos") <= F.col("close")) & (F.length(title) > 1),
        F.struct("pos", title.alias("title"), F.substring(rest, 1, 200).alias("description"), F.when(F.col("href.pos") == F.col("link.pos"), F.regexp_replace("href.value", "^/", "https://en.wikipedia.org/")).otherwise("").alias("link")),
    )
    day = F.nullif(F.regexp_extract(first_of("edited"), r"([0-9]+\s+\w+\s+[0-9]{4})", 1), F.lit(""))
    titles = F.coalesce(first_of("title"), F.lit(""))
    d = h.groupBy("page_id").agg(
        titles.alias("title"), first_of("short").alias("short"), F.array_sort(F.collect_list("pair")).alias("pairs"), F.slice(ordered("para", without_notes(F.col("value")), lead), 1, 2).alias("lead"),
        F.array_distinct(ordered("category", text, text != "")).alias("categories"), F.coalesce(F.nullif(first_of("stamp"), F.lit("")), F.nullif(first_of("stamp_text"), F.lit("")), day).alias("modified"),
        (F.count_if(field == "other") > 0).alias("other"), F.contains(F.lower(F.coalesce(first_of("hatnote"), F.lit(""))), F.lit("disambiguation")).alias("hat"), F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    keys = F.array_distinct(F.transform("pairs", lambda x: x.key))
    box = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter("pairs", lambda x: x.key == k), -1).value.alias("value")))
    return d.select(
        "page_id", "title", "short", box.alias("infobox"), F.nullif(F.array_join("lead", "\n\n"), F.lit("")).alias("lead"), "categories", "modified",
        (F.col("other") | F.contains(F.lower("title"), F.lit("(disambiguation)")) | F.col("hat")).alias("is_disambiguation"), F.transform("entries", lambda x: F.struct(x.title.alias("title"), x.description.alias("description"), x.link.alias("link"))).alias("entries"),
    )


# --- social posts


def _part(name: str, tag: str = "") -> El:
    return El(tag, attr="data-testid", op="equals", value=name)


POST = _part("tweet", "article")
QUOTE = El("div", role="link", inside=_part("tweet"))
CARD = El(attr="data-testid", op="begins", value="card")
SOCIAL = [
    Pick("text", _part("tweetText", "div"), "raw"), Pick("handle", El("a", role="link", attr="href", op="begins", value="/"), "href"), Pick("stamp", El("time"), "datetime"), Pick("stamp_text", El("time")),
    Pick("image", El("img", inside=_part("tweetPhoto", "div")), "src"), Pick("video", El("video"), "none"), Pick("poster", El("video"), "poster"), Pick("loop", El("video", attr="loop"), "none"), Pick("source", El("source", inside=El("video")), "src"),
    Pick("count", El("button", attr="aria-label"), "aria-label"), Pick("whole", QUOTE, "raw"), Pick("verified", _part("icon-verified"), "none"),
    Pick("card_url", El("a", attr="href", inside=CARD), "href"), Pick("card_title", El(tags=("h2",), inside=CARD)), Pick("card_title", El(attr="data-testid", op="equals", value="card-title", inside=CARD)), Pick("card_title", El("span", attr="dir", op="equals", value="auto", inside=CARD)),
]
# What a button's label says that it counts, in the order in which they are asked for.
COUNTS = [("replies", ("repl",)), ("reposts", ("repost", "retweet")), ("likes", ("like",)), ("views", ("view",)), ("bookmarks", ("bookmark",))]


def engagement(label: Column) -> Column:
    """The number of a button's label, as 123, 1,234 or 1.2K."""
    found = F.regexp_extract(label, r"([0-9,.]+)([KkMmBb]?)", 0)
    number = F.replace(F.regexp_extract(found, r"^[0-9,.]+", 0), F.lit(","), F.lit(""))
    unit = F.lower(F.regexp_extract(found, "[A-Za-z]$", 0))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9)
    scaled = F.floor(F.regexp_extract(number, r"^[0-9]*\.?[0-9]*", 0).try_cast("double") * scale + 0.5)
    return F.coalesce(F.when(unit != "", scaled).otherwise(F.regexp_extract(number, "^[0-9]+", 0).try_cast("long")), F.lit(0)).cast("long")


def social_posts(pages: DataFrame) -> DataFrame:
    """(page_id, post_no, kind, of, handle, text, posted, verified, replies, reposts, likes, views, bookmarks, media, card_url, card_title): posts
    and the posts that they quote, in page order; `of` is the number of the post that quotes. Every field belongs to the nearest
    post around it. Media are (type, url) in page order. A quote without text or handle isn't one."""
    field, value, pos = F.col("field"), F.col("value"), F.col("pos")
    h = page_hits(pages, SOCIAL, {"post": POST, "quote": QUOTE})
    # a scope's own row goes to itself; what it lies in is kept
    own = field.isin("scope", "whole")
    h = h.withColumn("around", F.when(own, F.col("scope"))).withColumn("scope", F.when(own, pos).otherwise(F.col("scope")))
    h = h.where("scope >= 0 or field = 'scope'").where(~((field == "handle") & value.rlike("/(status|photo|video)/")) & ~((field == "image") & F.contains(value, F.lit("profile_images"))))
    label = F.lower("value")
    kind = F.lit(None).cast("string")
    for name, words in reversed(COUNTS):
        fit = F.lit(False)
        for word in words:
            fit = fit | F.contains(label, F.lit(word))
        kind = F.when(fit, name).otherwise(kind)
    h = h.withColumn("counted", F.when(field == "count", kind))
    # what belongs to one video lies within its span: the next of each in page order
    after = Window.partitionBy("page_id").orderBy(pos.desc(), field).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = lambda name: F.last(F.when(field == name, F.struct("pos", "value")), ignorenulls=True).over(after)
    h = h.withColumn("poster", near("poster")).withColumn("source", near("source")).withColumn("loop", near("loop"))
    poster = F.when(F.col("poster.pos") == pos, F.nullif(F.col("poster.value"), F.lit("")))
    source = F.when(F.col("source.pos") <= F.col("close"), F.nullif(F.col("source.value"), F.lit("")))
    src = F.coalesce(source, poster)
    gif = F.contains(src, F.lit("tweet_video_gif")) | (F.coalesce(F.col("loop.pos"), F.lit(-1)) == pos)
    media = F.when((field == "image") & (value != ""), F.struct("pos", F.lit("image").alias("type"), value.alias("url"))).when((field == "video") & src.isNotNull(), F.struct("pos", F.when(gif, "gif").otherwise("video").alias("type"), F.coalesce(poster, src).alias("url")))
    last_count = lambda name: F.coalesce(F.max_by(F.when(F.col("counted") == name, engagement(value)), F.when(F.col("counted") == name, pos)), F.lit(0) if name not in ("views", "bookmarks") else F.lit(None).cast("long")).alias(name)
    d = h.groupBy("page_id", "scope").agg(
        F.max(F.when(field == "scope", value)).alias("kind"), F.max("around").alias("around"), F.coalesce(first_of("handle"), F.lit("")).alias("link"), F.coalesce(trimmed(first_of("text")), F.lit("")).alias("text"),
        F.coalesce(F.nullif(first_of("stamp"), F.lit("")), first_of("stamp_text"), F.lit("")).alias("posted"), (F.count_if(field == "verified") > 0).alias("verified"), *[last_count(name) for name, _ in COUNTS],
        F.transform(F.array_sort(F.collect_list(media)), lambda m: F.struct(m.type.alias("type"), m.url.alias("url"))).alias("media"), first_of("card_url").alias("card_url"), first_of("card_title").alias("card_title"), F.regexp_extract(first_of("whole"), "@([A-Za-z0-9_]+)", 1).alias("named"),
    )
    handle = F.when(F.col("kind") == "quote", F.col("named")).otherwise(F.substring("link", 2, 1 << 30))
    d = d.withColumn("handle", handle).where("kind = 'post' or text <> '' and handle <> ''")
    page = Window.partitionBy("page_id").orderBy("scope")
    d = d.withColumn("post_no", F.row_number().over(page).cast("long"))
    above = F.last(F.when(F.col("kind") == "post", F.struct("scope", "post_no")), ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("of", F.when(F.col("kind") == "quote", F.when(above["scope"] == F.col("around"), above["post_no"])))
    return d.select("page_id", "post_no", "kind", "of", "handle", "text", "posted", "verified", *[n for n, _ in COUNTS], "media", "card_url", "card_title")


# --- products


def _in(cls: str, /, **outer) -> El:
    return El(cls=cls, inside=El(**outer))


# Where a product's fields are, the alternatives in their order.
PRICES = (
    _in("a-offscreen", id="priceblock_ourprice"), El(id="priceblock_ourprice"), _in("a-offscreen", cls="a-price"), El(cls="a-price"), _in("a-offscreen", id="priceblock_dealprice"), El(id="priceblock_dealprice"),
    _in("a-offscreen", id="priceblock_saleprice"), El(id="priceblock_saleprice"), _in("a-offscreen", id="priceblock_buybox"), El(id="priceblock_buybox"), _in("a-offscreen", id="priceblock_pospromoprice"), El(id="priceblock_pospromoprice"),
    _in("a-offscreen", id="corePrice_feature_div"), _in("a-price-whole", id="corePrice_feature_div"), _in("a-offscreen", id="kindle-price"), El(id="kindle-price"), _in("a-offscreen", attr="data-a-color", op="equals", value="price"), _in("a-offscreen", cls="a-price-range"),
)
LIST_PRICES = (_in("a-offscreen", cls="a-price", attr="data-a-strike", op="equals", value="true"), _in("a-offscreen", cls="basisPrice"), _in("a-offscreen", id="listPrice"), _in("a-offscreen", cls="a-price a-text-price"), El(cls="a-price a-text-price"))
RATINGS = (El(id="acrPopover"), El(id="reviewStarsPopover"), El("i", attr="data-hook", op="equals", value="average-star-rating"))
BULLETS = (El("ul", inside=El(id="feature-bullets")), El("ul", inside=El(id="about-this-item")))
MAIN_IMAGES = (El(id="landingImage"), El("img", inside=El(id="imgTagWrapperId")), El("img", inside=El(id="main-image-container")), El("img", inside=El(id="imageBlock")), El(cls="a-dynamic-image"))
THUMBNAILS = (El("img", inside=El(id="altImages")), El("img", inside=El(id="imageBlockThumbnails")), El("img", inside=El(cls="a-button-thumb")))
PRODUCT = [
    Pick("title", El(id="productTitle"), "raw"), Pick("title", El("span", inside=El(id="title")), "raw"), *picks("price", *PRICES, take="raw"), *picks("list_price", *LIST_PRICES, take="raw"),
    *[Pick("stars", x, "title") for x in RATINGS], *[Pick("stars_text", x, "raw") for x in RATINGS], *[Pick("stars_small", _in("a-icon-alt", cls=c), "raw") for c in ("a-icon-star-small", "a-icon-star")],
    *picks("reviews", El(id="acrCustomerReviewText"), El(attr="data-hook", op="equals", value="total-review-count"), El("span", inside=El(cls="a-row a-spacing-medium", inside=El(id="reviews-medley-footer"))), take="raw"),
    *[Pick("bullets", x, "none") for x in BULLETS], *[Pick("feature", El("li", inside=x), "raw") for x in BULLETS], Pick("description", El("p", inside=El(id="productDescription")), "raw"), Pick("description", El(id="productDescription"), "raw"),
    *picks("availability", El(id="availability"), take="raw"), Pick("availability", El(id="deliveryMessageMirId"), "raw"), Pick("unavailable", _in("a-color-price", id="availability"), "raw"),
    *picks("brand", El(id="bylineInfo"), El(id="brand"), El("a", id="bylineInfo"), _in("a-link-normal", id="productTitle"), _in("po-break-word", cls="po-brand"), take="raw"),
    Pick("crumb", El("a", inside=El(id="wayfinding-breadcrumbs_feature_div")), "raw"),
    *[Pick(f"image_main_{i}_{kind}", x, take) for i, x in enumerate(MAIN_IMAGES) for kind, take in (("hires", "data-old-hires"), ("dynamic", "data-a-dynamic-image"), ("src", "src"))],
    *[Pick(f"thumb_{take}", x, take, rank) for rank, x in enumerate(THUMBNAILS) for take in ("data-a-hires", "data-a-dynamic-image")],
]


def first_address(value: Column) -> Column:
    """The address of an image attribute, the first key where it is JSON."""
    return F.when(F.startswith(value, F.lit("{")), F.coalesce(F.get(F.json_object_keys(value), F.lit(0)), value)).otherwise(value)


def product_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, price, list_price, rating, reviews, features, description, main_image, images, availability, brand, category). A field is
    the first element of the first alternative whose value is valid: a price that isn't $0.00, a count above 0, a rating of 0 to 5."""
    field, value, pos = F.col("field"), F.col("value"), F.col("pos")
    h = page_hits(pages, PRODUCT)
    main = [f"image_main_{i}_{kind}" for i in range(len(MAIN_IMAGES)) for kind in ("hires", "dynamic", "src")]
    h = h.withColumn("value", F.when(field.isin(*main, "thumb_data-a-hires", "thumb_data-a-dynamic-image"), value).otherwise(trimmed(value)))
    h = h.withColumn("rank", F.when(field.startswith("image_main_"), 0).otherwise(F.col("rank")))
    page = Window.partitionBy("page_id")
    # of the two lists that hold features the first on the page counts
    bullets = F.min_by(F.when(field == "bullets", F.struct("pos", "close")), F.when(field == "bullets", pos)).over(page)
    h = h.withColumn("_list", bullets)
    number = lambda v: F.regexp_extract(v, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    count = lambda v: F.replace(F.regexp_extract(v, "([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("long")
    brand = lambda v: F.regexp_replace(v, "(?i)^(Visit the |Brand: |by )", "")
    # the first element of each alternative, then the first alternative that is valid, as one array in order
    firsts = h.withColumn("_first", F.row_number().over(Window.partitionBy("page_id", "field", "rank").orderBy("pos")) == 1)
    by_rank = lambda name, ok: F.get(F.array_sort(F.collect_list(F.when(F.col("_first") & (field == name) & (value != "") & ok, F.struct("rank", "value")))), F.lit(0))["value"]
    feature = F.regexp_replace("value", rf"^›{WHITE}*", "")
    inside = (pos > F.col("_list.pos")) & (pos <= F.col("_list.close")) & (feature != "") & ~F.lower(feature).rlike("see more|read more")
    thumb = F.struct("rank", "pos", F.when(field == "thumb_data-a-hires", 0).otherwise(1).alias("second"), first_address(value).alias("url"))
    d = firsts.groupBy("page_id").agg(
        first_of("title").alias("title"), by_rank("price", value != "$0.00").alias("price"), by_rank("list_price", F.lit(True)).alias("list_price"),
        first_of("stars").alias("stars"), first_of("stars_text").alias("stars_text"), first_of("stars_small").alias("stars_small"), by_rank("reviews", count(value) > 0).alias("reviews"),
        ordered("feature", feature, inside).alias("features"), first_of("description").alias("description"), first_of("availability").alias("availability"), first_of("unavailable").alias("unavailable"),
        by_rank("brand", brand(value) != "").alias("brand"), ordered("crumb").alias("crumbs"), *[first_of(n).alias(n) for n in main],
        F.array_sort(F.collect_list(F.when(field.startswith("thumb_") & (value != ""), thumb))).alias("thumbs"),
    )
    stars = number(F.coalesce(F.nullif(F.col("stars"), F.lit("")), F.col("stars_text")))
    rating = F.coalesce(F.when(stars.between(0, 5), stars), number(F.col("stars_small")))
    kept = [F.coalesce(F.nullif(F.col(f"image_main_{i}_hires"), F.lit("")), F.nullif(F.col(f"image_main_{i}_dynamic"), F.lit("")), F.when(~F.contains(F.col(f"image_main_{i}_src"), F.lit("transparent-pixel")), F.nullif(F.col(f"image_main_{i}_src"), F.lit("")))) for i in range(len(MAIN_IMAGES))]
    # an image has its large address before the one of its sizes
    large = F.filter("thumbs", lambda x, i: (i == 0) | (F.get("thumbs", i - 1).pos != x.pos) | (F.get("thumbs", i - 1)["rank"] != x["rank"]))
    there = F.when(~F.contains(F.col("availability"), F.lit("Loading")), F.nullif(F.col("availability"), F.lit("")))
    return d.select(
        "page_id", "title", "price", "list_price", rating.alias("rating"), count(F.col("reviews")).alias("reviews"), "features", F.nullif("description", F.lit("")).alias("description"), first_address(F.coalesce(*kept)).alias("main_image"),
        F.array_distinct(F.transform(large, lambda x: x.url)).alias("images"), F.coalesce(there, F.nullif(F.col("unavailable"), F.lit(""))).alias("availability"), brand(F.col("brand")).alias("brand"), F.nullif(F.array_join("crumbs", " > "), F.lit("")).alias("category"),
    )


# --- documentation


def _links(outer: El, kind: str) -> El:
    return El("a", inside=El("li", inside=El(kind, inside=outer)))


_NAV = El("nav", attr="aria-label", op="holds", value="breadcrumb")
# Where breadcrumbs, code and interactive examples are.
CRUMBS = (
    _links(_NAV, "ol"), _links(_NAV, "ul"), _links(El(cls="breadcrumb"), "ol"), _links(El(cls="breadcrumb"), "ul"), _links(El(cls="breadcrumbs"), "ol"), _links(El(cls="breadcrumbs"), "ul"), El("a", inside=El(id="breadcrumbs")),
    El("a", inside=El("li", inside=El("ol", cls="breadcrumb"))), El("a", inside=El("li", inside=El("ul", cls="breadcrumb"))), El("a", inside=El(cls="breadcrumbs")), El("a", inside=El("nav", cls="breadcrumb")), El("a", inside=El(attr="itemtype", op="holds", value="BreadcrumbList")),
)
EXAMPLES = (*[El("iframe", attr="src", op="holds", value=x) for x in ("jsfiddle", "codepen", "stackblitz", "codesandbox", "replit")], El(any_cls=("interactive-example", "live-editor", "playground")), El(attr="data-live-example"))
LANGUAGE_WORDS = ["language-([A-Za-z0-9_]+)", "lang-([A-Za-z0-9_]+)", "highlight-(?:source-)?([A-Za-z0-9_]+)", "([A-Za-z0-9_]+)-code", "^([A-Za-z0-9_]+)$"]
CODE = (El("code", inside=El("pre")), El(cls="highlight"))
DOCUMENTATION = [
    Pick("title", El("h1")), *picks("crumb", *CRUMBS), Pick("block", El("pre"), "none"), Pick("block", El(any_cls=("highlight", "code-example")), "none"), *[Pick("code", x, "class") for x in CODE], *[Pick("code_lang", x, "data-lang") for x in CODE], *[Pick("example", x, "none") for x in EXAMPLES],
]


def documentation_pages(pages: DataFrame, longest: int = 80) -> DataFrame:
    """(page_id, title, breadcrumbs, section, subsection, blocks, languages, interactive, file_name). Breadcrumbs are the links of the
    first alternative that has any text, in page order; section is the first, subsection the last but one; languages are
    distinct, in order."""
    field, value, pos = F.col("field"), F.col("value"), F.col("pos")
    h = page_hits(pages, DOCUMENTATION)
    named = F.lit(None).cast("string")
    for pattern in reversed(LANGUAGE_WORDS):
        word = F.regexp_extract(value, pattern, 1)
        named = F.when((word != "") & ~word.isin("highlight", "code", "block", "example"), F.lower(word)).otherwise(named)
    crumbs = F.array_sort(F.collect_list(F.when((field == "crumb") & (value != ""), F.struct("rank", "pos", "value"))))
    d = h.groupBy("page_id").agg(
        F.coalesce(first_of("title"), F.lit("")).alias("title"), crumbs.alias("crumbs"), F.count_distinct(F.when(field == "block", pos)).alias("blocks"),
        F.array_sort(F.collect_set(F.when(field == "code", named).when((field == "code_lang") & (value != ""), F.lower("value")))).alias("languages"), (F.count_if(field == "example") > 0).alias("interactive"),
    )
    chain = F.transform(F.filter("crumbs", lambda x: x.rank == F.get("crumbs", F.lit(0)).rank), lambda x: x.value)
    d = d.withColumn("breadcrumbs", chain)
    parts = F.when(F.lower(F.coalesce(F.get("breadcrumbs", F.size("breadcrumbs") - 1), F.lit(""))) == F.lower("title"), F.col("breadcrumbs")).otherwise(F.concat("breadcrumbs", F.array("title")))
    slug = F.array_join(F.filter(F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.lower(p), "[^a-z0-9]+", "-"), "^-|-$", "")), lambda p: p != ""), "-")
    short = F.when(F.length(slug) > longest, F.regexp_replace(F.substring(slug, 1, longest), "-[^-]*$", "")).otherwise(F.coalesce(F.nullif(slug, F.lit("")), F.lit("documentation")))
    section = F.coalesce(F.get("breadcrumbs", F.lit(0)), F.lit(""))
    sub = F.when(F.size("breadcrumbs") > 1, F.get("breadcrumbs", F.size("breadcrumbs") - 2)).otherwise("")
    return d.select("page_id", "title", "breadcrumbs", section.alias("section"), sub.alias("subsection"), "blocks", "languages", "interactive", short.alias("file_name"))


def breadcrumb_rows(docs: DataFrame) -> DataFrame:
    """(page_id, position, label), position from 1."""
    return docs.select("page_id", F.posexplode("breadcrumbs").alias("position", "label")).withColumn("position", (F.col("position") + 1).cast("long"))


# --- articles and newsletters


def _meta(kind: str, name: str) -> El:
    return El("meta", attr=kind, op="equals", value=name)


def _cls(part: str, tag: str = "") -> El:
    """An element with this anywhere in its class attribute."""
    return El(tag, attr="class", op="holds", value=part)


def _href(part: str) -> El:
    return El("a", attr="href", op="holds", value=part)


def _all(field: str, *els: El, take: str = "raw") -> list[Pick]:
    """Elements that are one selector: the first one on the page counts."""
    return [Pick(field, el, take) for el in els]


_BLOCKS = ("p", "h1", "h2", "h3")
# Where articles and newsletters keep their fields, and phrases of those that aren't free.
ARTICLE_WALLS = (_part("paywall"), El(any_cls=("paywall", "metered-content")))
ARTICLE_ROOTS = (El("article"), _part("postContent"), El(cls="postArticle-content"))
ARTICLE_PHRASES = ["member-only", "member only", "members only", "become a member", "upgrade to read full", "unlimited access"]
COMMON = [
    Pick("canonical", El("link", attr="rel", op="equals", value="canonical"), "href"), Pick("og_url", _meta("property", "og:url"), "content"), Pick("keywords", _meta("name", "keywords"), "content"), Pick("meta_tag", _meta("property", "article:tag"), "content"), Pick("whole", El("body"), "raw"),
]
ARTICLE = [
    *COMMON, *_all("title", El("h1"), _part("storyTitle")), *_all("author", _part("authorName"), El("a", inside=El(cls="author-name")), _href("/@")), Pick("handle", _href("/@"), "href"),
    *_all("publication", _href("/publication/"), _part("publicationName")), Pick("section", _meta("property", "article:section"), "content"),
    *[Pick(f, x, t) for x in (_part("storyReadTime"), El(cls="readingTime"), El("time", attr="title", inside=El(cls="postMeta"))) for f, t in (("minutes", "raw"), ("minutes_title", "title"))], Pick("minutes_meta", _meta("name", "twitter:data1"), "content"),
    *[Pick(f, x, t) for x in (_part("clapButton"), El(cls="clap-count"), El(attr="aria-label", op="holds", value="clap")) for f, t in (("claps", "raw"), ("claps_label", "aria-label"))],
    *[Pick(f, x, t) for x in (El("time"), _part("storyPublishDate")) for f, t in (("stamp", "datetime"), ("stamp_text", "raw"))], *_all("tag", El("a", inside=_part("tagButton")), _href("/tag/")),
    *_all("sign", *ARTICLE_WALLS, _part("memberOnly"), El(cls="member-only"), take="none"), *_all("root", *ARTICLE_ROOTS, take="none"),
    *[Pick("block", El(tags=_BLOCKS, inside=x), "raw") for x in ARTICLE_ROOTS], *[Pick("walled", El(tags=_BLOCKS, inside=x), "none") for x in ARTICLE_WALLS],
]
LETTER_WALLS = (_cls("paywall"),)
LETTER_ROOTS = (El(any_cls=("post-content", "body")), El("article"))
LETTER_PHRASES = ["this post is for paid subscribers", "for paid subscribers only", "upgrade to paid", "become a paid subscriber", "paid subscriber", "subscription required"]
LETTER = [
    *COMMON, *_all("title", El("h1", cls="post-title"), _cls("title", "h1"), El("h1", inside=El("article"))), *_all("author", El(cls="author-name"), El("a", inside=El(cls="byline")), _cls("author-name")), *_all("handle", _href("/profile/"), _href("/@"), take="href"),
    *_all("publication", El(cls="publication-logo"), _cls("publicationName"), El(cls="pub-name")), Pick("site", _meta("property", "og:site_name"), "content"), Pick("app", _meta("name", "application-name"), "content"),
    *[Pick(f, x, t) for x in (El(cls="like-button"), _cls("likeButton"), _href("/like")) for f, t in (("likes", "raw"), ("likes_label", "aria-label"))], *_all("like_count", El(cls="like-count"), _cls("likeCount")),
    *[Pick(f, x, t) for x in (_href("#comments"), _href("/comments"), El(cls="comment-count")) for f, t in (("comments", "raw"), ("comments_label", "aria-label"))], *_all("post_id", _meta("property", "article:id"), _meta("name", "article:id"), take="content"),
    *[Pick(f, x, t) for x in (El(cls="post-date"), El("time", inside=El(cls="byline")), _cls("publishDate")) for f, t in (("stamp", "datetime"), ("stamp_text", "raw"))], *_all("tag", _href("/topic/"), El(cls="topic-tag"), _cls("topicLink")),
    *_all("sign", *LETTER_WALLS, El(cls="subscription-required"), _cls("paidContent"), take="none"), *_all("free", El(cls="free-post"), _cls("freePost"), take="none"), *_all("open", El(cls="available-content"), _cls("availableContent")), *_all("root", *LETTER_ROOTS, take="none"),
    *[Pick("block", El(tags=("p", "h2", "h3"), inside=x), "raw") for x in LETTER_ROOTS], *[Pick("walled", El(tags=("p", "h2", "h3"), inside=x), "none") for x in LETTER_WALLS],
]


def first_number(*texts: Column) -> Column:
    """The first number of the first text that isn't empty."""
    return F.regexp_extract(F.coalesce(*[F.nullif(t, F.lit("")) for t in texts]), "([0-9]+)", 1).try_cast("long")


def bounded(h: DataFrame) -> DataFrame:
    """Hits with `is_open`: blocks of the page's first root before the first block that lies in a wall, the ranges' bounds found by
    windows over the page."""
    field, pos, page = F.col("field"), F.col("pos"), Window.partitionBy("page_id")
    h = h.withColumn("_root", F.min_by(F.when(field == "root", F.struct("pos", "close")), F.when(field == "root", pos)).over(page))
    inside = (pos > F.col("_root.pos")) & (pos <= F.col("_root.close"))
    h = h.withColumn("_wall", F.min(F.when((field == "walled") & inside, pos)).over(page))
    return h.withColumn("is_open", (field == "block") & inside & (F.col("_wall").isNull() | (pos < F.col("_wall"))) & (F.col("value") != "")).drop("_root", "_wall")


def preview(blocks: int = 5, least: int = 100) -> Column:
    """The first open blocks, by blank lines; null if they are no longer than `least`. A block that is in two roots counts once."""
    text = F.array_join(F.slice(F.array_distinct(F.array_sort(F.collect_list(F.when(F.col("is_open"), F.struct("pos", "value"))))), 1, blocks)["value"], "\n\n")
    return F.when(F.length(text) > least, text)


def all_tags() -> Column:
    """Tags of links, then of the keywords, under 50 characters, then of the page's tags; each once."""
    text = F.col("value")
    words = F.filter(F.transform(F.split(F.coalesce(first_of("keywords"), F.lit("")), ","), trimmed), lambda k: (k != "") & (F.length(k) < 50))
    return F.array_distinct(F.concat(ordered("tag", more=F.length(text) < 50), words, ordered("meta_tag")))


def signed(phrases: list[str]) -> Column:
    """Whether an element or a phrase of the page says that it isn't free."""
    body = F.lower(F.coalesce(first_of("whole"), F.lit("")))
    out = F.count_if(F.col("field") == "sign") > 0
    for phrase in phrases:
        out = out | F.contains(body, F.lit(phrase))
    return out


def _trimmed_hits(pages: DataFrame, fields: list[Pick]) -> DataFrame:
    h = page_hits(pages, fields)
    return bounded(h.withColumn("value", F.when(F.col("field") == "whole", F.col("value")).otherwise(trimmed(F.col("value")))))


def article_site_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, author, handle, publication, date, minutes, claps, tags, member_only, preview, canonical_url)."""
    h = _trimmed_hits(pages, ARTICLE)
    handle = F.regexp_extract("value", r"/(@[A-Za-z0-9_-]+)", 1)
    h = h.where((F.col("field") != "handle") | (handle != ""))
    there = F.count_if(F.col("field") == "publication") > 0
    has_minutes = F.coalesce(first_number(first_of("minutes"), first_of("minutes_title")), first_number(first_of("minutes_meta")))
    return h.groupBy("page_id").agg(
        F.coalesce(first_of("title"), F.lit("")).alias("title"), F.coalesce(first_of("author"), F.lit("")).alias("author"), F.regexp_extract(first_of("handle"), r"/(@[A-Za-z0-9_-]+)", 1).alias("handle"),
        F.when(there, F.nullif(first_of("publication"), F.lit(""))).otherwise(first_of("section")).alias("publication"), F.coalesce(F.nullif(first_of("stamp"), F.lit("")), F.nullif(first_of("stamp_text"), F.lit(""))).alias("date"),
        has_minutes.alias("minutes"), first_number(first_of("claps"), first_of("claps_label")).alias("claps"), all_tags().alias("tags"), signed(ARTICLE_PHRASES).alias("member_only"), preview().alias("preview"), F.coalesce(first_of("canonical"), first_of("og_url")).alias("canonical_url"),
    )


def newsletter_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, author, handle, publication, date, post_id, tags, likes, comments, paid, free, preview, canonical_url); the preview of paid
    posts only. post_id is the page's own; for one that its URL carries see post_id_of()."""
    h = _trimmed_hits(pages, LETTER)
    handle = lambda v: F.coalesce(F.nullif(F.regexp_extract(v, r"/profile/[0-9]+-([A-Za-z0-9_]+)", 1), F.lit("")), F.nullif(F.regexp_extract(v, r"/@([A-Za-z0-9_]+)", 1), F.lit("")))
    h = h.where((F.col("field") != "handle") | handle(F.col("value")).isNotNull())
    known = lambda v: F.when(v != "Substack", F.nullif(v, F.lit("")))
    there = F.count_if(F.col("field") == "publication") > 0
    d = h.groupBy("page_id").agg(
        F.coalesce(first_of("title"), F.lit("")).alias("title"), F.coalesce(first_of("author"), F.lit("")).alias("author"), handle(first_of("handle")).alias("handle"), F.when(there, F.nullif(first_of("publication"), F.lit(""))).otherwise(F.coalesce(known(first_of("site")), known(first_of("app")))).alias("publication"),
        F.coalesce(F.nullif(first_of("stamp"), F.lit("")), F.nullif(first_of("stamp_text"), F.lit(""))).alias("date"), first_of("post_id").alias("post_id"), all_tags().alias("tags"), F.coalesce(first_number(first_of("likes"), first_of("likes_label")), first_number(first_of("like_count"))).alias("likes"),
        first_number(first_of("comments"), first_of("comments_label")).alias("comments"), signed(LETTER_PHRASES).alias("paid"), (F.count_if(F.col("field") == "free") > 0).alias("_free"), (F.count_if(F.col("field") == "open") > 0).alias("_open"), F.nullif(first_of("open"), F.lit("")).alias("_shown"), preview().alias("_preview"), F.coalesce(first_of("canonical"), first_of("og_url")).alias("canonical_url"),
    )
    d = d.withColumn("free", ~F.col("paid") | F.col("_free")).withColumn("preview", F.when(F.col("paid"), F.when(F.col("_open"), F.col("_shown")).otherwise(F.col("_preview"))))
    return d.select("page_id", "title", "author", "handle", "publication", "date", "post_id", "tags", "likes", "comments", "paid", "free", "preview", "canonical_url")


def post_id_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "/p/([a-zA-Z0-9-]+)", 1), F.lit(""))


# --- forums

THREAD = {"old": El(cls="entry", inside=El(cls="comment")), "new": El("shreddit-comment"), "plain": _part("comment")}
FORUM = [
    Pick("old", El(id="siteTable"), "none"), Pick("old", El(cls="linklisting"), "none"), *_all("old_score", El(cls="score unvoted", inside=El(id="siteTable")), El(cls="score unvoted", inside=El(cls="link"))), Pick("post_score", El("shreddit-post"), "score"),
    Pick("votes", El(attr="aria-label", op="holds", value="upvote", inside=_part("post-container")), "raw"), *[Pick(f, x, t, i) for i, x in enumerate((El("a", attr="href", op="begins", value="/r/", inside=El(cls="subreddit")), El("a", cls="subreddit"), El("a", inside=El(cls="redditname")), El("a", attr="href", op="begins", value="/r/"), El(attr="data-community-name"), El("shreddit-subreddit-icon"))) for f, t in (("group", "raw"), ("group_href", "href"), ("group_name", "data-community-name"))],
    Pick("author_old", El(cls="author"), "raw"), Pick("author_new", El("shreddit-comment"), "author"), *_all("author_plain", El("a", attr="href", op="begins", value="/u/"), _href("user/"), _part("comment-author")),
    Pick("body_old", El(cls="md"), "raw"), *_all("body_new", El("div", attr="slot", op="equals", value="comment"), El(cls="md"), El("p")), *_all("body_plain", El(cls="md"), _part("comment-body"), El("p")),
    Pick("score_old", El(cls="score unvoted"), "raw"), Pick("score_new", El("shreddit-comment"), "score"), *[Pick(f, x, t) for x in (El(attr="aria-label", op="holds", value="upvote"), El(cls="score")) for f, t in (("score_plain", "raw"), ("score_label", "aria-label"))],
]


def score_number(text: Column) -> Column:
    """1.2k as 1200, 3m, 2b; whatever else stands around it."""
    clean = F.regexp_replace(text, "[^0-9.kKmMbB]", "")
    unit = F.lower(F.regexp_extract(clean, r"^[0-9.]+([kKmMbB]?)$", 1))
    scale = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    number = F.regexp_extract(F.when(clean.rlike(r"^[0-9.]+[kKmMbB]?$"), clean), r"^[0-9]*\.?[0-9]*", 0).try_cast("double")
    return F.floor(number * scale + 0.5).cast("long")


def forum_pages(pages: DataFrame) -> DataFrame:
    """(page_id, layout, community, score) of threads: the layout decides where the score is; the community is that of the URL, else
    of the first alternative that names one. (A score that is known only by the arrow before it isn't found.)"""
    h = page_hits(pages, FORUM, THREAD)
    field, first = F.col("field"), F.row_number().over(Window.partitionBy("page_id", "field", "rank").orderBy("pos")) == 1
    named = lambda v: F.nullif(F.lower(F.regexp_extract(v, "(?i)r/([A-Za-z0-9_]+)", 1)), F.lit(""))
    h = h.withColumn("_name", F.when(first, F.when(field == "group", named(F.col("value"))).when(field == "group_href", named(F.concat(F.lit("/"), F.regexp_replace("value", "^/", "")))).when(field == "group_name", F.nullif(F.lower("value"), F.lit("")))))
    d = h.groupBy("page_id").agg((F.count_if(field == "old") > 0).alias("is_old"), first_of("old_score").alias("old_score"), first_of("post_score").alias("post_score"), first_of("votes").alias("votes"), F.min_by("_name", F.when(F.col("_name").isNotNull(), F.struct("rank", "field"))).alias("name"))
    score = F.when(F.col("is_old"), score_number(F.col("old_score"))).otherwise(F.coalesce(F.regexp_extract("post_score", r"^\s*(-?[0-9]+)", 1).try_cast("long"), score_number(F.col("votes"))))
    url = F.lower(F.nullif(F.regexp_extract("url", "(?i)reddit\\.com/r/([^/]+)", 1), F.lit("")))
    return pages.select("page_id", "url").join(d, "page_id", "left").select("page_id", F.when(F.col("is_old"), "old").otherwise("new").alias("layout"), F.coalesce(url, "name").alias("community"), score.alias("score"))


def forum_comments(pages: DataFrame, most: int = 10) -> DataFrame:
    """(page_id, comment_no, author, body, score) of the first `most` comments of each page's layout that have a body; a comment within
    a comment owns its own fields."""
    h = page_hits(pages, FORUM, THREAD)
    field, pos, page = F.col("field"), F.col("pos"), Window.partitionBy("page_id")
    h = h.withColumn("is_old", F.max(F.when(field == "old", 1).otherwise(0)).over(page) > 0)
    own = field.isin("scope", "author_new", "score_new")
    h = h.withColumn("at", F.when(own, pos).otherwise(F.col("scope"))).where("at >= 0")
    d = h.groupBy("page_id", "is_old", "at").agg(F.max(F.when(field == "scope", F.col("value"))).alias("kind"), *[first_of(f"{f}_{k}").alias(f"{f}_{k}") for f in ("author", "body", "score") for k in THREAD], first_of("score_label").alias("score_label"))
    d = d.where((F.col("kind") == "old") == F.col("is_old")).withColumn("n", F.row_number().over(page.orderBy("at"))).where(F.col("n") <= most)
    pick = lambda f, or_else: F.coalesce(*[F.when(F.col("kind") == k, F.nullif(trimmed(F.col(f"{f}_{k}")), F.lit(""))) for k in THREAD], F.lit(or_else))
    labelled = F.when(F.col("kind") == "plain", F.nullif(F.regexp_extract("score_label", "[0-9]+", 0), F.lit("")))
    d = d.select("page_id", "n", pick("author", "[deleted]").alias("author"), pick("body", "").alias("body"), F.coalesce(labelled, pick("score", "0")).alias("score")).where("body <> ''")
    return d.select("page_id", F.row_number().over(page.orderBy("n")).cast("long").alias("comment_no"), "author", "body", "score")


def render_comments(comments: DataFrame) -> DataFrame:
    """(page_id, body): comments in order under a heading, with their authors and scores."""
    line = F.concat(F.lit("**"), F.col("author"), F.lit("** (↑"), F.col("score"), F.lit(")\n\n"), F.col("body"), F.lit("\n\n---\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("comment_no", line.alias("l"))))
    return comments.groupBy("page_id").agg(F.concat(F.lit("\n\n## Comments\n\n"), F.array_join(F.transform(parts, lambda p: p["l"]), "")).alias("body"))


# --- code hosts


def _click(part: str, tag: str = "") -> El:
    return El(tag, attr="data-ga-click", op="holds", value=part)


CODE_HOST = [
    *_all("stars", _click("star button"), _href("/stargazers")), *_all("forks", _click("fork button"), _href("/forks")), *_all("watchers", _click("watch button"), _href("/watchers")),
    *_all("language", El(attr="itemprop", op="equals", value="programmingLanguage"), El("span", attr="data-ga-click", op="holds", value="language", inside=El(cls="Layout-sidebar"))), *_all("state", _click("State"), El(cls="State"), take="class"), *_all("label", El(cls="IssueLabel"), El("a", inside=El(cls="js-issue-labels"))),
    *[Pick(f, x, t) for x in (El(cls="assignee"), El("a", inside=_part("assignee")), El("a", inside=El(cls="sidebar-assignee"))) for f, t in (("assignee", "raw"), ("assignee_href", "href"))], *_all("milestone", El(cls="milestone-name"), El("a", inside=_part("milestone"))),
]


def code_host_pages(pages: DataFrame) -> DataFrame:
    """(page_id, kind, owner, repo, number, stars, forks, watchers, language, status, labels, assignees, milestone)."""
    field, value = F.col("field"), F.col("value")
    h = page_hits(pages, CODE_HOST)
    count = lambda f, w: F.coalesce(F.replace(F.coalesce(F.nullif(F.regexp_extract(first_of(f), rf"(?i)([0-9][0-9,]*)\s*{w}", 1), F.lit("")), F.regexp_extract(first_of(f), "([0-9][0-9,]*)", 1)), F.lit(","), F.lit("")).try_cast("long"), F.lit(0))
    state = F.coalesce(first_of("state"), F.lit(""))
    who = F.transform(F.array_sort(F.collect_list(F.when(field.isin("assignee", "assignee_href"), F.struct("pos", F.when(field == "assignee_href", 0).otherwise(1).alias("k"), F.when(field == "assignee_href", F.regexp_replace(value, "^([^/]*)/", "$1@")).otherwise(trimmed(value)).alias("v"))))), lambda x: x)
    d = h.groupBy("page_id").agg(
        count("stars", "Star").alias("stars"), count("forks", "Fork").alias("forks"), count("watchers", "Watch").alias("watchers"), F.coalesce(trimmed(first_of("language")), F.lit("")).alias("language"), F.when(F.contains(state, F.lit("closed")), "closed").when(F.contains(state, F.lit("merged")), "merged").otherwise("open").alias("status"),
        ordered("label", trimmed(value), trimmed(value) != "").alias("labels"), who.alias("who"), F.coalesce(trimmed(first_of("milestone")), F.lit("")).alias("milestone"),
    )
    # an assignee's link counts before its text; each element once
    known = F.filter("who", lambda x: F.coalesce(x["v"], F.lit("")) != "")
    one = F.filter(known, lambda x, i: (i == 0) | (F.get(known, i - 1)["pos"] != x["pos"]))
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    kind = F.when(host == "gist.github.com", "gist").when(F.contains(path, F.lit("/pull/")), "pr").when(F.contains(path, F.lit("/issues/")), "issue").when(F.contains(path, F.lit("/blob/")), "code").when(F.size(parts) >= 2, "repo").otherwise("unknown")
    number = F.regexp_extract(path, "/(?:issues|pull)/([0-9]+)", 1).try_cast("long")
    keys = pages.select("page_id", kind.alias("kind"), F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))).alias("owner"), F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).alias("repo"), number.alias("number"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    none = F.array().cast("array<string>")
    return keys.join(d.withColumn("assignees", F.array_distinct(F.transform(one, lambda x: x["v"]))), "page_id", "left").select(
        "page_id", "kind", "owner", "repo", "number", zero("stars"), zero("forks"), zero("watchers"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("status", F.lit("open")).alias("status"), F.coalesce("labels", none).alias("labels"), F.coalesce("assignees", none).alias("assignees"), F.coalesce("milestone", F.lit("")).alias("milestone"),
    )


# --- video pages

VIDEO = [
    Pick("title", El("title"), "raw"), Pick("channel", El("a", inside=El(id="channel-name")), "raw"), Pick("duration", El("span", cls="ytp-time-duration"), "raw"), Pick("meta_duration", _meta("itemprop", "duration"), "content"), Pick("whole", El("body"), "raw"),
    Pick("live", El(cls="ytp-live-badge"), "none"), Pick("live", El(attr="data-live", op="equals", value="true"), "none"), Pick("gate", El(cls="ytp-age-gate"), "none"), Pick("account", El(id="account-container"), "raw"), Pick("alert", El(cls="yt-alert-message"), "raw"),
]


def assigned_json(html: Column, name: str) -> Column:
    """The JSON object that a script assigns to a variable, cut where its braces balance; braces within strings don't count, nor
    quotes after a backslash. Null where there is none or it doesn't end. The state of the running depth is three numbers, so
    a long object costs no more than one look at its pieces."""
    tail = F.regexp_extract(html, rf"(?s)\b{name}\s*=\s*(\{{.*)", 1)
    pieces = F.regexp_extract_all(tail, F.lit(r"(?s)\\.|[\"{}]|[^\"{}\\]+"), F.lit(0))
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("quoted"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        depth = s.depth + F.when(s.quoted, 0).when(p == "{", 1).when(p == "}", -1).otherwise(0)
        after = F.struct(depth.alias("depth"), (s["size"] + F.length(p)).alias("size"), F.when(p == '"', ~s.quoted).otherwise(s.quoted).alias("quoted"), ((depth == 0) & ~s.quoted & (p == "}")).alias("done"))
        return F.when(s.done, s).otherwise(after)

    end = F.aggregate(pieces, state, step, lambda s: F.when(s.done, s["size"]))
    return F.substr(tail, F.lit(1), end)


def clock(seconds: Column) -> Column:
    """Seconds as m:ss or h:mm:ss."""
    short = F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60)
    return F.when(seconds >= 3600, F.format_string("%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)).otherwise(short)


def video_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, channel, duration, kind, supported): from the page, else from the player's data in a script. Kinds are asked for in this
    order: shorts, live, age-restricted, unavailable, normal; shorts and normal ones have transcripts."""
    data = pages.select("page_id", "url", F.try_parse_json(assigned_json(F.col("html"), "ytInitialPlayerResponse")).alias("_data"))
    part = lambda path: F.try_variant_get("_data", path, "string")
    data = data.select("page_id", "url", part("$.videoDetails.title").alias("_title"), part("$.videoDetails.author").alias("_author"), part("$.videoDetails.lengthSeconds").try_cast("long").alias("_seconds"))
    h = page_hits(pages, VIDEO)
    has, body = lambda n: F.count_if(F.col("field") == n) > 0, F.coalesce(first_of("whole"), F.lit(""))
    says = lambda n, word: F.contains(F.coalesce(first_of(n), F.lit("")), F.lit(word))
    d = h.groupBy("page_id").agg(
        trimmed(F.replace(F.coalesce(first_of("title"), F.lit("")), F.lit(" - YouTube"), F.lit(""))).alias("title"), F.coalesce(trimmed(first_of("channel")), F.lit("")).alias("channel"), F.coalesce(F.nullif(first_of("duration"), F.lit("")), F.nullif(first_of("meta_duration"), F.lit(""))).alias("duration"),
        (has("live") | F.contains(body, F.lit("Watching live"))).alias("live"), (has("gate") | F.contains(body, F.lit("sign in to confirm your age")) | says("account", "age")).alias("aged"), (F.contains(body, F.lit("This video is unavailable")) | says("alert", "unavailable")).alias("gone"),
    )
    kind = F.when(F.col("url").rlike(r"^https?://(www\.)?youtube\.com/shorts"), "shorts").when(F.col("live"), "live").when(F.col("aged"), "age-restricted").when(F.col("gone"), "unavailable").otherwise("normal")
    d = data.join(d, "page_id", "left").withColumn("kind", kind)
    filled = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other, F.lit(""))
    return d.select("page_id", filled("title", F.col("_title")).alias("title"), filled("channel", F.col("_author")).alias("channel"), filled("duration", clock(F.col("_seconds"))).alias("duration"), "kind", F.col("kind").isin("shorts", "normal").alias("supported"))


# --- papers

AUTHORS = (El(any_cls=("authors", "ltx_author")), El(id="authors"))
PAPER = [
    *picks("title", El("h1", cls="title"), El(cls="title"), El(id="title"), El("h1", cls="ltx_title"), take="raw"), *_all("authors", *AUTHORS), *[Pick("author", El("a", inside=x), "raw") for x in AUTHORS],
    *picks("abstract", El("blockquote", cls="abstract"), El(cls="abstract"), El(id="abstract"), El(cls="ltx_abstract"), take="raw"), *picks("date", El(cls="dateline"), El(cls="submission-date"), El(cls="ltx_date"), take="raw"),
    *_all("subjects", El(any_cls=("subjects", "keywords")), El(id="keywords")), *_all("acm", El(any_cls=("acm-classes", "msc-classes"))), *_all("comments", El(cls="comments"), El(id="comments")), *_all("journal", El(cls="journal-ref"), El(id="journal-ref")),
    *[Pick(f, x, t) for x in (El(cls="doi"), El(id="doi"), _href("doi.org")) for f, t in (("doi", "raw"), ("doi_href", "href"))],
]


def paper_pages(pages: DataFrame) -> DataFrame:
    """(page_id, paper_id, version, title, authors, abstract, subjects, acm, comments, journal, doi, submitted, pdf_url, abs_url, html_url).
    Authors are the links in the first list of authors, in page order, each once, else its text between commas; subjects the
    primary and the secondary ones, else all parts of the text."""
    from pagemill.functions.urls import site_key_of

    field, value, pos, page = F.col("field"), F.col("value"), F.col("pos"), Window.partitionBy("page_id")
    h = page_hits(pages, PAPER).withColumn("value", trimmed(value))
    h = h.withColumn("_list", F.min_by(F.when(field == "authors", F.struct("pos", "close")), F.when(field == "authors", pos)).over(page))
    inside = (pos > F.col("_list.pos")) & (pos <= F.col("_list.close")) & (F.length(value) > 1)
    h = h.withColumn("_first", F.row_number().over(Window.partitionBy("page_id", "field", "rank").orderBy("pos")) == 1)
    by_rank = lambda name, v=value: F.get(F.array_sort(F.collect_list(F.when(F.col("_first") & (field == name) & (v != ""), F.struct("rank", v.alias("v"))))), F.lit(0))["v"]
    split = lambda text, by: F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), by), trimmed), lambda x: x != "")
    d = h.groupBy("page_id").agg(
        collapsed(by_rank("title")).alias("title"), F.array_distinct(ordered("author", more=inside)).alias("links"), first_of("authors").alias("listed"), by_rank("abstract", collapsed(F.regexp_replace(value, rf"(?i)^Abstract:{WHITE}*", ""))).alias("abstract"),
        by_rank("date").alias("date"), F.coalesce(first_of("subjects"), F.lit("")).alias("topics"), split(first_of("acm"), "[;,]").alias("acm"), F.nullif(trimmed(F.regexp_replace(first_of("comments"), "(?i)^Comments:", "")), F.lit("")).alias("comments"),
        F.nullif(trimmed(F.regexp_replace(first_of("journal"), "(?i)^Journal reference:", "")), F.lit("")).alias("journal"), first_of("doi").alias("doi_text"), first_of("doi_href").alias("doi_href"),
    )
    names = F.array_distinct(F.filter(split(F.col("listed"), ","), lambda x: F.length(x) > 1))
    primary = F.nullif(F.regexp_extract("topics", rf"(?i)Primary:{WHITE}*([a-z-]+\.[A-Z]+)", 1), F.lit(""))
    second = split(F.regexp_extract("topics", rf"(?i)Secondary:{WHITE}*([A-Za-z0-9_.,\s;-]+)", 1), "[;,]")
    both = F.array_distinct(F.concat(F.array_compact(F.array(primary)), second))
    plain = F.filter(split(F.col("topics"), "[;,]"), lambda x: (F.length(x) > 2) & ~x.startswith("Primary") & ~x.startswith("Secondary"))
    found = lambda pattern: F.nullif(F.regexp_extract("date", pattern, 1), F.lit(""))
    submitted = F.coalesce(found(r"([0-9]{1,2}\s+\w+\s+[0-9]{4})"), found("([0-9]{4}-[0-9]{2}-[0-9]{2})"), trimmed(F.regexp_replace("date", r"[\[\]]", "")))
    doi = F.when(F.contains(F.col("doi_href"), F.lit("doi.org")), F.regexp_replace("doi_href", r".*doi\.org/", "")).otherwise(F.nullif(F.regexp_extract("doi_text", r"10\.[0-9]{4,}/[^\s]+", 0), F.lit("")))
    keys = pages.select("page_id", site_key_of(F.col("url")).alias("k")).select("page_id", F.when(F.col("k.site") == "paper", F.col("k.key")).alias("paper_id"), F.when(F.col("k.site") == "paper", F.regexp_replace("k.key2", "^v", "")).try_cast("long").alias("version"))
    at = lambda kind: F.concat(F.lit(kind), F.col("paper_id"))
    return keys.join(d, "page_id", "left").select(
        "page_id", "paper_id", "version", "title", F.when(F.size("links") > 0, F.col("links")).otherwise(names).alias("authors"), "abstract", F.when(F.size(both) > 0, both).otherwise(plain).alias("subjects"), "acm", "comments", "journal", doi.alias("doi"), submitted.alias("submitted"),
        F.concat(at("https://arxiv.org/pdf/"), F.lit(".pdf")).alias("pdf_url"), at("https://arxiv.org/abs/").alias("abs_url"), at("https://ar5iv.org/abs/").alias("html_url"),
    )


# --- note bodies


def paper_bibtex(year: str) -> Column:
    """BibTeX of a paper; `year` stands in where it has no date. Null without id or title."""
    first = F.coalesce(F.get("authors", F.lit(0)), F.lit("Unknown"))
    of = F.coalesce(F.nullif(F.regexp_extract("submitted", "[0-9]{4}", 0), F.lit("")), F.lit(year))
    key = F.concat(F.lower(F.regexp_extract(first, r"(\S+)\s*$", 1)), of, F.regexp_replace("paper_id", "[./]", ""))
    line = lambda name, text: F.concat(F.lit(f"  {name:<9} = {{"), text, F.lit("}"))
    rows = F.concat_ws(",\n", F.concat(F.lit("@article{"), key), line("title", F.col("title")), F.when(F.size("authors") > 0, line("author", F.array_join("authors", " and "))), line("journal", F.concat(F.lit("arXiv preprint arXiv:"), F.col("paper_id"))), line("year", of), line("doi", F.col("doi")), line("url", F.col("abs_url")))
    return F.when(F.col("paper_id").isNotNull() & F.col("title").isNotNull(), F.concat(rows, F.lit("\n}")))


def paper_citation() -> Column:
    who = F.when(F.size("authors") > 2, F.concat(F.get("authors", F.lit(0)), F.lit(" et al."))).when(F.size("authors") > 0, F.array_join("authors", " & ")).otherwise("Unknown Author")
    year = F.regexp_extract(F.coalesce("submitted", F.lit("")), "[0-9]{4}", 0)
    return F.when(F.col("title").isNotNull(), F.concat(who, F.when(year != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(""), F.lit('. "'), F.col("title"), F.lit('".'), F.coalesce(F.concat(F.lit(" arXiv:"), F.col("paper_id")), F.lit(""))))


def render_paper(papers: DataFrame, year: str = "2024") -> DataFrame:
    """(page_id, body)."""
    ticked = F.array_join(F.transform("subjects", lambda s: F.concat(F.lit("`"), s, F.lit("`"))), ", ")
    parts = [
        F.concat(F.lit("# "), F.col("title")), F.when(F.size("authors") > 0, F.concat(F.lit("**Authors:** "), F.array_join("authors", ", "))), F.concat(F.lit("**ArXiv ID:** [`"), F.col("paper_id"), F.lit("`]("), F.col("abs_url"), F.lit(")\n\n[PDF]("), F.col("pdf_url"), F.lit(") | [HTML]("), F.col("html_url"), F.lit(")")),
        F.concat(F.lit("**Submitted:** "), F.nullif("submitted", F.lit(""))), F.when(F.size("subjects") > 0, F.concat(F.lit("**Subjects:** "), ticked)), F.concat(F.lit("## Abstract\n\n"), F.col("abstract")), F.concat(F.lit("> **Comments:** "), F.col("comments")), F.concat(F.lit("**Journal Reference:** "), F.col("journal")),
        F.concat(F.lit("**DOI:** ["), F.col("doi"), F.lit("](https://doi.org/"), F.col("doi"), F.lit(")")), F.concat(F.lit("## Citation\n\n```bibtex\n"), paper_bibtex(year), F.lit("\n```")),
    ]
    return papers.select("page_id", F.concat_ws("\n\n", *parts).alias("body"))


def render_documentation(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """(page_id, body): the content of (page_id, content) under its title, path, section, languages."""
    d = docs.join(contents, "page_id", "left")
    path = F.when(F.size("breadcrumbs") > 0, F.concat(F.lit("> 📍 Path: "), F.array_join("breadcrumbs", " → "), F.lit("\n"), F.when((F.col("section") != "") & (F.col("section") != F.col("title")), F.concat(F.lit("> 📁 Section: "), F.col("section"), F.lit("\n"))).otherwise(""), F.lit("\n"))).otherwise("")
    code = F.when(F.size("languages") > 0, F.concat(F.lit("> 💻 Languages: "), F.array_join(F.transform("languages", lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", "), F.lit("\n"))).otherwise("")
    live = F.when(F.col("interactive"), F.lit("> ▶️ This page has interactive examples\n")).otherwise("")
    gap = F.when((code != "") | (live != ""), "\n").otherwise("")
    return d.select("page_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), path, code, live, gap, F.coalesce("content", F.lit(""))).alias("body"))
