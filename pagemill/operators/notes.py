"""Notes: tags, paths, source, front matter and body. All within a row, from one table of clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import collapsed, first_of_each

# The keys of the head that extra fields can't take, and for each option the extra fields that it adds, with
# the columns that they come from.
RESERVED = ["source", "title", "author", "channel", "duration", "video_type", "date_clipped", "tags", "type"]
EXTRA = {"published_date": "published", "description": "description", "paywalled": "paywalled", "truncated": "truncated", "page_type": "page_type", "site_name": "site_name", "language": "language"}
OPTIONS = {
    "canonical": {"canonical_url": "canonical_url"},
    "og": {"og_title": "og_title", "og_description": "og_description", "og_images": "og_images", "og_url": "og_url", "og_type": "og_type", "og_site_name": "og_site_name", "og_locale": "og_locale"},
    "twitter": {"twitter_card": "twitter_card", "twitter_title": "twitter_title", "twitter_description": "twitter_description", "twitter_image": "twitter_image", "twitter_site": "twitter_site", "twitter_creator": "twitter_creator"},
    "jsonld": {"jsonld_schema_type": "schema_type", "jsonld_headline": "jsonld_headline", "jsonld_author": "authors", "jsonld_publisher": "publisher", "jsonld_keywords": "jsonld_keywords", "jsonld_date_published": "date_published", "jsonld_word_count": "word_count"},
    "keywords": {"keywords": "keywords"},
    "stats": {"reading_word_count": "words", "reading_char_count": "chars", "reading_time_minutes": "minutes"},
}


def note_tags(raw: Column, page_type: Column) -> Column:
    """Tags of a comma list, each once whatever its case; youtube and pdf by page type; web-clip where there is none."""
    tags = first_of_each(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""))
    lower = F.transform(tags, F.lower)
    for kind in ("youtube", "pdf"):
        tags = F.when((page_type == kind) & ~F.array_contains(lower, kind), F.concat(tags, F.array(F.lit(kind)))).otherwise(tags)
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("web-clip")))


def file_name(title: Column) -> Column:
    """A title as a file name: control signs as spaces, forbidden signs as dashes, 100 characters, Untitled where empty."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"[\x00-\x1F\x7F]", " "), r'[<>:"/\\|?*]', "-")
    name = F.trim(F.substring(collapsed(name), 1, 100))
    return F.when(name == "", "Untitled").otherwise(name)


def note_path(title: Column, folder: str = "Clips", depth: Column | None = None) -> Column:
    """Folder and file name; a crawl puts pages below the start into folders by depth."""
    parts = [F.lit(folder)] if folder else []
    if depth is not None:
        parts.append(F.when(depth > 0, F.concat(F.lit("depth-"), depth.cast("string"))))
    return F.concat_ws("/", *parts, file_name(title))


def note_source(canonical: Column, own: Column, page_url: Column, prefer_canonical: bool = True) -> Column:
    return F.coalesce(canonical, own, page_url) if prefer_canonical else F.coalesce(own, page_url)


def quoted(text: Column) -> Column:
    """A YAML string in double quotes."""
    out = F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), r"\r\n|\r", "\n")
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.concat(F.lit('"'), out, F.lit('"'))


def yaml_key(key: str) -> str:
    """A key with other signs than letters, digits, _ and - as _, not beginning with a digit."""
    out = "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in key.strip())
    return "x" if not out else f"x_{out}" if out[0].isdigit() else out


def yaml_line(key: str, value: Column, kind: str) -> Column:
    """`key: value`, null where there is no value. Lists have a line per item."""
    if kind.startswith("array"):
        items = F.filter(F.transform(value, lambda t: F.trim(t)), lambda t: t != "")
        lines = F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(items, lambda t: F.concat(F.lit("  - "), quoted(t))), "\n"))
        return F.when(value.isNull(), None).when(F.size(items) == 0, f"{key}: []").otherwise(lines)
    if kind == "boolean":
        return F.concat(F.lit(f"{key}: "), value.cast("string"))
    if kind == "string":
        return F.when(F.trim(value) != "", F.concat(F.lit(f"{key}: "), quoted(F.trim(value))))
    number = F.when(value.cast("double") == F.floor(value.cast("double")), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.when(~F.isnan(value.cast("double")), F.concat(F.lit(f"{key}: "), number))


def extra_fields(columns: list[str], options: tuple[str, ...]) -> dict[str, str]:
    """Front matter keys and their columns under these options. What no option asks for isn't selected, so the scan and the
    extraction of it fall out of the plan."""
    fields = dict(EXTRA)
    for option in options:
        fields |= OPTIONS[option]
    return {k: c for k, c in fields.items() if c in columns}


def frontmatter_yaml(df: DataFrame, extra: dict[str, str]) -> Column:
    """Front matter of clips (source, title, author, date_clipped, tags, type): the head in its order, then the extra fields by
    key; blank values and reserved keys fall out."""
    kinds = dict(df.dtypes)
    head = [F.concat(F.lit("source: "), quoted(F.coalesce("source", F.lit("")))), F.concat(F.lit("title: "), quoted(F.coalesce("title", F.lit(""))))]
    head += [yaml_line(k, F.col(k), "string") for k in ("author", "channel", "duration", "video_type") if k in kinds]
    head += [F.concat(F.lit("date_clipped: "), quoted(F.col("date_clipped"))), yaml_line("tags", F.col("tags"), "array"), F.concat(F.lit("type: "), quoted(F.col("type")))]
    keys = sorted((yaml_key(k), c) for k, c in extra.items())
    lines = [yaml_line(k, F.col(c), kinds[c]) for k, c in keys if k not in RESERVED]
    return F.concat(F.concat_ws("\n", F.lit("---"), *head, *lines, F.lit("---")), F.lit("\n\n"))


def with_body(front: Column, body: Column) -> Column:
    """Front matter, then the body without the white space before it and with a line end."""
    body = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+", "")
    return F.concat(front, body, F.when((body == "") | body.endswith("\n"), "").otherwise("\n"))


def build_notes(clips: DataFrame, options: tuple[str, ...] = (), folder: str = "Clips") -> DataFrame:
    """(page_id, file_path, note) of clips (page_id, url, title, markdown, page_type, raw_tags, clipped_at and any of the fields
    of EXTRA and OPTIONS)."""
    canonical = F.col("canonical_url") if "canonical_url" in clips.columns and "canonical" in options else F.lit(None).cast("string")
    d = clips.withColumn("source", note_source(canonical, F.col("url"), F.col("url"))).withColumn("title", file_name(F.col("title")))
    d = d.withColumn("tags", note_tags(F.col("raw_tags"), F.col("page_type"))).withColumn("type", F.lit("article")).withColumn("date_clipped", F.date_format("clipped_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    note = with_body(frontmatter_yaml(d, extra_fields(d.columns, options)), F.col("markdown"))
    return d.select("page_id", note_path(F.col("title"), folder).alias("file_path"), note.alias("note"))


def vault_merge(notes: DataFrame, mode: str = "overwrite", order: str = "page_id") -> DataFrame:
    """(file_path, note, versions): the latest note of each path, or with mode append all of them in order."""
    if mode == "append":
        parts = F.array_sort(F.collect_list(F.struct(order, "note")))
        return notes.groupBy("file_path").agg(F.array_join(F.transform(parts, lambda p: p.note), "\n").alias("note"), F.count("*").alias("versions"))
    return notes.groupBy("file_path").agg(F.max_by("note", order).alias("note"), F.count("*").alias("versions"))


def write_notes(notes: DataFrame, path: str) -> None:
    """Notes as a table in folders."""
    notes.withColumn("folder", F.regexp_replace("file_path", "/[^/]*$", "")).write.mode("overwrite").partitionBy("folder").parquet(path)


def write_manifest(results: DataFrame, path: str) -> None:
    """Result rows as JSON lines."""
    results.write.mode("overwrite").json(path)


def link_terms(docs: DataFrame, terms: list[tuple[str, str]], most: int = 1) -> DataFrame:
    """(doc_id, text, links): terms (term, note) as links to their notes, the longest term first at each place, as whole words and
    whatever their case, `most` times a term and document; front matter, code and links stay as they are. The text is cut
    into hits and what lies between, and put together again."""
    escape = lambda t: "".join(f"\\{c}" if not (c.isalnum() or c == " ") else c for c in t)
    by_length = sorted(terms, key=lambda t: (-len(t[0]), t[0]))
    kept = r"\A---\n.*?\n---\n|```.*?```|`[^`\n]+`|!?\[\[[^\]]*\]\]|!?\[[^\]]*\]\([^)]*\)"
    pattern = "(?is)" + kept + "|" + "|".join(rf"(?<![\p{{L}}\p{{N}}_]){escape(t)}(?![\p{{L}}\p{{N}}_])" for t, _ in by_length)
    notes = F.create_map(*[F.lit(x) for t, n in by_length for x in (t.lower(), n)])
    d = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"), F.split("text", pattern).alias("gaps"))
    keys = F.transform("hits", F.lower)
    d = d.withColumn("keys", keys)
    uses = lambda h, i: F.size(F.filter(F.slice("keys", 1, i + 1), lambda k: k == F.lower(h)))
    note = lambda h: F.element_at(notes, F.lower(h))
    linked = lambda h, i: note(h).isNotNull() & (uses(h, i) <= most)
    link = lambda h: F.when(note(h) == h, F.concat(F.lit("[["), h, F.lit("]]"))).otherwise(F.concat(F.lit("[["), note(h), F.lit("|"), h, F.lit("]]")))
    new = F.transform("hits", lambda h, i: F.when(linked(h, i), link(h)).otherwise(h))
    text = F.array_join(F.zip_with("gaps", F.concat(new, F.array(F.lit(""))), lambda g, h: F.concat(g, h)), "")
    return d.select("doc_id", text.alias("text"), F.size(F.filter("hits", linked)).cast("long").alias("links"))


def number_of(text: Column) -> Column:
    """Counts as sites print them: 1,234, 1.2k, 2.5M, 3B; null where there is none."""
    t = F.lower(F.replace(text, F.lit(","), F.lit("")))
    digits, unit = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)\s*([kmb]?)(?![a-z])", 1), F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)\s*([kmb]?)(?![a-z])", 2)
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return F.when(digits != "", F.floor(digits.try_cast("double") * times + 0.5).cast("long"))


def duration_words(iso: Column) -> Column:
    """PT1H30M as `1 hour 30 minutes`; other text as it is, blank as null."""
    part = lambda unit: F.nullif(F.regexp_extract(iso, rf"(?i)([0-9]+){unit}", 1), F.lit("")).cast("long")
    words = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise("")))
    spelled = F.concat_ws(" ", words(part("D"), "day"), words(part("H"), "hour"), words(part("M"), "minute"), words(part("S"), "second"))
    return F.when(F.trim(iso) == "", None).when(iso.rlike("(?i)^P(?:[0-9]+D)?(?:T.*)?$") & (spelled != ""), spelled).otherwise(F.trim(iso))


