"""Rules that meet pages: domains, templates, conditions, links to notes. Rules meet pages by equality only: plain domains
on the host's suffixes, globs and conditions on a piece of a few characters that a page has to have; what meets is then checked
exactly. Rule tables of a checked size are broadcast, larger ones are joined as any other table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import urls

MOST_RULES = 20_000
PIECES = (4, 2, 1)  # lengths of the pieces, the longest first

# Domains whose pages need a login, and those for which cookies do.
AUTH_DOMAINS = ["twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "medium.com", "substack.com", "nytimes.com", "wsj.com", "washingtonpost.com", "theverge.com"]
COOKIE_DOMAINS = ["medium.com", "substack.com"]


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rules; broadcast up to MOST_RULES of them."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MOST_RULES else table


def pieces_of(text: Column) -> Column:
    """All runs of 4, 2 and 1 characters of a text, each once, and the empty one, which rules without a piece have."""
    runs = [F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in PIECES]
    return F.array_distinct(F.concat(F.array(F.lit("")), *runs))


def with_piece(rules: DataFrame, text: Column, *keys: str) -> DataFrame:
    """rules with column `_piece`, a run of the text as long as it has one; of its runs that which the fewest rules have, so that
    what all of them begin with isn't taken."""
    runs = F.lit(None).cast("array<string>")
    for n in reversed(PIECES):
        runs = F.when(F.length(text) >= n, F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))).otherwise(runs)
    d = rules.withColumn("_runs", F.coalesce(runs, F.array(F.lit("")))).withColumn("_rule", F.xxhash64(*keys))
    each = d.select("_rule", F.explode("_runs").alias("_run")).distinct()
    common = each.groupBy("_run").agg(F.count("*").alias("_n"))
    chosen = each.join(common, "_run").groupBy("_rule").agg(F.min_by("_run", F.struct("_n", "_run")).alias("_piece"))
    return d.join(chosen, "_rule").drop("_runs", "_rule")


def plain_host(url: Column) -> Column:
    return F.regexp_replace(urls.host(url), r"^www\.|:[0-9]+$", "")


def flag_auth(pages: DataFrame) -> DataFrame:
    """(page_id, needs_auth, method): method is profile, cookies or none."""
    suffixes = urls.host_suffixes(F.regexp_replace(urls.host(F.col("url")), r":[0-9]+$", ""))
    needs = F.arrays_overlap(suffixes, F.array(*[F.lit(d) for d in AUTH_DOMAINS]))
    cookies = F.arrays_overlap(suffixes, F.array(*[F.lit(d) for d in COOKIE_DOMAINS]))
    return pages.select("page_id", needs.alias("needs_auth"), F.when(cookies, "cookies").when(needs, "profile").otherwise("none").alias("method"))


def domain_tags(pages: DataFrame, rules: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """(page_id, tag, confidence): tags of the enabled rules (domain, tags, enabled) that fit a page's host: the host itself,
    or for `*.d` a host below d; `www.` counts on neither side. A custom rule replaces those of its domain."""
    bare = lambda d: d.withColumn("domain", F.regexp_replace(F.lower("domain"), r"^www\.", ""))
    rules = bare(rules)
    if custom is not None:
        custom = bare(custom)
        rules = rules.join(custom, "domain", "left_anti").unionByName(custom)
    rules = rules.where("enabled").select("domain", "tags")
    host = plain_host(F.col("url"))
    parents = F.transform(F.slice(urls.host_suffixes(host), 2, 1 << 20), lambda s: F.concat(F.lit("*."), s))
    keys = pages.select("page_id", F.explode(F.concat(F.array(host), parents)).alias("domain")).where("domain <> ''")
    hits = keys.join(rules, "domain").select("page_id", F.explode("tags").alias("tag"))
    return hits.groupBy("page_id", "tag").agg(F.lit(0.8).alias("confidence"))


def glob_regex(glob: Column) -> Column:
    """A glob as a regular expression: `**` any run, `*` a run without dots, `?` one, sets in brackets as they are."""
    out = F.regexp_replace(glob, r"([.^$+{}()|\\/])", r"\\$1")
    out = F.replace(F.replace(out, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^.]*"))
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(out, F.lit("?"), F.lit(".")), F.lit("\x01"), F.lit(".*")), F.lit("$"))


def all_matches(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(page_id, name, rank): the enabled templates (domain, name, url_pattern, priority, is_custom, enabled) of each page, the
    best first: by priority, then by length of the domain, custom ones before others, then by name. A domain fits its
    host and all below it; one with `*`, `?` or a set is a glob for the whole host, and `*` alone fits any. A path pattern is
    a regular expression for path and query if it begins with ^ or ends with $, else a glob for the path."""
    t = templates.where("enabled").withColumn("domain", F.lower("domain"))
    url = F.col("url")
    tail = F.concat(F.when(urls.path(url) == "", "/").otherwise(urls.path(url)), F.regexp_extract(url, urls.PARTS, 4))
    p = pages.select("page_id", urls.host(url).alias("host"), urls.path(url).alias("path"), tail.alias("tail"))
    is_glob = F.col("domain").rlike(r"[*?\[]")
    # suffixes meet plain domains by equality; a glob meets the hosts that have a piece of its longest plain run
    plain = p.withColumn("domain", F.explode(urls.host_suffixes(F.col("host")))).join(t.where(~is_glob), "domain")
    globs = t.where(is_glob).withColumn("host_regex", F.when(F.col("domain") == "*", "").otherwise(glob_regex(F.col("domain"))))
    runs = F.filter(F.split(F.regexp_replace("domain", r"\[[^\]]*\]?", "*"), r"[*?]"), lambda r: r != "")
    longest = F.coalesce(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"], F.lit(""))
    globs = with_piece(globs.withColumn("_run_of", longest), F.col("_run_of"), "domain", "name", "url_pattern", "priority", "is_custom").drop("_run_of")
    hosts = p.withColumn("_piece", F.explode(pieces_of(F.lower("host"))))
    globbed = hosts.join(globs, "_piece").where(F.expr("rlike(host, host_regex)")).drop("host_regex", "_piece")
    pattern = F.col("url_pattern")
    regex = pattern.startswith("^") | pattern.endswith("$")
    fits = pattern.isNull() | (pattern == "") | (regex & F.expr("rlike(tail, url_pattern)")) | (~regex & F.rlike(F.col("tail"), glob_regex(F.regexp_replace(pattern, r"\*+", "**"))))
    hits = plain.select(*globbed.columns).unionByName(globbed).where(fits)
    order = Window.partitionBy("page_id").orderBy(F.desc("priority"), F.desc(F.length("domain")), F.desc("is_custom"), "name")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).select("page_id", "name", "rank")


def match_templates(pages: DataFrame, templates: DataFrame, disabled: list[str] = ()) -> DataFrame:
    """(page_id, name): the best template of each page."""
    t = templates.where(~F.col("name").isin(list(disabled))) if disabled else templates
    return all_matches(pages, t).where("rank = 1").select("page_id", "name")


def template_summary(templates: DataFrame) -> DataFrame:
    """(site, total, enabled, disabled) per site, and for all with site `*`."""
    site = F.regexp_replace(F.lower("domain"), r"^(\*+\.|www\.)+", "")
    n = templates.withColumn("site", site).rollup("site").agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"))
    return n.withColumn("site", F.coalesce("site", F.lit("*")))


def rule_tags(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, tag, confidence, rule_no): tags of the enabled rules (rule_no, type, value, invert, tags, priority, enabled)
    whose condition holds, inverted where asked for. pages: page_id, url, title, content, keywords, categories, author,
    site_name. Rule numbers are unique; a rule of another type never holds. Confidence rises with priority, between 0.6 and 0.9."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    fields = {
        "domain-contains": text(urls.host(F.col("url"))), "url-contains": text(F.col("url")), "title-contains": text(F.col("title")), "content-contains": text(F.col("content")), "author-contains": text(F.col("author")), "site-name-contains": text(F.col("site_name")),
        "keywords-contain": F.array_join(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower), "\x00"),
    }
    whole = F.coalesce("categories", F.array().cast("array<string>"))
    kinds = F.concat(F.array(*[F.struct(F.lit(k).alias("type"), t.alias("text"), F.lit(False).alias("whole")) for k, t in fields.items()]), F.transform(whole, lambda c: F.struct(F.lit("category-is").alias("type"), c.alias("text"), F.lit(True).alias("whole"))))
    rules = rules.where("enabled").withColumn("_value", F.lower("value")).withColumn("_key", F.when(F.col("type") == "category-is", "").otherwise(F.col("_value")))
    rules = with_piece(rules, F.col("_key"), "rule_no", "type", "value").withColumn("_piece", F.when(F.col("type") == "category-is", F.col("_value")).otherwise(F.col("_piece"))).drop("_key")
    each = pages.select("page_id", F.explode(kinds).alias("k")).select("page_id", "k.*")
    each = each.withColumn("_piece", F.explode(F.when(F.col("whole"), F.array("text")).otherwise(pieces_of(F.col("text")))))
    met = each.join(rules, ["type", "_piece"]).where(F.col("whole") | F.contains("text", F.col("_value"))).select("page_id", "rule_no").distinct()
    # an inverted rule holds for all pages but those that it meets; their number is that of the result
    plain = met.join(rules.where("not coalesce(invert, false)").select("rule_no", "tags", "priority"), "rule_no")
    inverted = rules.where("coalesce(invert, false)").agg(F.collect_list(F.struct("rule_no", "tags", "priority")).alias("r"))
    every = pages.select("page_id", F.explode(inverted.scalar()).alias("r")).select("page_id", "r.*")
    hits = plain.select("page_id", "rule_no", "tags", "priority").unionByName(every.join(met, ["page_id", "rule_no"], "left_anti"))
    priority = F.coalesce("priority", F.lit(0))
    confidence = F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.6), 0.6 + priority / 10.0 * 0.3)), 6)
    return hits.select("page_id", F.explode("tags").alias("tag"), confidence.alias("confidence"), "rule_no")


def rules_with_known_note(rules: DataFrame, notes: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Link rules (term, note) whose note (title) exists."""
    key = F.lower if ignore_case else (lambda c: F.col(c))
    known = notes.select(key("title").alias("_key")).distinct()
    return rules.withColumn("_key", key("note")).join(known, "_key", "left_semi").drop("_key")


def drop_dismissed(suggestions: DataFrame, dismissed: DataFrame, current: DataFrame) -> DataFrame:
    """Suggestions (page_id, tag, ...) without dismissed tags (tag) and the tags a page already has (page_id, tag)."""
    out = suggestions.withColumn("_key", F.lower("tag")).join(dismissed.select(F.lower("tag").alias("_key")).distinct(), "_key", "left_anti")
    return out.join(current.select("page_id", F.lower("tag").alias("_key")).distinct(), ["page_id", "_key"], "left_anti").drop("_key")


def coalesce_sources(primary: DataFrame, fallbacks: list[DataFrame]) -> DataFrame:
    """(page_id, text, handle, source_no): the primary record, or where it is empty (text under 5 characters, or no handle) or
    behind a login (walled), the first fallback with a text. source_no is 0 for the primary one."""
    d = primary.select("page_id", "text", "handle", "walled")
    usable = lambda text, handle: (F.length(F.trim(F.coalesce(text, F.lit("")))) >= 5) & (F.coalesce(handle, F.lit("")) != "")
    poor = ~usable(F.col("text"), F.col("handle")) | F.coalesce("walled", F.lit(False))
    chosen = F.when(~poor, F.struct(F.col("text"), F.col("handle"), F.lit(0).alias("source_no")))
    options = []
    for i, f in enumerate(fallbacks, 1):
        d = d.join(f.select("page_id", F.col("text").alias(f"_t{i}"), F.col("handle").alias(f"_h{i}")), "page_id", "left")
        options.append(F.when(usable(F.col(f"_t{i}"), F.coalesce(F.col(f"_h{i}"), F.col("handle"))), F.struct(F.col(f"_t{i}").alias("text"), F.coalesce(F.col(f"_h{i}"), F.col("handle")).alias("handle"), F.lit(i).alias("source_no"))))
    last = F.struct(F.col("text"), F.col("handle"), F.lit(0).alias("source_no"))
    return d.select("page_id", F.coalesce(chosen, *options, last).alias("c")).select("page_id", "c.*")


def group_backlinks(notes: DataFrame) -> DataFrame:
    """(group_id, title, links): for every note of a group a list of the group's other titles. The group's titles are
    gathered once; a group is what one session clipped."""
    titles = notes.groupBy("group_id").agg(F.array_sort(F.collect_set("title")).alias("titles"))
    others = F.filter("titles", lambda t: t != F.col("title"))
    lines = F.array_join(F.transform(others, lambda t: F.concat(F.lit("- [["), t, F.lit("]]"))), "\n")
    return notes.select("group_id", "title").distinct().join(titles, "group_id").select("group_id", "title", F.when(F.size(others) > 0, F.concat(F.lit("## Related\n\n"), lines)).otherwise("").alias("links"))
