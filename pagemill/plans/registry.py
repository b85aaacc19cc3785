"""The registered queries of the page operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import batch as B
from pagemill.operators import history as H
from pagemill.operators import html as W
from pagemill.operators import metadata as M
from pagemill.operators import notes as N
from pagemill.operators import pages as P
from pagemill.operators import records as X
from pagemill.operators import rules as R
from pagemill.operators import sequences as Q
from pagemill.operators import suggest as S
from pagemill.operators import titles as T
from pagemill.plans import site_records
from pagemill.plans.derived import HOSTS, article_pages, listing_pages, question_pages, recipe_pages, site_pages, words_sql
from pagemill.sources.tables import read_table

STOP = "the and for are was with that this from not but have has had you all can her his they who will one our out der die und den das ist les des une est que los las por con del".split()
# domain, tags, enabled
RULES = [("*.example.com", ["com"], True), ("www.example.org", ["org", "nonprofit"], True), ("*.example.net", ["net"], True), ("*.com", ["commercial"], True), ("example.com", ["old"], True), ("*.dev", ["off"], False)]
CUSTOM = [("www.example.com", ["own"], True)]
# rule_no, type, value, invert, tags, priority, enabled
TAG_RULES = [(1, "domain-contains", "NEWS", False, ["news"], 5, True), (2, "url-contains", "/blog/", False, ["blog"], 0, True), (3, "title-contains", "an", False, ["an"], 20, True), (4, "keywords-contain", "e", True, ["no-e"], 2, True), (5, "site-name-contains", "site", False, ["site"], 1, True), (6, "url-contains", "http", False, ["off"], 9, False)]
# domain, name, url_pattern, priority, is_custom, enabled
TEMPLATES = [("example.com", "plain", None, 0, False, True), ("*.example.org", "glob", None, 0, False, True), ("sample.dev", "docs", "/blog/*", 5, False, True), ("shop.sample.com", "shop", "^/blog/2024/[0-9]*[02468]\\?", 5, False, True), ("sample.com", "own", "", 5, True, True), ("*", "any", "^/blog", -1, False, True), ("example.net", "off", None, 9, False, False)]
TERMS = [("the", "Article"), ("of the", "Of the"), ("und", "Conjunction"), ("de", "de")]


def _on(name, f):
    return lambda spark, sf_dir: f(read_table(spark, sf_dir, name))


def _articles(f):
    """A query over the article pages derived from documents."""
    return lambda spark, sf_dir: f(article_pages(read_table(spark, sf_dir, "documents")))


def _domain_tags(spark, sf_dir):
    schema = "domain string, tags array<string>, enabled boolean"
    return R.domain_tags(article_pages(read_table(spark, sf_dir, "documents")), R.rule_table(spark, RULES, schema), R.rule_table(spark, CUSTOM, schema))


def _rule_tags(spark, sf_dir):
    rules = R.rule_table(spark, TAG_RULES, "rule_no int, type string, value string, invert boolean, tags array<string>, priority int, enabled boolean")
    m = M.page_metadata(article_pages(read_table(spark, sf_dir, "documents")))
    m = m.withColumn("content", F.lit("")).withColumn("categories", F.array().cast("array<string>"))
    return R.rule_tags(m, rules).withColumn("rule_no", F.col("rule_no").cast("long"))


def _templates(spark, sf_dir):
    t = R.rule_table(spark, TEMPLATES, "domain string, name string, url_pattern string, priority int, is_custom boolean, enabled boolean")
    return R.all_matches(article_pages(read_table(spark, sf_dir, "documents")), t)


TEMPLATE_SPECS = {"plain": X.Spec((("html", ""),), (X.Field("content", (("blockquote", ""),)), X.Field("title", (("h1", ""),))))}


def _applied(spark, sf_dir):
    pages = article_pages(read_table(spark, sf_dir, "documents"))
    return X.apply_template(pages, _templates(spark, sf_dir).where("rank = 1"), TEMPLATE_SPECS).select("page_id", "name", "title", "content")


def _answered(spark, sf_dir):
    return X.render_answers(Q.top_answers(X.answers(question_pages(read_table(spark, sf_dir, "conversations"))), 2))


def _titles(pages):
    m = M.page_metadata(pages)
    return T.suggest_titles(m.select("page_id", "title", F.col("og_title").alias("headline"), F.lit(None).cast("string").alias("name"), "og_title", "twitter_title", F.concat(F.lit("# "), "headline").alias("markdown")))


def _suggested(spark, sf_dir):
    pages = article_pages(read_table(spark, sf_dir, "documents"))
    m, j = M.page_metadata(pages), M.best_jsonld(pages)
    meta = S.metadata_tags(m.join(j.select("page_id", F.col("keywords").alias("jsonld_keywords")), "page_id"))
    domain = _domain_tags(spark, sf_dir).withColumn("seq", F.lit(0))
    return S.suggest_tags([meta, domain])


def _categories(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("doc_id is not null")
    first = F.substring(F.coalesce("text", F.lit("")), 1, 60)
    return S.detect_categories(d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://a.example/"), F.when(F.pmod("doc_id", F.lit(3)) == 0, "news/").when(F.pmod("doc_id", F.lit(3)) == 1, "blog/recipes/").otherwise(""), F.col("doc_id").cast("string")).alias("url"), first.alias("title"), F.col("text").alias("content"), F.when(F.pmod("doc_id", F.lit(4)) == 0, "NewsArticle").alias("schema_type"), F.array(F.lit("daily news")).alias("keywords")))


def _clips(spark, sf_dir):
    pages = article_pages(read_table(spark, sf_dir, "documents"))
    m = M.page_metadata(pages)
    day = F.to_timestamp(F.lit("2024-05-06 07:08:09"))
    return m.select("page_id", "url", "title", "author", "description", F.col("published"), "canonical_url", "site_name", "language", "keywords", "og_title", "og_type", "og_images", F.lit("web").alias("page_type"), F.lit("Clip, web,clip").alias("raw_tags"), day.alias("clipped_at"), F.concat(F.lit("\n "), "headline").alias("markdown"))


def _notes(spark, sf_dir):
    return N.build_notes(_clips(spark, sf_dir), ("canonical", "og", "keywords"))


def _rendered(spark, sf_dir):
    return T.render_titles(_clips(spark, sf_dir).withColumn("tags", F.array(F.lit("a"))).withColumn("folder", F.lit("Notes/Web")), "{date} {domain} - {author} - {tags}/{folder}/{type} {year}{month}{day}").select("page_id", "rendered")


def _site(f):
    return lambda spark, sf_dir: f(site_pages(read_table(spark, sf_dir, "documents")))


def _crawl(pages):
    return B.crawl(pages, "https://www.tree.test/p/0/", 4, 20)


def _batch(spark, sf_dir):
    """Every document's number as a URL of the site; those that the site lacks fail."""
    d = read_table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("seq"), F.concat(F.lit("https://www.tree.test/p/"), F.col("doc_id").cast("string"), F.lit("?fbclid=1")).alias("url")).distinct()
    return B.batch_clip(d, site_pages(read_table(spark, sf_dir, "documents")))


def _posts(spark, sf_dir):
    """Turns as posts: roles are authors, turns of an even length are reposted by the user."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("ord"), F.col("role").alias("author"), F.when(F.pmod(F.length("text"), F.lit(2)) == 0, "USER").alias("reposter"), F.lit(None).cast("string").alias("reposter_name"), F.lit("user").alias("main"), F.length("text").cast("long").alias("likes"), (F.col("turn") * 2).cast("long").alias("replies"), F.lit(None).cast("long").alias("reposts"), F.when(F.col("turn") > 1, F.col("turn")).cast("long").alias("views"), F.lit(None).cast("long").alias("bookmarks"))


def _answers(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return Q.top_answers(c.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("pos"), (F.pmod("turn", F.lit(3)) == 2).alias("accepted"), F.pmod(F.length("text"), F.lit(7)).cast("long").alias("votes"), F.when(F.col("role") == "assistant", "").otherwise(F.col("role")).alias("author"), F.col("text").alias("body")), 3)


def _captions(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return Q.transcripts(e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 1000).alias("start_ms"), F.col("event_type").alias("text")))


def _lines(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("seq", "str"))
    return Q.lines_from_items(d.select("doc_id", F.floor(F.col("seq") / 40).cast("long").alias("page_no"), "seq", "str", (F.pmod("seq", F.lit(7)) == 6).alias("has_eol")))


def _budget(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return Q.budget_text(c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text"), 4, 300)


def _texts(docs):
    """One text for each doc_id: the smallest, if rows of one differ."""
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))


def _spans(spark, sf_dir):
    d = _texts(read_table(spark, sf_dir, "documents").where("text is not null"))
    start = F.col("range_no") * F.floor(F.length("text") / 3).cast("int")
    spans = d.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("range_no")).select("doc_id", "range_no", start.alias("start"), (start + 10).alias("end"))
    return Q.clip_spans(d, spans)


def _answer_notes(c):
    return H.response_notes(c)


def _seen(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    h = e.select(F.col("event_type").alias("title"), F.concat(F.lit("https://x/"), F.col("user_id").cast("string")).alias("url"), F.array("event_type").alias("tags"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), "event_id")
    return H.filter_history(h, " View", "2024-01-05", "2024-01-20").select("event_id", "title", "url", "date")


QUERIES = {
    "u1_normalize_urls": _on("pages", P.normalize_urls),
    "u2_dedupe_urls": _on("pages", P.dedupe_urls),
    "u4_classify_pages": _on("pages", P.classify_pages),
    "h1_tag_counts": _on("pages", P.tag_counts),
    "u3_resolved_links": _articles(P.page_links),
    "u7_url_keys": _on("pages", lambda p: p.select("page_id", urls.page_kind(F.col("url")).alias("kind"), urls.same_site(F.col("url"), F.lit("https://www.example.com/x")).alias("same"))),
    "u9_auth_flags": _articles(lambda p: R.flag_auth(p.withColumn("url", F.replace("url", F.lit("sample.com"), F.lit("medium.com"))))),
    "h3_page_metadata": _articles(lambda p: M.page_metadata(p).select("page_id", "title", "headline", "description", "author", "published", "canonical_url", "og_title", "og_type", "og_url", F.array_join("og_images", " ").alias("og_images"), "twitter_title", "twitter_site", "site_name", "language")),
    "h4_page_keywords": _articles(M.page_keywords),
    "h6_best_jsonld": _articles(lambda p: M.best_jsonld(p).select("page_id", F.col("score").cast("long").alias("score"), "schema_type", "headline", F.array_join("authors", "|").alias("authors"), "date_published", F.array_join("keywords", "|").alias("keywords"), "word_count")),
    "h7_page_links": _on("pages", P.page_links),
    "h8_main_text": _on("pages", W.main_content),
    "h11_page_markdown": _articles(W.page_markdown),
    "h12_tables": _articles(W.gfm_tables),
    "h13_code_blocks": _articles(W.code_blocks),
    "h16_paywall": _articles(W.paywall_flags),
    "h17_visible_content": _articles(lambda p: W.visible_content(p, 30)),
    "h18_reading_stats": _on("documents", H.reading_stats),
    "t2_template_matches": _templates,
    "t5_template_fields": _applied,
    "t3_domain_tags": _domain_tags,
    "t4_rule_tags": _rule_tags,
    "t6_unseen_links": _on("pages", P.unseen_links),
    "a3_tag_usage": _on("events", H.tag_usage),
    "a4_user_summary": _on("events", H.user_summary),
    "a2_thread_stats": lambda spark, sf_dir: Q.thread_stats(_posts(spark, sf_dir)),
    "w1_threads": lambda spark, sf_dir: Q.detect_threads(_posts(spark, sf_dir)),
    "w2_top_answers": _answers,
    "w4_top_tags": _on("events", H.top_tags),
    "w5_tag_prefix": _on("events", lambda e: H.tag_prefix(e, " P")),
    "w6_recent_tags": _on("events", lambda e: H.recent_tags(e, 3)),
    "w10_lines": _lines,
    "w11_budget_text": _budget,
    "w9_fail_fast": _on("events", H.fail_fast),
    "g4_keywords": _on("documents", lambda d: S.score_keywords(_texts(d), STOP)),
    "g5_bigrams": _on("documents", lambda d: S.score_bigrams(_texts(d), STOP)),
    "g6_categories": _categories,
    "g7_history_tags": _on("events", S.history_tags),
    "g8_suggested_tags": _suggested,
    "g9_suggested_titles": _articles(_titles),
    "g11_rendered_titles": _rendered,
    "n2_note_paths": _articles(lambda p: M.page_metadata(p).select("page_id", N.note_path(F.concat(F.lit(" a/b: "), "title"), "Clips", F.pmod("page_id", F.lit(3))).alias("file_path"))),
    "n5_notes": _notes,
    "n7_linked_terms": _on("documents", lambda d: N.link_terms(d.where("doc_id is not null and text is not null"), TERMS).select("doc_id", "links")),
    "n8_rendered_answers": _answered,
    "n9_vault_merge": lambda spark, sf_dir: N.vault_merge(_notes(spark, sf_dir).withColumn("file_path", F.lower(F.substring("file_path", 1, 8)))),
    "r3_story_listing": lambda spark, sf_dir: X.story_listing(listing_pages(read_table(spark, sf_dir, "events"))),
    "r4_answers": lambda spark, sf_dir: Q.top_answers(X.answers(question_pages(read_table(spark, sf_dir, "conversations"))), 5),
    "r12_recipes": _on("documents", lambda d: X.recipes(recipe_pages(d)).select("page_id", "name", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("steps", "|").alias("steps"), "cook", "servings", "rating")),
    "k1_crawl": _site(_crawl),
    "b1_batch_clip": _batch,
    "b3_search_results": _articles(lambda p: B.search_results(p)),
    "h20_clip_spans": _spans,
    "c3_transcripts": _captions,
    "c2_response_notes": _on("conversations", _answer_notes),
    "y4_filtered_history": _seen,
    "c1_responses": _on("conversations", H.responses),
    "c2_conversation_notes": _on("conversations", H.conversation_notes),
    "y1_daily_counts": _on("events", H.clip_counts),
    "y1_weekly_counts": _on("events", lambda e: H.clip_counts(e, "weekly")),
    "y3_clip_history": _on("events", H.clip_history),
}

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?"


def _norm(url: str) -> str:
    pairs = f"list_transform(list_filter(string_split(regexp_replace(regexp_extract({url}, '{_PARTS}', 4), '^\\?', ''), '&'), lambda p: p <> ''), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)"
    last = f"list_filter({pairs}, lambda p, i: NOT list_contains(list_transform({pairs}[i + 1:], lambda q: split_part(q, '=', 1)), split_part(p, '=', 1)))"
    ordered = f"list_sort(list_transform({last}, lambda p: {{'at': list_position(list_transform({pairs}, lambda q: split_part(q, '=', 1)), split_part(p, '=', 1)), 'p': p}}))"
    kept = f"list_filter(list_transform({ordered}, lambda x: x.p), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid'))"
    base = f"lower(regexp_extract({url}, '{_PARTS}', 1)) || '://' || lower(regexp_extract({url}, '{_PARTS}', 2)) || regexp_replace(regexp_extract({url}, '{_PARTS}', 3), '/$', '')"
    return f"CASE WHEN regexp_matches({url}, '{_PARTS}') THEN {base} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END ELSE {url} END"


def _dec(x: str) -> str:
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return f"trim(regexp_replace({x}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


_HOST = f"lower(regexp_extract(url, '{_PARTS}', 2))"
_LAST2 = f"array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.')"
_U = f"SELECT page_id, url, {_norm('url')} AS norm_url, {_HOST} AS host, {_LAST2} AS site_key FROM pages"
_TYPE = r"CASE WHEN regexp_matches(url, '^https?://(www\.|mobile\.)?(twitter|x)\.com/') THEN 'twitter' WHEN regexp_matches(url, '^https?://(www\.)?youtube\.com/(watch|shorts)') THEN 'youtube' WHEN regexp_matches(url, '(?i)^https?://.*\.pdf(\?|$)') THEN 'pdf' ELSE 'web' END"
_BIN = "pdf|zip|tar|gz|rar|7z|png|jpg|jpeg|gif|webp|svg|ico|mp3|mp4|avi|mov|wav|flac|doc|docx|xls|xlsx|ppt|pptx|exe|dmg|apk|app"


def _crawl(url: str) -> str:
    p = f"lower(regexp_extract({url}, '{_PARTS}', 3))"
    return f"regexp_matches({url}, '(?i)^https?://') AND NOT regexp_matches({p}, '\\.({_BIN})$') AND NOT regexp_matches({p}, '^(/login|/signin|/signup|/register|/logout|/admin|/api/|/search|/tag/|/tags/)')"


_HOSTS = ", ".join(f"'{h}'" for h in HOSTS)
# The words that the article pages were made of; what the page operators find is told from them, without any HTML.
_W = f"(SELECT *, doc_id AS page_id, [{_HOSTS}][doc_id % {len(HOSTS)} + 1] AS host, printf('2024-%02d-%02d', doc_id % 12 + 1, doc_id % 28 + 1) AS day FROM ({words_sql()}))"
_WORDS = "[w[12], w[13], w[12], w[14], 'x1', w[13]]"
_KEYS = f"list_filter({_WORDS}, lambda x, i: list_position({_WORDS}, x) = i)"
_TITLE = "w[1] || ' ' || w[2] || ' & ' || w[3] || ' - GitHub'"
_CANON = "CASE WHEN doc_id % 2 = 0 THEN 'https://' || host || '/blog/posts/' || doc_id ELSE 'https://' || host || '/p/' || doc_id END"
_SITE = "CASE WHEN doc_id % 4 = 1 THEN 'Site ' || w[10] ELSE w[11] END"
_DESC = "w[5] || ' ' || w[6] || ' \"' || w[7] || '\"'"
_P1 = "trim(array_to_string(own[15:44], ' ') || ' It is said again and again,')"
_P1_TEXT = f"{_P1} || ' ' || w[3] || ' and ' || w[4] || ' in ' || w[5] || ' at ' || w[7] || '.'"
_P2 = "array_to_string(own[45:], ' ') || ', after all.'"
_QUOTE = "array_to_string(own[21:25], ' ')"
_MAIN = f"concat_ws(' ', w[1] || ' <' || w[2] || '>', {_P1_TEXT}, {_P2}, 'Lists', w[8], w[9], w[10], w[11], nullif({_QUOTE}, ''), 'def ' || w[12] || '(x): return x < 1', w[13], 'n|o', w[14], n_words)"
_TABLE = r"'| ' || w[13] || ' | n\|o |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || w[14] || ' | ' || n_words || ' |'"
_CODE = "'def ' || w[12] || '(x):' || chr(10) || '    return x < 1'"
_MARKDOWN = f"""'# ' || w[1] || ' <' || w[2] || '>' || chr(10) || chr(10) || {_P1} || ' **' || w[3] || '** and *' || w[4] || '* in `' || w[5] || '` at [' || w[7] || '](https://example.org/x?a=1&b=' || w[6] || ').' || chr(10) || chr(10) || {_P2} || chr(10) || chr(10)
  || '## Lists' || chr(10) || chr(10) || '- ' || w[8] || chr(10) || '- ' || w[9] || chr(10) || '  1. ' || w[10] || chr(10) || '  2. ' || w[11] || chr(10) || chr(10) || CASE WHEN {_QUOTE} <> '' THEN '> ' || {_QUOTE} || chr(10) || chr(10) ELSE '' END
  || '```python' || chr(10) || {_CODE} || chr(10) || '```' || chr(10) || chr(10) || {_TABLE} || chr(10) || chr(10) || '![' || w[1] || '](/img/' || doc_id || '.png)'"""
_LINKS = r"""SELECT page_id, dst_url, CAST(min(link_pos) AS INTEGER) AS link_pos FROM (SELECT page_id, link_pos, CASE WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]+', 0) || h END AS dst_url
  FROM (SELECT page_id, url, i - 1 AS link_pos, regexp_replace(l[i], '#.*$', '') AS h, l[i] AS raw FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"', 1) AS l FROM pages), range(1, len(l) + 1) t(i))
  WHERE NOT regexp_matches(raw, '(?i)^(#|mailto:|tel:|javascript:)')) WHERE dst_url IS NOT NULL GROUP BY ALL"""
_CLEAN = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?is)<div class=\"ad\">.*?</div>', '', 'g')"
_ART, _BODY = (f"regexp_extract({_CLEAN}, '(?is)<{t}\\b[^>]*>(.*?)</{t}>', 1)" for t in ("article", "body"))
_TEXT = f"""SELECT page_id, {_dec(f"regexp_replace(regexp_replace(CASE WHEN {_ART} <> '' THEN {_ART} ELSE {_BODY} END, '</?(b|i|a|em|strong|span|code)(\\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g')")} AS text FROM pages"""
_DOMAIN = "(VALUES (0, 'com'), (0, 'commercial'), (1, 'org'), (1, 'nonprofit'), (2, 'net'), (4, 'commercial'), (5, 'own'), (5, 'commercial')) r(k, tag)"
_TEMPLATE = "(VALUES (0, 'plain', 1), (0, 'any', 2), (1, 'glob', 1), (1, 'any', 2), (2, 'any', 1), (3, 'docs', 1), (3, 'any', 2), (4, 'shop', 1), (4, 'own', 2), (4, 'any', 3), (5, 'plain', 1), (5, 'any', 2)) r(k, name, rank)"
_SMALL = "'a','an','the','and','but','or','nor','for','yet','so','at','by','in','of','on','to','up','via','with','from','as','is','it','de','la','le','du','da','di','van','von'"
_HEADING = f"w[1] || ' <' || CASE WHEN lower(w[2]) IN ({_SMALL}) AND NOT (w[1] || w[2] = upper(w[1] || w[2])) THEN lower(w[2]) ELSE upper(substr(w[2], 1, 1)) || lower(substr(w[2], 2)) END || '>'"
_TITLES = f"""SELECT page_id, i AS rank, c[i].t AS title, c[i].v AS confidence, c[i].s AS source FROM (SELECT page_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y.t)), lower(x.t)) = i)[1:3] AS c FROM (SELECT page_id,
  list_filter([{{'t': w[1] || ' ' || w[2] || ' & ' || w[3], 'v': 0.9::DOUBLE, 's': 'original'}}, {{'t': w[1] || ' ' || w[2], 'v': 0.85::DOUBLE, 's': 'headline'}}, CASE WHEN w[1] <> w[2] THEN {{'t': w[2] || ' ' || w[1], 'v': 0.7::DOUBLE, 's': 'twitter'}} END,
  {{'t': {_HEADING}, 'v': 0.5::DOUBLE, 's': 'generated'}}], lambda x: x IS NOT NULL) AS l FROM {_W})), range(1, len(c) + 1) t(i)"""
_Q = "replace({}, '\"', '\\\"')"
_YAML = lambda key, value: f"'{key}: \"' || {value} || '\"' || chr(10)"
_ITEMS = lambda key, items: f"'{key}:' || chr(10) || array_to_string(list_transform({items}, lambda x: '  - \"' || x || '\"'), chr(10)) || chr(10)"
_NOTES = f"""SELECT page_id, 'Clips/' || trim(substr({_TITLE}, 1, 100)) AS file_path, '---' || chr(10) || {_YAML('source', _CANON)} || {_YAML('title', f'trim(substr({_TITLE}, 1, 100))')} || {_YAML('author', "w[8] || ' ' || w[9]")} || {_YAML('date_clipped', "'2024-05-06T07:08:09.000Z'")}
  || {_ITEMS('tags', "['Clip', 'web']")} || {_YAML('type', "'article'")} || {_YAML('canonical_url', _CANON)} || {_YAML('description', _Q.format(_DESC))} || {_ITEMS('keywords', _KEYS)} || {_YAML('language', "coalesce(lang, 'xx')")}
  || {_ITEMS('og_images', "['https://cdn.example.com/1.png', 'https://' || host || '/blog/2024/b.png']")} || {_YAML('og_title', "w[1] || ' ' || w[2]")} || {_YAML('og_type', "'article'")} || {_YAML('page_type', "'web'")} || {_YAML('published_date', "day || 'T08:00:00Z'")} || {_YAML('site_name', _SITE)}
  || '---' || chr(10) || chr(10) || w[1] || ' <' || w[2] || '>' || chr(10) AS note FROM {_W}"""
_TREE = """WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS i FROM documents WHERE doc_id IS NOT NULL AND doc_id % 11 <> 5),
  v(i, d) AS (SELECT 0::BIGINT, 0 UNION SELECT c, d + 1 FROM (SELECT unnest([2 * i + 1, 2 * i + 2]) AS c, d FROM v WHERE d < 4 AND i IN (SELECT i FROM ids)))
  SELECT row_number() OVER (ORDER BY d, i) - 1 AS visit, 'https://www.tree.test/p/' || i AS url, d AS depth, i FROM v ORDER BY visit LIMIT 20"""
_SEEN = "SELECT event_id, event_type AS title, 'https://x/' || user_id AS url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date FROM events WHERE contains(lower(event_type || ' https://x/' || user_id), 'view') AND ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
_RESP = """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS response_no,
  substr(trim(regexp_replace(coalesce(list_filter(string_split(coalesce(text, ''), chr(10)), lambda v: trim(v) <> '')[1], 'Response'), '^#+[ \\t]*', '')), 1, 80) AS preview, text FROM conversations WHERE role = 'assistant'"""
_USAGE = "SELECT lower(trim(event_type)) AS tag_key, count(*) AS uses, max(ts) AS last_used, arg_min(trim(event_type), (ts, event_id)) AS tag FROM events WHERE trim(event_type) <> '' GROUP BY 1"


_PLAIN = "text"
for _pattern, _by in ((r"(?s)```.*?```", " "), ("`[^`]+`", " "), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", " "), ("<[^>]+>", " "), (r"(?m)^#{1,6}\s+", " "), ("[*_~>|]", " "), (r"(?m)^[-*_]{3,}$", " ")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_by}', 'g')"
_PLAIN_WORDS = f"SELECT doc_id, regexp_extract_all({_PLAIN}, '\\b[A-Za-z][A-Za-z0-9-]*\\b') AS v FROM documents WHERE doc_id IS NOT NULL"
_COUNTS = f"SELECT *, sum(freq) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, lower(v[i]) AS word, count(*) AS freq, min(i) AS first, max(regexp_matches(v[i], '^[A-Z].')) AS capital FROM ({_PLAIN_WORDS}), range(1, len(v) + 1) t(i) GROUP BY ALL)"
_KEPT = "length({w}) >= 3 AND {w} NOT IN (" + ", ".join(f"'{w}'" for w in [*STOP, *S.GENERIC]) + ")"


def _counts(start: str) -> str:
    return f"SELECT *, CASE WHEN saves > 999 THEN '999+' ELSE saves::VARCHAR END AS label FROM (SELECT {start} AS period_start, count(*) AS saves FROM events GROUP BY 1)"


SQL = {
    "u1_normalize_urls": _U,
    "u2_dedupe_urls": f"SELECT norm_url, min(page_id) AS page_id, arg_min(url, page_id) AS url, count(*) AS copies FROM ({_U}) GROUP BY norm_url",
    "u4_classify_pages": f"SELECT page_id, {_TYPE} AS page_type, {_crawl('url')} AS crawlable, regexp_matches(url, '(?i)^https?://') AS clippable FROM pages",
    "h1_tag_counts": """SELECT tag, count(*) FILTER (NOT starts_with(tok, '</')) AS opened, count(*) FILTER (starts_with(tok, '</')) AS closed FROM (SELECT tok, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag
      FROM (SELECT unnest(regexp_extract_all(html, '(?s)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<[^>]*>|[^<]+')) AS tok FROM pages)) WHERE tag <> '' AND (starts_with(tok, '</') OR tag NOT IN ('script', 'style')) GROUP BY tag""",
    "u3_resolved_links": f"""SELECT page_id, dst_url, min(link_pos)::INTEGER AS link_pos FROM (SELECT page_id, unnest(['https://' || host || '/', 'https://' || host || '/blog/up/x', 'https://' || host || '/blog/2024/' || doc_id || '?q=1', 'https://example.org/x?a=1&b=' || w[6]]) AS dst_url, unnest([0, 1, 2, 3]) AS link_pos FROM {_W}) GROUP BY ALL""",
    "u7_url_keys": f"SELECT page_id, 'other' AS kind, {_LAST2} = 'example.com' AS same FROM pages",
    "u9_auth_flags": "SELECT doc_id AS page_id, doc_id % 6 = 4 AS needs_auth, CASE WHEN doc_id % 6 = 4 THEN 'cookies' ELSE 'none' END AS method FROM documents WHERE doc_id IS NOT NULL",
    "h3_page_metadata": f"""SELECT page_id, {_TITLE} AS title, w[1] || ' <' || w[2] || '>' AS headline, {_DESC} AS description, w[8] || ' ' || w[9] AS author, day || 'T08:00:00Z' AS published, {_CANON} AS canonical_url, w[1] || ' ' || w[2] AS og_title, 'article' AS og_type, 'https://' || host || '/p/' || doc_id AS og_url,
      'https://cdn.example.com/1.png https://' || host || '/blog/2024/b.png' AS og_images, w[2] || ' ' || w[1] AS twitter_title, '@' || w[11] AS twitter_site, {_SITE} AS site_name, coalesce(lang, 'xx') AS language FROM {_W}""",
    "h4_page_keywords": f"SELECT page_id, (i - 1)::INTEGER AS pos, k[i] AS keyword FROM (SELECT page_id, {_KEYS} AS k FROM {_W}), range(1, len(k) + 1) t(i)",
    "h6_best_jsonld": f"""SELECT page_id, 26::BIGINT AS score, 'BlogPosting' AS schema_type, w[1] || ' ' || w[2] AS headline, CASE WHEN doc_id % 3 = 2 THEN w[8] || '|' || w[9] ELSE w[8] END AS authors, day AS date_published,
      CASE WHEN w[12] = w[13] THEN w[12] ELSE w[12] || '|' || w[13] END AS keywords, n_words::DOUBLE AS word_count FROM {_W}""",
    "h7_page_links": _LINKS,
    "h8_main_text": _TEXT,
    "h11_page_markdown": f"SELECT page_id, {_MARKDOWN} AS markdown FROM {_W}",
    "h12_tables": f"SELECT page_id, 1::BIGINT AS table_no, {_TABLE} AS markdown FROM {_W}",
    "h13_code_blocks": f"SELECT page_id, 1::BIGINT AS block_no, 'python' AS language, {_CODE} AS code, '```' AS fence FROM {_W}",
    "h16_paywall": f"SELECT page_id, 2::BIGINT AS signs, length({_MAIN}) < 500 AS paywalled FROM {_W}",
    "h17_visible_content": f"SELECT page_id, concat_ws(chr(10) || chr(10), {_P1_TEXT}, CASE WHEN length({_P2}) > 30 THEN {_P2} END, CASE WHEN length({_QUOTE}) > 30 THEN {_QUOTE} END, 'See also, other pages, and more of them.') AS text FROM {_W}",
    "h18_reading_stats": r"""SELECT doc_id, len(regexp_extract_all(t, '[^ ]+'))::BIGINT AS words, length(t)::BIGINT AS chars, greatest(1, ceil(len(regexp_extract_all(t, '[^ ]+')) / 220.0))::BIGINT + 0 * length(t) AS minutes
      FROM (SELECT doc_id, nullif(trim(regexp_replace(text, '[\x20\x09-\x0D\x{A0}]+', ' ', 'g')), '') AS t FROM documents)""",
    "h20_clip_spans": """SELECT doc_id, string_agg(p, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS text, count(*) AS ranges FROM (SELECT doc_id, i, trim(substr(text, i * (length(text) // 3) + 1, 10)) AS p FROM documents, range(3) t(i) WHERE doc_id IS NOT NULL AND text IS NOT NULL) WHERE p <> '' GROUP BY 1""",
    "t2_template_matches": f"SELECT doc_id AS page_id, name, rank::BIGINT AS rank FROM documents JOIN {_TEMPLATE} ON doc_id % 6 = k",
    "t5_template_fields": f"SELECT page_id, 'plain' AS name, w[1] || ' <' || w[2] || '>' AS title, coalesce(nullif({_QUOTE}, ''), {_MAIN}) AS content FROM {_W} WHERE doc_id % 6 IN (0, 5)",
    "t3_domain_tags": f"SELECT doc_id AS page_id, tag, 0.8::DOUBLE AS confidence FROM documents JOIN {_DOMAIN} ON doc_id % 6 = k",
    "t4_rule_tags": f"""SELECT page_id, tag, confidence::DOUBLE AS confidence, n::BIGINT AS rule_no FROM (SELECT page_id, unnest([CASE WHEN doc_id % 6 = 2 THEN 1 END, 2, CASE WHEN contains(lower({_TITLE}), 'an') THEN 3 END, CASE WHEN NOT contains(lower(array_to_string({_KEYS}, ' ')), 'e') THEN 4 END, CASE WHEN contains(lower({_SITE}), 'site') THEN 5 END]) AS n FROM {_W})
      JOIN (VALUES (1, 'news', 0.75), (2, 'blog', 0.6), (3, 'an', 0.9), (4, 'no-e', 0.66), (5, 'site', 0.63)) r(no, tag, confidence) ON n = no""",
    "t6_unseen_links": f"SELECT dst_url, count(DISTINCT page_id) AS pages FROM (SELECT page_id, {_norm('dst_url')} AS dst_url FROM ({_LINKS}) WHERE {_crawl('dst_url')}) WHERE dst_url NOT IN (SELECT norm_url FROM ({_U})) GROUP BY 1",
    "a3_tag_usage": _USAGE,
    "a4_user_summary": "SELECT user_id, count(*) AS total, count(*) FILTER (value >= 50) AS succeeded, count(*) FILTER (value < 50) AS failed, max(ts) AS last_ts FROM events GROUP BY 1",
    "w4_top_tags": f"SELECT * FROM ({_USAGE}) WHERE uses >= 2 ORDER BY uses DESC, last_used DESC, tag_key LIMIT 10",
    "a2_thread_stats": """SELECT conv_id AS page_id, count(*) AS posts, sum(turn * 2)::BIGINT AS replies, 0::BIGINT AS reposts, coalesce(sum(length(text)), 0)::BIGINT AS likes, sum(turn) FILTER (turn > 1)::BIGINT AS views, NULL::BIGINT AS bookmarks,
      floor(sum(turn * 2) / count(*) + 0.5)::BIGINT AS mean_replies, 0::BIGINT AS mean_reposts, floor(coalesce(sum(length(text)), 0) / count(*) + 0.5)::BIGINT AS mean_likes FROM conversations GROUP BY 1""",
    "w1_threads": """SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS position FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS n FROM (SELECT conv_id AS page_id, turn AS ord, sum((role <> 'user' AND coalesce(length(text) % 2, 1) <> 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS e
      FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS b FROM conversations) WHERE turn >= b) WHERE e = 0) WHERE n > 1""",
    "w2_top_answers": """SELECT question_id, rank, accepted, votes, CASE WHEN role = 'assistant' THEN 'Community' ELSE role END AS author, body FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY accepted DESC, votes DESC NULLS LAST, turn) AS rank
      FROM (SELECT conv_id AS question_id, turn, turn % 3 = 2 AS accepted, (length(text) % 7)::BIGINT AS votes, role, text AS body FROM conversations)) WHERE rank <= 3 AND trim(coalesce(body, '')) <> ''""",
    "w5_tag_prefix": f"SELECT * FROM ({_USAGE}) WHERE starts_with(tag_key, 'p') ORDER BY uses DESC, last_used DESC, tag_key LIMIT 10",
    "w6_recent_tags": f"SELECT * FROM ({_USAGE}) ORDER BY last_used DESC, tag_key LIMIT 3",
    "w10_lines": """SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY l) AS line_no, line FROM (SELECT doc_id, ((i - 1) // 40)::BIGINT AS page_no, (i - 1) // 7 AS l, string_agg(v[i], ' ' ORDER BY i) AS line
      FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS v FROM documents WHERE doc_id IS NOT NULL), range(1, len(v) + 1) t(i) GROUP BY ALL)""",
    "w11_budget_text": """SELECT doc_id, rtrim(substr(coalesce(string_agg(c, '' ORDER BY n) FILTER (n <= 4), ''), 1, 300)) AS text, max(n) > 4 OR sum(length(c)) > 300 AS truncated FROM (SELECT conv_id AS doc_id, turn + 1 AS n, '## Page ' || (turn + 1) || chr(10) || chr(10) || text || chr(10) || chr(10) AS c
      FROM conversations WHERE trim(coalesce(text, '')) <> '') GROUP BY 1""",
    "w9_fail_fast": "SELECT event_id, user_id, ts, event_type FROM (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM events) WHERE f = 0",
    "g4_keywords": f"""SELECT doc_id, word, freq, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS rank FROM (SELECT doc_id, word, freq, first,
      round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ln(freq + 1.0::DOUBLE) / ln(10.0::DOUBLE) * 0.5::DOUBLE + least(length(word) / 12.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE + CASE WHEN capital THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END - 0.0::DOUBLE) * least(1.0::DOUBLE, 500.0::DOUBLE / total) + 0.2::DOUBLE)), 6) AS score
      FROM ({_COUNTS}) WHERE freq >= 2 AND {_KEPT.format(w="word")})) WHERE rank <= 8""",
    "g5_bigrams": f"""SELECT doc_id, a AS first_word, b AS second_word, freq, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) AS rank FROM (SELECT p.*, round(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ln(p.freq + 1.0::DOUBLE) / ln(10.0::DOUBLE) * 0.5::DOUBLE
      + least((length(a) + length(b) + 1) / 12.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE + 0.0::DOUBLE - 0.0::DOUBLE) * least(1.0::DOUBLE, 500.0::DOUBLE / p.total) + 0.2::DOUBLE)), 6) * 0.9::DOUBLE, 6) AS score
      FROM (SELECT doc_id, lower(v[i]) AS a, lower(v[i + 1]) AS b, count(*) AS freq, min(i) AS first, any_value(len(v)) AS total FROM ({_PLAIN_WORDS}), range(1, len(v)) t(i) WHERE {_KEPT.format(w="lower(v[i])")} AND {_KEPT.format(w="lower(v[i + 1])")} GROUP BY ALL) p
      JOIN ({_COUNTS}) x ON x.doc_id = p.doc_id AND x.word = a JOIN ({_COUNTS}) y ON y.doc_id = p.doc_id AND y.word = b WHERE p.freq >= 3 AND p.freq * 2 >= least(x.freq, y.freq))) WHERE rank <= 2""",
    "g7_history_tags": f"SELECT tag, round(greatest(0.2::DOUBLE, 0.4::DOUBLE - i * 0.02::DOUBLE), 6) AS confidence, i AS seq FROM (SELECT tag, row_number() OVER (ORDER BY uses DESC, last_used DESC, tag_key) - 1 AS i FROM ({_USAGE}) WHERE uses >= 2) WHERE i < 10",
    "g8_suggested_tags": f"""SELECT page_id, tag, confidence::DOUBLE AS confidence, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, s, n, tag) AS rank FROM (SELECT page_id, tag, arg_min(confidence, (s, n)) AS confidence, min(s) AS s, arg_min(n, (s, n)) AS n FROM (
      SELECT page_id, k[i] AS tag, 0.9 AS confidence, 0 AS s, i AS n FROM (SELECT page_id, list_transform({_KEYS}, lambda x: substr(lower(x), 1, 50)) AS k FROM {_W}), range(1, 5) t(i) WHERE i <= len(k)
      UNION ALL SELECT doc_id, 'article', 0.7, 0, 99 FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, tag, 0.8, 1, 0 FROM documents JOIN {_DOMAIN} ON doc_id % 6 = k) GROUP BY ALL)""",
    "g9_suggested_titles": _TITLES,
    "g11_rendered_titles": f"SELECT page_id, '2024-05-06 ' || regexp_replace(host, '^www\\.', '') || ' - ' || w[8] || ' ' || w[9] || ' - a/Web/web 20240506' AS rendered FROM {_W}",
    "n2_note_paths": f"SELECT page_id, 'Clips/' || CASE WHEN doc_id % 3 > 0 THEN 'depth-' || (doc_id % 3) || '/' ELSE '' END || trim(substr('a-b- ' || {_TITLE}, 1, 100)) AS file_path FROM {_W}",
    "n5_notes": _NOTES,
    "n7_linked_terms": r"""SELECT doc_id, (regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])of the($|[^\p{L}\p{N}_])')::INT + regexp_matches(regexp_replace(t, '(^|[^\p{L}\p{N}_])[oO][fF] [tT][hH][eE]\b', '\1  ', 'g'), '(?i)(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')::INT
      + regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])und($|[^\p{L}\p{N}_])')::INT + regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])de($|[^\p{L}\p{N}_])')::INT)::BIGINT AS links FROM (SELECT doc_id, text AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)""",
    "n9_vault_merge": f"SELECT lower(substr(file_path, 1, 8)) AS file_path, arg_max(note, page_id) AS note, count(*) AS versions FROM ({_NOTES}) GROUP BY 1",
    "r3_story_listing": """SELECT page AS page_id, n AS rank, 'A ' || event_type || ' > b' AS title, '/s?a=1&i=' || event_id AS url, CASE WHEN n % 3 <> 0 THEN n END AS points, CASE WHEN n % 3 <> 0 THEN 'u' || event_id ELSE '' END AS author, CASE WHEN n % 3 <> 0 THEN n END AS comments
      FROM (SELECT *, event_id // 30 AS page, row_number() OVER (PARTITION BY event_id // 30 ORDER BY event_id) AS n FROM events WHERE event_id IS NOT NULL)""",
    "r4_answers": """SELECT question_id, rank, accepted, votes, author, body FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY accepted DESC, votes DESC, turn) AS rank FROM (SELECT conv_id AS question_id, turn, turn % 3 = 2 AS accepted, (turn * 7 % 5)::BIGINT AS votes,
      CASE WHEN role = 'user' THEN 'user' ELSE 'Community' END AS author, trim(regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0) || ' & on') AS body FROM conversations)) WHERE rank <= 5""",
    "n8_rendered_answers": """SELECT question_id, string_agg('## Answer ' || rank || CASE WHEN accepted THEN ' ✓ accepted' ELSE '' END || chr(10) || chr(10) || '**' || author || '**, ' || votes || ' votes' || chr(10) || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS body
      FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY accepted DESC, votes DESC, turn) AS rank FROM (SELECT conv_id AS question_id, turn, turn % 3 = 2 AS accepted, (turn * 7 % 5)::BIGINT AS votes,
      CASE WHEN role = 'user' THEN 'user' ELSE 'Community' END AS author, trim(regexp_extract(coalesce(text, ''), '[A-Za-z]+', 0) || ' & on') AS body FROM conversations)) WHERE rank <= 2 GROUP BY 1""",
    "r12_recipes": f"""SELECT page_id, w[1] || ' ' || w[2] AS name, w[3] || '|' || w[4] AS ingredients, CASE doc_id % 3 WHEN 0 THEN w[4] || '|' || w[5] WHEN 1 THEN w[4] || '|' || w[5] || '|' || w[6] ELSE w[4] END AS steps,
      CASE doc_id % 3 WHEN 0 THEN '20 minutes' WHEN 1 THEN '1 hour 20 minutes' ELSE '2 hours 20 minutes' END AS cook, '4' AS servings, 4.5::DOUBLE AS rating FROM {_W}""",
    "k1_crawl": f"SELECT visit, url, depth::INTEGER AS depth, CASE WHEN i IN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 5) THEN 'success' ELSE 'failed' END AS status, CASE WHEN i IN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 5) THEN i END AS page_id FROM ({_TREE})",
    "b1_batch_clip": "SELECT DISTINCT doc_id AS seq, 'https://www.tree.test/p/' || doc_id || '?fbclid=1' AS url, 'web' AS page_type, doc_id % 11 <> 5 AS success, CASE WHEN doc_id % 11 = 5 THEN 'page not stored' END AS error, CASE WHEN doc_id % 11 <> 5 THEN doc_id END AS page_id FROM documents WHERE doc_id IS NOT NULL",
    "b3_search_results": f"SELECT page_id, 1::BIGINT AS rank, 'https://example.org/x?a=1&b=' || w[6] AS url, w[7] AS title FROM {_W} WHERE length(w[7]) >= 3",
    "c3_transcripts": """SELECT user_id AS video_id, string_agg('**[' || CASE WHEN event_id >= 3600 THEN printf('%d:%02d:%02d', event_id // 3600, event_id // 60 % 60, event_id % 60) ELSE printf('%d:%02d', event_id // 60, event_id % 60) END || ']** ' || event_type, chr(10) || chr(10) ORDER BY event_id) AS transcript FROM events GROUP BY 1""",
    "c2_response_notes": f"SELECT conv_id, response_no, 'Conversation ' || conv_id || ' - Response ' || response_no AS title, '# Conversation ' || conv_id || ' - Response ' || response_no || chr(10) || chr(10) || coalesce(text, '') AS note FROM ({_RESP})",
    "y4_filtered_history": _SEEN,
    "c1_responses": _RESP,
    "c2_conversation_notes": f"SELECT conv_id, count(*) AS responses, string_agg('## Response ' || response_no || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY response_no) AS note FROM ({_RESP}) GROUP BY 1",
    "y1_daily_counts": _counts("ts::DATE"),
    "y1_weekly_counts": _counts("date_trunc('week', ts)::DATE"),
    "y3_clip_history": "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
}

QUERIES |= site_records.QUERIES
SQL |= site_records.SQL
