"""Tags for pages: from metadata, domains, rules, words, word pairs, categories and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.categories import PATTERNS, PRIORITY
from pagemill.functions.text import collapsed
from pagemill.operators.history import top_tags
from pagemill.operators.structure import by_page, once

# Words of programming that say little about a text and are left out; types of Open Graph that make a tag.
GENERIC = (
    "function functions method methods class classes object objects variable variables value values string strings number numbers integer integers array arrays list lists map maps item items element elements "
    "entry entries property properties attribute attributes field fields parameter parameters argument arguments return returns result results input output response request callback handler listener event events "
    "true false null undefined none default custom local global public private source target name names id ids key keys code codes tag tags error errors exception exceptions log logs debug info warn warning"
).split()
OG_TYPES = ["article", "video", "music", "book", "profile"]


def clean_tag(tag: Column) -> Column:
    """Lower case, other signs than letters, digits and dashes as dashes, 50 characters."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), "[^a-z0-9-]", "-"), "-+", "-")
    return F.substring(F.regexp_replace(out, "^-|-$", ""), 1, 50)


def metadata_tags(meta: DataFrame) -> DataFrame:
    """(page_id, tag, confidence, seq) for pages with keywords, jsonld_keywords and og_type."""
    none = F.array().cast("array<string>")
    listed = lambda c, v: F.transform(F.coalesce(c, none), lambda k: F.struct(clean_tag(k).alias("tag"), F.lit(v).alias("confidence")))
    og = F.when(F.col("og_type").isin(OG_TYPES), F.array("og_type")).otherwise(none)
    all_ = F.concat(listed(F.col("keywords"), 0.9), listed(F.col("jsonld_keywords"), 0.85), listed(og, 0.7))
    return meta.select("page_id", F.posexplode(all_).alias("seq", "t")).where("t.tag <> ''").select("page_id", "t.tag", "t.confidence", F.col("seq").cast("long").alias("seq"))


def plain_text(md: Column) -> Column:
    """A Markdown text without code, link targets, images, tags, marks and rules."""
    steps = [(r"(?s)```.*?```", " "), (r"`[^`]+`", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", " "), (r"<[^>]+>", " "), (r"(?m)^#{1,6}\s+", " "), (r"[*_~>|]", " "), (r"(?m)^[-*_]{3,}$", " ")]
    for pattern, by in steps:
        md = F.regexp_replace(md, pattern, by)
    return collapsed(md)


def words_of(col: str = "text") -> Column:
    """Words of ASCII letters, digits and inner dashes that begin with a letter; other letters bound a word."""
    return F.regexp_extract_all(plain_text(F.coalesce(F.col(col), F.lit(""))), F.lit(r"(?<![A-Za-z0-9_])[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?![A-Za-z0-9_])"), F.lit(0))


def tokenize_words(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, word)."""
    return docs.select("doc_id", F.posexplode(words_of()).alias("pos", "word"))


def meaningful(word: Column, stop: list[str]) -> Column:
    """Words of three signs or more that are neither generic nor in the stop list, a parameter of the callers."""
    return (F.length(word) >= 3) & ~word.isin(stop) & ~word.isin(GENERIC)


WORD_PARTS = 512  # of texts that are opened up into words


def content_words(docs: DataFrame, stop: list[str]) -> DataFrame:
    """(doc_id, word, freq, first, capital, total): the kept words of each document, in lower case. Counted where the document
    lies: texts are dealt by document once, in parts that aren't put together again, and no word is moved by itself."""
    w = by_page(docs, "doc_id", WORD_PARTS).select("doc_id", F.posexplode(words_of()).alias("pos", "raw")).withColumn("word", F.lower("raw"))
    n = w.groupBy("doc_id", "word").agg(F.count("*").alias("freq"), F.min("pos").cast("long").alias("first"), F.max(F.col("raw").rlike("^[A-Z].")).alias("capital"))
    n = n.withColumn("total", F.sum("freq").over(Window.partitionBy("doc_id")))
    return n.where(meaningful(F.col("word"), stop))


# The weights of the score.
def keyword_score(freq: Column, length: Column, total: Column, capital: Column, generic: Column) -> Column:
    raw = F.log(freq + F.lit(1.0)) / F.log(F.lit(10.0)) * 0.5 + F.least(length / 12.0, F.lit(1.0)) * 0.15 + F.when(capital, 0.1).otherwise(0.0) - F.when(generic, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * F.least(F.lit(1.0), F.lit(500.0) / total) + 0.2)), 6)


def score_keywords(docs: DataFrame, stop: list[str], k: int = 8) -> DataFrame:
    """(doc_id, word, freq, score, rank): the k best words found twice or more; of equal scores the first in the text."""
    n = content_words(docs, stop).where("freq >= 2")
    n = n.withColumn("score", keyword_score(F.col("freq"), F.length("word"), F.col("total"), F.col("capital"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "first"))
    return n.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("doc_id", "word", "freq", "score", "rank")


def score_bigrams(docs: DataFrame, stop: list[str], k: int = 2) -> DataFrame:
    """(doc_id, first_word, second_word, freq, score, rank): the k best pairs of kept words that follow each other in the text
    three times or more, and half as often as the rarer of the two."""
    words = F.transform(words_of(), F.lower)
    d = by_page(docs, "doc_id", WORD_PARTS).select("doc_id", words.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    p = d.select("doc_id", F.size("w").alias("total"), F.posexplode(F.when(F.size("w") > 1, pairs)).alias("pos", "p"))
    p = p.where(meaningful(F.col("p.a"), stop) & meaningful(F.col("p.b"), stop)).groupBy("doc_id", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("freq"), F.min("pos").alias("first"), F.first("total").alias("total"))
    p = p.where("freq >= 3")
    n = content_words(docs, stop).select("doc_id", "word", F.col("freq").alias("n"))
    p = p.join(n.select("doc_id", F.col("word").alias("a"), F.col("n").alias("na")), ["doc_id", "a"]).join(n.select("doc_id", F.col("word").alias("b"), F.col("n").alias("nb")), ["doc_id", "b"])
    p = p.where("freq * 2 >= least(na, nb)").withColumn("score", F.round(keyword_score(F.col("freq"), F.length("a") + F.length("b") + 1, F.col("total"), F.lit(False), F.lit(False)) * 0.9, 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "first"))
    return p.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("doc_id", F.col("a").alias("first_word"), F.col("b").alias("second_word"), "freq", "score", "rank")


def content_tags(docs: DataFrame, stop: list[str]) -> DataFrame:
    """(doc_id, tag, confidence, seq): pairs up to 0.6, then words that are in none of them up to 0.55."""
    pairs = score_bigrams(docs, stop)
    used = pairs.select("doc_id", F.explode(F.array("first_word", "second_word")).alias("word")).distinct()
    tags = pairs.select("doc_id", F.concat_ws("-", "first_word", "second_word").alias("tag"), F.least("score", F.lit(0.6)).alias("confidence"), F.col("rank").alias("seq"))
    words = score_keywords(docs, stop).join(used, ["doc_id", "word"], "left_anti")
    return tags.unionByName(words.select("doc_id", F.col("word").alias("tag"), F.least("score", F.lit(0.55)).alias("confidence"), (F.col("rank") + 2).alias("seq")))


def category_scores(df: DataFrame) -> DataFrame:
    """df (url, title, content, schema_type, keywords) with `scores`, one (category, score) struct per category by priority."""
    # texts in lower case and scores are worked out once, not again for each pattern and in a filter on the result
    kept = df.columns
    df = once(df.select("*", F.struct(*[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("url", "title", "content")]).alias("_text")), "_text")
    text = {c: F.col(f"_text.{c}") for c in ("url", "title", "content")}
    kind, words = F.col("schema_type"), F.coalesce("keywords", F.array().cast("array<string>"))
    scores = []
    for name in PRIORITY:
        p = PATTERNS[name]
        hit = lambda c, patterns: text[c].rlike("|".join(f"(?:{x})" for x in patterns))
        content = sum((F.when(text["content"].rlike(x), 1).otherwise(0) for x in p["content"]), F.lit(0))
        typed = F.coalesce(F.lit(False) if not p["types"] else F.exists(F.array(*[F.lit(t) for t in p["types"]]), lambda t: F.contains(kind, t) | F.contains(t, kind)), F.lit(False)) & (kind != "")
        said = F.exists(words, lambda k: F.lower(k).rlike("|".join(p["words"])))
        score = F.when(hit("url", p["url"]), 0.4).otherwise(0.0) + F.when(hit("title", p["title"]), 0.3).otherwise(0.0) + F.least(F.lit(0.4), content * 0.1) + F.when(F.coalesce(typed, F.lit(False)), 0.5).otherwise(0.0) + F.when(said, 0.1).otherwise(0.0)
        scores.append(F.struct(F.lit(name).alias("category"), F.round(F.least(F.lit(1.0), score), 6).alias("score")))
    return once(df.select(*kept, F.array(*scores).alias("scores")), "scores")


def detect_categories(df: DataFrame) -> DataFrame:
    """(page_id, category, confidence, seq): the best category from 0.3 on, and beside one of 0.6 or more the first other that
    has 0.5 but less than 0.8 of it."""
    d = category_scores(df).select("page_id", "scores", F.array_max(F.transform("scores", lambda s: s.score)).alias("top"))
    d = d.where("top >= 0.3").withColumn("best", F.get(F.filter("scores", lambda s: s.score == F.col("top")), F.lit(0)))
    sure = F.round(F.least(F.lit(0.95), F.when(F.col("top") >= 0.7, F.col("top")).otherwise(F.col("top") * 1.1)), 6)
    second = F.get(F.filter("scores", lambda s: (s.category != F.col("best.category")) & (s.score >= 0.5) & (s.score < F.col("top") * 0.8)), F.lit(0))
    other = F.when((F.col("top") >= 0.6) & second.isNotNull(), F.struct(second.category.alias("category"), F.round(F.least(F.lit(0.6), second.score * 0.8), 6).alias("confidence")))
    both = F.filter(F.array(F.struct(F.col("best.category").alias("category"), sure.alias("confidence")), other), lambda x: x.isNotNull())
    return d.select("page_id", F.posexplode(both).alias("seq", "c")).select("page_id", "c.category", "c.confidence", F.col("seq").cast("long").alias("seq"))


def history_tags(events: DataFrame) -> DataFrame:
    """(tag, confidence, seq): the ten tags used most, the first at 0.4, each further one at 0.02 less, 0.2 at least."""
    rank = F.row_number().over(Window.orderBy(F.desc("uses"), F.desc("last_used"), "tag_key")) - 1  # of ten rows
    return top_tags(events, 10).select("tag", F.round(F.greatest(F.lit(0.2), 0.4 - rank * 0.02), 6).alias("confidence"), rank.cast("long").alias("seq"))


def suggest_tags(strategies: list[DataFrame]) -> DataFrame:
    """(page_id, tag, confidence, rank) from tables (page_id, tag, confidence, seq), strongest strategy first: metadata, domain,
    rule, content, category, history. Of one tag the first strategy's counts, of that the highest confidence."""
    all_ = None
    for i, s in enumerate(strategies):
        s = s.select("page_id", "tag", F.col("confidence").cast("double").alias("confidence"), F.col("seq").cast("long").alias("seq"), F.lit(i).alias("strategy"))
        all_ = s if all_ is None else all_.unionByName(s)
    first = F.struct("strategy", -F.col("confidence"), "seq")
    one = all_.groupBy("page_id", F.lower("tag").alias("key")).agg(F.min_by(F.struct("tag", "confidence"), first).alias("t"), F.min(F.struct("strategy", "seq")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("t.confidence"), "at", "key"))
    return one.select("page_id", "t.tag", "t.confidence", rank.cast("long").alias("rank"))
