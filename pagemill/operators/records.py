"""Records of known sites. A spec is data: what a record's element is, and for each field the first element in the record that
fits a tag or class and what is taken from it. Sites differ by specs only; records are read from the page structure."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import collapsed
from pagemill.operators.html import main_content
from pagemill.operators.metadata import _strings, _variant, jsonld_nodes
from pagemill.operators.notes import duration_words
from pagemill.operators.structure import El, Pick, page_hits


@dataclass(frozen=True)
class Field:
    """The first descendant that is one of the (tag, class) pairs, an empty part fitting any; `take` is text or an attribute.
    `within` is a pair that the element has to lie in."""

    name: str
    where: tuple[tuple[str, str], ...]
    take: str = "text"
    within: tuple[str, str] | None = None


@dataclass(frozen=True)
class Spec:
    """Records are the elements that fit `scope`; with `upto_next` a record reaches to the next one, as where its fields lie in
    the rows that follow."""

    scope: tuple[tuple[str, str], ...]
    fields: tuple[Field, ...]
    upto_next: bool = False
    flags: dict[str, str] = field(default_factory=dict)  # name: class of the record's own element


def extract_records(pages: DataFrame, spec: Spec) -> DataFrame:
    """(page_id, record_no, fields and flags) for every record of every page; a field that isn't found is null. A record within a
    record owns its own fields."""
    fields = [Pick(f.name, El(tag, cls, inside=El(*f.within) if f.within else None), f.take) for f in spec.fields for tag, cls in f.where]
    flags = [Pick(f"flag {name}", El(tag, f"{cls} {flag}".strip()), "none") for name, flag in spec.flags.items() for tag, cls in spec.scope]
    h = page_hits(pages, [*fields, *flags], {str(i): El(tag, cls) for i, (tag, cls) in enumerate(spec.scope)})
    field, pos, page = F.col("field"), F.col("pos"), Window.partitionBy("page_id")
    own = (field == "scope") | field.startswith("flag ")
    if spec.upto_next:
        before = F.last(F.when(field == "scope", pos), ignorenulls=True).over(page.orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        h = h.withColumn("record", before).where(own | (pos > F.col("record")))
    else:
        h = h.withColumn("record", F.when(own, pos).otherwise(F.col("scope"))).where(own | (F.col("scope") >= 0))
    value = lambda f: F.col("value") if f.take == "text" else F.nullif("value", F.lit(""))
    first = [value(f) for f in spec.fields]
    kept = [F.min_by(F.when(field == f.name, v), F.when(field == f.name, pos)).alias(f.name) for f, v in zip(spec.fields, first)]
    held = [(F.count_if(field == f"flag {name}") > 0).alias(name) for name in spec.flags]
    d = h.groupBy("page_id", "record").agg(*held, *kept)
    return d.select("page_id", F.row_number().over(page.orderBy("record")).cast("long").alias("record_no"), *spec.flags, *[f.name for f in spec.fields])


# Where sites keep the fields of their records.
STORIES = Spec((("", "athing"),), (Field("rank", (("", "rank"),)), Field("title", (("a", ""),), within=("", "titleline")), Field("url", (("a", ""),), "href", ("", "titleline")), Field("subtext", (("", "subtext"),)), Field("author", (("", "hnuser"),))), upto_next=True)
ANSWERS = Spec((("div", "answer"),), (Field("author", (("a", ""),), within=("", "user-details")), Field("body", (("", "s-prose"),)), Field("votes_value", (("", "js-vote-count"),), "data-value"), Field("votes_text", (("", "js-vote-count"),)), Field("date", (("time", ""),), "datetime")), flags={"accepted": "accepted-answer"})
COMMENTS = Spec((("", "comtr"),), (Field("author", (("", "hnuser"),)), Field("body", (("", "commtext"),)), Field("indent", (("img", ""),), "width")))


def story_listing(pages: DataFrame) -> DataFrame:
    """(page_id, rank, title, url, points, author, comments) of listings; the rank on the page, else the running number."""
    d = extract_records(pages, STORIES).where("title <> ''")
    count = lambda word: F.regexp_extract(F.coalesce("subtext", F.lit("")), rf"(?i)(\d+)\s*{word}s?", 1).try_cast("long")
    rank = F.coalesce(F.replace(F.col("rank"), F.lit("."), F.lit("")).try_cast("long"), F.col("record_no"))
    return d.select("page_id", rank.alias("rank"), "title", F.coalesce("url", F.lit("")).alias("url"), count("point").alias("points"), F.coalesce("author", F.lit("")).alias("author"), count("comment").alias("comments"))


def answers(pages: DataFrame) -> DataFrame:
    """(question_id, pos, accepted, votes, author, body, date) of question pages, as top_answers takes them."""
    d = extract_records(pages, ANSWERS)
    votes = F.coalesce(F.col("votes_value").try_cast("long"), F.regexp_extract(F.coalesce("votes_text", F.lit("")), r"^\s*(-?\d+)", 1).try_cast("long"), F.lit(0))
    return d.select(F.col("page_id").alias("question_id"), F.col("record_no").alias("pos"), "accepted", votes.alias("votes"), "author", "body", "date")


def story_comments(pages: DataFrame) -> DataFrame:
    """(page_id, pos, author, body, indent) of story pages, as top_comments takes them."""
    d = extract_records(pages, COMMENTS)
    return d.select("page_id", F.col("record_no").alias("pos"), "author", "body", F.col("indent").try_cast("long").alias("indent"))


def recipes(pages: DataFrame) -> DataFrame:
    """One row per page with a Recipe among its JSON-LD, the first one: name, ingredients, steps from strings, steps or sections
    of them, times in words, servings, rating."""
    d = jsonld_nodes(pages).where(F.expr(f"array_contains(transform({_strings(_variant('@type'), 'none')}, t -> regexp_replace(t, '(?i)^(https?://(www.)?schema.org/|schema:)', '')), 'Recipe')"))
    text = lambda key: F.expr(f"try_variant_get(node, '$.{key}', 'string')")
    # sections hold lists of steps; they are opened into one list of variants first
    steps = F.expr("flatten(transform(coalesce(try_variant_get(node, '$.recipeInstructions', 'array<variant>'), array(try_variant_get(node, '$.recipeInstructions', 'variant'))), s -> coalesce(try_variant_get(s, '$.itemListElement', 'array<variant>'), array(s))))")
    d = d.withColumn("steps", steps)
    plain = F.expr("filter(transform(steps, s -> trim(case when schema_of_variant(s) = 'STRING' then try_variant_get(s, '$', 'string') else coalesce(try_variant_get(s, '$.text', 'string'), try_variant_get(s, '$.name', 'string')) end)), s -> s <> '')")
    kept = {
        "name": collapsed(text("name")), "ingredients": F.expr(_strings(_variant("recipeIngredient", "ingredients"), "none")), "steps": plain,
        "prep": duration_words(text("prepTime")), "cook": duration_words(text("cookTime")), "total": duration_words(text("totalTime")), "servings": F.expr(f"get({_strings(_variant('recipeYield'), 'none')}, 0)"),
        "rating": F.expr("try_variant_get(node, '$.aggregateRating.ratingValue', 'double')"), "calories": F.expr("try_variant_get(node, '$.nutrition.calories', 'string')"),
    }
    return d.groupBy("page_id").agg(F.min_by(F.struct(*[c.alias(n) for n, c in kept.items()]), "seq").alias("r")).select("page_id", "r.*")



def apply_template(pages: DataFrame, matches: DataFrame, specs: dict[str, Spec]) -> DataFrame:
    """(page_id, name, content, title, author, date): the fields that the spec of a page's template (page_id, name) finds on it;
    where it finds no content, the main text of the page."""
    out = None
    columns = ["content", "title", "author", "date"]
    for name, spec in specs.items():
        of = pages.join(matches.where(F.col("name") == name).select("page_id"), "page_id", "left_semi")
        d = extract_records(of, spec).where("record_no = 1")
        d = d.select("page_id", F.lit(name).alias("name"), *[F.nullif(F.col(c), F.lit("")).alias(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in columns])
        out = d if out is None else out.unionByName(d)
    matched = pages.join(matches.where(F.col("name").isin(list(specs))).select("page_id"), "page_id", "left_semi")
    return out.join(main_content(matched), "page_id", "left").withColumn("content", F.coalesce("content", "text")).drop("text")


def listed(d: DataFrame, key: str, order: str, line: Column, by: str = "\n") -> DataFrame:
    """(key, body): the lines of each key in order."""
    parts = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return d.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p.line), by).alias("body"))


def render_stories(stories: DataFrame) -> DataFrame:
    """(page_id, body): a numbered list of links, with points, author and comments where they are known."""
    tail = F.concat_ws(", ", F.concat("points", F.lit(" points")), F.concat(F.lit("by "), F.nullif("author", F.lit(""))), F.concat("comments", F.lit(" comments")))
    line = F.concat(F.col("rank"), F.lit(". ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"), F.when(tail != "", F.concat(F.lit(" ("), tail, F.lit(")"))).otherwise(""))
    return listed(stories, "page_id", "rank", line)


def render_answers(answers_: DataFrame) -> DataFrame:
    """(question_id, body): answers by rank, accepted ones marked."""
    head = F.concat(F.lit("## Answer "), F.col("rank"), F.when(F.col("accepted"), " ✓ accepted").otherwise(""), F.lit("\n\n**"), F.col("author"), F.lit("**, "), F.col("votes"), F.lit(" votes\n\n"), F.col("body"))
    return listed(answers_, "question_id", "rank", head, "\n\n---\n\n")


def render_recipe(recipes_: DataFrame) -> DataFrame:
    """(page_id, body): times and servings, ingredients, numbered steps."""
    facts = F.concat_ws("\n", *[F.concat(F.lit(f"**{n.title()}:** "), F.col(n)) for n in ("prep", "cook", "total", "servings")])
    steps = F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    items = F.transform("ingredients", lambda s: F.concat(F.lit("- "), s))
    body = F.concat_ws("\n\n", F.nullif(facts, F.lit("")), F.when(F.size("ingredients") > 0, F.concat(F.lit("## Ingredients\n\n"), F.array_join(items, "\n"))), F.when(F.size("steps") > 0, F.concat(F.lit("## Instructions\n\n"), F.array_join(steps, "\n"))))
    return recipes_.select("page_id", body.alias("body"))
