"""Page structure: element spans, main content, text, Markdown, tables and code, as joins and windows by page.

Tokens of a page carry their place `pos`; an element is the span of places from its opening to its closing token. All
windows are over a page, or a page and a tag. Markdown is made within the row of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import attribute, collapsed, decoded, let, raw_attribute
from pagemill.operators.pages import BLOCKS, page_tokens
from pagemill.operators.structure import around, dealt, holders, innermost, is_void, laid_out, marked, once, page_structure, shown, sql_value, text_in, with_ends, written

# Selectors of the main content in their order, and what is taken out of it, as (kind, value).
CONTENT = [("tag", "article"), ("role", "main"), ("tag", "main"), ("class", "post-content"), ("class", "article-content"), ("class", "entry-content"), ("class", "content")]
REMOVED = [
    ("tag", "script"), ("tag", "style"), ("tag", "nav"), ("tag", "header"), ("tag", "footer"), ("tag", "aside"), ("class", "sidebar"), ("class", "comments"),
    ("class", "advertisement"), ("class", "ads"), ("class", "ad"), ("role", "navigation"), ("role", "banner"),
]
# Phrases of pages behind a paywall.
PAYWALL = ["subscribe", "subscription", "premium", "paywall", "limited access", "create an account", "sign in to continue", "free trial", "upgrade to read", "member exclusive", "premium content"]
# Short names of languages.
LANGUAGE_NAMES = {"js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "sh": "bash", "shell": "bash", "zsh": "bash", "yml": "yaml", "md": "markdown", "cs": "csharp", "c++": "cpp", "rs": "rust", "kt": "kotlin"}
KNOWN_LANGUAGES = "javascript typescript python ruby bash yaml markdown csharp cpp rust kotlin java go php html css json sql swift scala xml text".split()


def page_intervals(tokens: DataFrame) -> DataFrame:
    """(page_id, tag, open_pos, close_pos, id, classes, role, tok) for every element, ending as with_ends() says."""
    last = F.max("pos").over(Window.partitionBy("page_id"))
    tok = F.col("tok")
    return with_ends(tokens.withColumn("void", is_void())).withColumn("close", F.least(F.col("close"), last)).where("kind = 'open'").select(
        "page_id", "tag", F.col("pos").alias("open_pos"), F.col("close").alias("close_pos"),
        F.coalesce(raw_attribute(tok, "id"), F.lit("")).alias("id"), F.split(collapsed(F.coalesce(raw_attribute(tok, "class"), F.lit(""))), " ").alias("classes"), F.coalesce(F.lower(raw_attribute(tok, "role")), F.lit("")).alias("role"), "tok",
    )


def is_one_of(rules: list[tuple[str, str]]) -> Column:
    """Whether an interval is one of the (kind, value) selectors."""
    out = F.lit(False)
    for kind, value in rules:
        out = out | {"tag": F.col("tag") == value, "role": F.col("role") == value, "class": F.array_contains("classes", value), "id": F.col("id") == value}[kind]
    return out


def main_spans(intervals: DataFrame, content=CONTENT) -> DataFrame:
    """(page_id, open_pos, close_pos, selector): of each page the first element of the first selector that has one, else
    the body."""
    rank = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate([*content, ("tag", "body")]))):
        rank = F.when(is_one_of([rule]), F.lit(i)).otherwise(rank)
    found = intervals.withColumn("rank", rank).where("rank is not null")
    first = found.groupBy("page_id").agg(F.min_by(F.struct("open_pos", "close_pos", "rank"), F.struct("rank", "open_pos")).alias("s"))
    names = F.array(*[F.lit(f"{k}:{v}") for k, v in [*content, ("tag", "body")]])
    return first.select("page_id", "s.open_pos", "s.close_pos", F.get(names, F.col("s.rank")).alias("selector"))


def inside(tokens: DataFrame, intervals: DataFrame, name: str) -> DataFrame:
    """tokens with column `name`: how many of the intervals a token is in. Openings and ends are joined by place and
    summed up over the page, so no token meets an interval that doesn't begin or end there."""
    marks = intervals.select("page_id", F.explode(F.array(F.struct(F.col("open_pos").alias("pos"), F.lit(1).alias("step")), F.struct((F.col("close_pos") + 1).alias("pos"), F.lit(-1).alias("step")))).alias("m"))
    marks = marks.groupBy("page_id", "m.pos").agg(F.sum("m.step").alias("_step"))
    over = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = tokens.join(marks, ["page_id", "pos"], "left")
    return out.withColumn(name, F.sum(F.coalesce("_step", F.lit(0))).over(over)).drop("_step")


def main_tokens(tokens: DataFrame, intervals: DataFrame, content=CONTENT, removed=REMOVED) -> DataFrame:
    """Tokens of each page's main content, without what is removed from it."""
    spans = main_spans(intervals, content)
    out = inside(inside(tokens, spans, "_main"), intervals.where(is_one_of(removed)), "_out")
    return out.where("_main > 0 and _out = 0 and kind not in ('comment', 'raw', 'other')").drop("_main", "_out")


def text_of(tokens: DataFrame, *keys: str) -> DataFrame:
    """(page_id, keys, text): the text of the tokens, block elements set apart by a space, decoded and collapsed."""
    piece = F.when(F.col("kind") == "text", F.col("tok")).when(F.col("tag").isin(BLOCKS), F.lit(" ")).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"))))
    return tokens.groupBy("page_id", *keys).agg(F.array_join(F.transform(parts, lambda p: p.piece), "").alias("_t")).select("page_id", *keys, collapsed(decoded(F.col("_t"))).alias("text"))


def selector_sql(rules: list[tuple[str, str]], e: str = "", classes: str = "classes") -> str:
    """SQL: whether an element, whose parts are named from `e` on, is one of the (kind, value) selectors."""
    one = {"tag": f"{e}tag = '{{}}'", "role": f"{e}role = '{{}}'", "class": f"array_contains({e}{classes}, '{{}}')", "id": f"{e}id = '{{}}'"}
    return " OR ".join(f"({one[kind].format(value)})" for kind, value in rules)


def first_ranked(rules: list[tuple[str, str]]) -> Column:
    """Of the structure's elements the first one of the first selector that has one; null where there is none."""
    cases = " ".join(f"WHEN {selector_sql([rule], 'e.')} THEN {i}" for i, rule in enumerate(rules))
    return F.expr(f"array_min(filter(transform(elements, e -> named_struct('rank', CASE {cases} END, 'pos', e.pos, 'e', e)), x -> x.rank IS NOT NULL)).e")


def main_content(pages: DataFrame, content=CONTENT, removed=REMOVED) -> DataFrame:
    """(page_id, text): text of the main content of every page, without what is removed from it; empty where there is none."""
    return main_text_of(page_structure(pages, selector_sql(removed, classes="split(class, '\\\\s+')")), content)


def main_text_of(s: DataFrame, content=CONTENT, *kept: str) -> DataFrame:
    """(page_id, kept, text) out of a structure without what is removed."""
    s = once(s.withColumn("e", first_ranked([*content, ("tag", "body")])), "e")
    return once(s.select("page_id", *kept, F.coalesce(shown(text_in(F.col("e"))), F.lit("")).alias("text")), "text")


def parents(elements: DataFrame, holders: DataFrame) -> DataFrame:
    """(page_id, open_pos, parent_pos): the innermost holder around each element. Elements and holders are put in page order, so none
    meets another."""
    e = F.struct(F.col("open_pos").alias("pos"), F.coalesce("close_pos", "open_pos").alias("close")).alias("e")
    asked = elements.select("page_id", F.struct(F.col("open_pos").alias("pos"), F.col("open_pos").alias("close")).alias("e"), F.lit(False).alias("holds"))
    d = marked(asked.unionByName(holders.select("page_id", e, F.lit(True).alias("holds"))), {"parent_pos": "holds"})
    return d.where("not holds and parent_pos is not null").select("page_id", F.col("e.pos").alias("open_pos"), "parent_pos")


def code_language(classes: Column, code: Column) -> Column:
    """A language from a class, else from what the code looks like; empty where neither tells."""
    named = F.get(F.filter(F.transform(classes, lambda c: F.lower(F.regexp_extract(c, r"(?i)^(?:language|lang|highlight)-(.+)$", 1))), lambda c: c != ""), F.lit(0))
    bare = F.get(F.filter(F.transform(classes, F.lower), lambda c: c.isin([*KNOWN_LANGUAGES, *LANGUAGE_NAMES])), F.lit(0))
    name = F.coalesce(named, bare)
    long = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    name = F.coalesce(F.element_at(long, name), name)
    c = F.trim(code)
    guess = (
        F.when(c.rlike(r'(?s)^[\[{].*"[^"]*"\s*:.*[\]}]$'), "json").when(c.rlike(r"(?i)^<(!doctype|html|\?xml|[a-z]+[\s>])"), "html").when(c.rlike(r"(?s)^[.#]?[\w-]+\s*\{[^}]*:[^}]*;"), "css")
        .when(c.rlike(r"^(#!/bin/(ba)?sh|\$ |(sudo|apt|npm|pip|git|cd|echo|curl) )"), "bash").when(c.rlike(r"(?m)^(def \w+\(.*\):|import \w+$|from \w+ import|class \w+.*:$)"), "python")
        .when(c.rlike(r"(?i)^(select|insert|update|delete|create)\s"), "sql").when(c.rlike(r"(?m)^[\w-]+:\s*\S*$") & ~c.rlike("[;{}]"), "yaml").when(c.rlike(r"(?m)^package \w+|^func \w+\("), "go")
        .when(c.rlike(r"\bfn \w+\(|\blet mut "), "rust").when(c.rlike(r"\b(const|let|var|function)\b|=>"), "javascript").when(c.rlike(r"\bpublic (static |class )"), "java").otherwise("")
    )
    return F.coalesce(name, guess)


def code_of(elements: Column) -> Column:
    """(classes, code) of every pre of a page's elements; classes of the first code element in it stand before its own."""
    pre = F.filter(elements, lambda e: e["tag"] == "pre")
    inner = lambda p: F.get(F.filter(elements, lambda e: (e["tag"] == "code") & e["pos"].between(p["pos"], p["close"])), F.lit(0))["classes"]
    return F.transform(pre, lambda p: F.struct(F.concat(F.coalesce(inner(p), F.array().cast("array<string>")), p["classes"]).alias("classes"), F.regexp_replace(written(text_in(p)), r"^\n+|\s+$", "").alias("code")))


def code_fence(code: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(code, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def code_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, language, code, fence): every pre, with a fence longer than any run of backticks in it. The language is
    that of the first code element in it, else of the pre."""
    d = page_structure(pages).select("page_id", F.posexplode(code_of(F.col("elements"))).alias("n", "p")).select("page_id", (F.col("n") + 1).cast("long").alias("block_no"), "p.classes", "p.code")
    return d.select("page_id", "block_no", code_language(F.col("classes"), F.col("code")).alias("language"), "code", code_fence(F.col("code")).alias("fence"))


def table_cells(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, col_no, text, plain, table_pos): cells of all tables. A table with spans, or one that holds or is
    in another, isn't plain."""
    e = F.transform("elements", lambda e: F.struct(e.alias("e"), F.when(e["tag"].isin("td", "th"), shown(text_in(e))).alias("text")))
    d = page_structure(pages, tags=("table", "tr", "td", "th")).select("page_id", F.explode(e).alias("x")).select("page_id", "x.e", "x.text")
    d = marked(d, {"table_pos": "e.tag = 'table'", "row_pos": "e.tag = 'tr'"})
    tag, of = F.col("e.tag"), Window.partitionBy("page_id", "table_pos")
    # a table within another, and the one that it is in; both see a row of it
    d = d.withColumn("own", F.when(tag == "table", F.col("e.pos")).otherwise(F.col("table_pos"))).withColumn("bad", F.when(tag == "table", F.col("table_pos").isNotNull()).otherwise(tag.isin("td", "th") & (F.array_contains("e.names", "colspan") | F.array_contains("e.names", "rowspan"))))
    d = d.withColumn("bad", F.max("bad").over(Window.partitionBy("page_id", "own")) | F.coalesce(F.max(F.when(tag == "table", True)).over(of), F.lit(False)))
    cells = d.where(tag.isin("td", "th") & F.col("table_pos").isNotNull() & F.col("row_pos").isNotNull() & (F.col("row_pos") > F.col("table_pos")))
    return cells.select(
        "page_id", F.dense_rank().over(Window.partitionBy("page_id").orderBy("table_pos")).cast("long").alias("table_no"), F.dense_rank().over(of.orderBy("row_pos")).cast("long").alias("row_no"),
        F.row_number().over(Window.partitionBy("page_id", "table_pos", "row_pos").orderBy("e.pos")).cast("long").alias("col_no"), F.coalesce("text", F.lit("")).alias("text"), (~F.max("bad").over(of)).alias("plain"), "table_pos",
    )


def gfm_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, markdown): plain tables with pipes, the first row as head."""
    cell = F.replace(F.col("text"), F.lit("|"), F.lit("\\|"))
    cells = F.array_sort(F.collect_list(F.struct("col_no", cell.alias("c"))))
    rows = table_cells(pages).where("plain").groupBy("page_id", "table_no", "row_no").agg(F.transform(cells, lambda x: x.c).alias("cells"))
    line = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
    head = F.concat(F.lit("\n| "), F.array_join(F.transform("cells", lambda _: F.lit("---")), " | "), F.lit(" |"))
    line = F.when(F.col("row_no") == 1, F.concat(line, head)).otherwise(line)
    lines = F.array_sort(F.collect_list(F.struct("row_no", line.alias("l"))))
    return rows.groupBy("page_id", "table_no").agg(F.array_join(F.transform(lines, lambda x: x.l), "\n").alias("markdown"))


def html_tables() -> str:
    """SQL: places of the tables that aren't plain, as table_cells() has them, out of the cells _x of a page."""
    cell = "x.tag IN ('td', 'th')"
    nested = "transform(filter(_x, x -> x.tag = 'table' AND x.of IS NOT NULL), x -> array(x.of, x.pos))"
    spans = f"transform(filter(_x, x -> {cell} AND x.spans), x -> array(x.of))"
    return f"array_intersect(flatten(concat({nested}, {spans})), transform(filter(_x, x -> {cell} AND x.row > x.of), x -> x.of))"


def page_markdown(pages: DataFrame, tables: str = "gfm") -> DataFrame:
    """(page_id, markdown): the main content with headings, bold, emphasis, code, links, images, lists, quotes, fenced code
    and tables. Every token becomes a marker or its text; the ordered pieces are joined, then tidied up. Code is put in after
    that, as code_blocks() has it, so that no white space in it is touched. Tables that aren't plain stay HTML; `tables` may
    also be `html`, all of them stay, or `remove`. All of it is within a page's row."""
    s = page_structure(pages, with_tokens=True).withColumn("_main", first_ranked([*CONTENT, ("tag", "body")]))
    s = once(s.withColumnRenamed("elements", "_e"), "_main").where("_main IS NOT NULL")
    sets = {"_pre": "e.tag = 'pre'", "_quote": "e.tag = 'blockquote'", "_cell": "e.tag IN ('td', 'th')", "_out": selector_sql(REMOVED, "e."), "_list": "e.tag IN ('ol', 'ul')", "_item": "e.tag = 'li'", "_row": "e.tag = 'tr'", "_table": "e.tag = 'table'"}
    s = once(s.selectExpr("*", *[f"{holders(c)} AS {n}" for n, c in sets.items()]), *sets)
    table = f"filter(transform(filter(_e, e -> e.tag IN ('table', 'tr', 'td', 'th')), e -> named_struct('tag', e.tag, 'pos', e.pos, 'close', e.close, 'of', {innermost('_table')}, 'row', {innermost('_row')}, 'spans', array_contains(e.names, 'colspan') OR array_contains(e.names, 'rowspan'))), x -> x.of IS NOT NULL OR x.row IS NOT NULL OR x.tag = 'table')"
    item = f"transform(filter(_e, e -> e.tag = 'li'), e -> named_struct('pos', e.pos, 'of', {innermost('_list')}, 'level', greatest(size({around('_list', 'e.pos')}), 0)))"
    s = once(s.selectExpr("*", f"{table} AS _x", f"{item} AS _li"), "_x", "_li")
    # items of each list in order; of each table the first row, and how many cells it has
    ordered = "filter(_e, e -> e.tag IN ('ol', 'ul'))"
    numbered = f"flatten(transform({ordered}, l -> transform(filter(_li, x -> x.of = l.pos), (x, i) -> named_struct('pos', x.pos, 'level', x.level, 'n', CASE WHEN l.tag = 'ol' THEN i + 1 END))))"
    heads = "transform(filter(_e, e -> e.tag = 'table'), t -> get(filter(_x, x -> x.tag = 'tr' AND x.of = t.pos), 0))"
    heads = f"filter(transform(array_compact({heads}), r -> named_struct('pos', r.close, 'width', size(filter(_x, c -> c.tag IN ('td', 'th') AND c.row = r.pos)))), r -> r.width > 0)"
    kept = {"gfm": f"e.tag = 'table' AND array_contains({html_tables()}, e.pos)"}.get(tables, "e.tag = 'table'")
    s = once(s.selectExpr("*", f"{numbered} AS _numbers", f"{heads} AS _heads", f"{holders(kept)} AS _html", f"transform(filter(_e, e -> e.tag = 'pre'), e -> e.pos) AS _pres"), "_numbers", "_heads", "_html", "_pres")
    # one entry for each place: what an element's own opening and end need to know beside their tokens
    entry = lambda where, place, **has: f"transform({where}, x -> named_struct('pos', {place}, " + ", ".join(f"'{n}', {has.get(n, f'cast(NULL AS {t})')}" for n, t in (("level", "int"), ("n", "int"), ("href", "string"), ("nested", "boolean"), ("width", "int"))) + "))"
    lists = f"filter(transform({ordered}, e -> named_struct('pos', e.pos, 'close', e.close, 'in', {innermost('_item')})), x -> x.in IS NOT NULL)"
    anchors = "filter(_e, e -> e.tag = 'a')"
    facts = f"concat({entry('_numbers', 'x.pos', level='x.level', n='x.n')}, {entry(lists, 'x.pos', nested='true')}, {entry(lists, 'x.close', nested='true')}, {entry('_heads', 'x.pos', width='x.width')}, {entry(anchors, 'x.close', href=sql_value('href', 'x'))})"
    place = "named_struct('at', cast(p AS int), 'tok', get(toks, cast(p AS int)), 'pre', size({0}), 'quote', size({1}), 'cell', size({2}), 'out', size({3}), 'html', size({4}))".format(*[around(n, "p") for n in ("_pre", "_quote", "_cell", "_out", "_html")])
    dropped = " AND x.html = 0" if tables == "remove" else ""
    s = once(s.selectExpr("page_id", "text", "_e", "_pres", f"filter(transform(sequence(_main.pos, _main.close), p -> {place}), x -> x.out = 0{dropped}) AS _t", f"{facts} AS _facts"), "_t", "_facts")
    # facts and tokens meet in page order: a token takes those that stand at its place
    nothing = "cast(NULL AS struct<pos:int,level:int,n:int,href:string,nested:boolean,width:int>)"
    both = f"array_sort(concat(transform(_facts, f -> named_struct('at', f.pos, 'k', 0, 'f', f, 'i', -1)), transform(_t, (x, i) -> named_struct('at', x.at, 'k', 1, 'f', {nothing}, 'i', i))))"
    s = once(s.selectExpr("page_id", "text", "_e", "_pres", "_t", f"{both} AS _b"), "_b")
    s = once(s.selectExpr("page_id", "text", "_e", "_pres", "_t", "_b", "filter(transform(_b, (x, j) -> named_struct('i', x.i, 'facts', filter(array(get(_b, j - 1), get(_b, j - 2), get(_b, j - 3)), y -> y.at = x.at AND y.k = 0).f)), x -> x.i >= 0) AS _f"), "_f")

    def marker(x: Column, f: Column) -> Column:
        tok = x["tok"]
        opens, tag = ~tok.startswith("</"), F.lower(F.regexp_extract(tok, r"^</?([A-Za-z][A-Za-z0-9-]*)", 1))
        fact = lambda name: F.get(F.array_compact(F.transform(f["facts"], lambda y: y[name])), F.lit(0))
        word = lambda name: attribute(tok, name)

        def made(tag: Column) -> Column:
            bullet = F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.coalesce(fact("level") - 1, F.lit(0))), F.when(fact("n").isNotNull(), F.concat(fact("n").cast("string"), F.lit(". "))).otherwise("- "))
            number = F.array_position("_pres", x["at"]).cast("string")
            m = (
                F.when((x["html"] == 1) & (tag == "table"), F.when(opens, F.concat(F.lit("\n\n"), tok)).otherwise(F.concat(tok, F.lit("\n\n")))).when(x["html"] > 0, tok)
                .when((tag == "pre") & opens & (x["pre"] == 1), F.concat(F.lit("\n\n\x02"), number, F.when(x["quote"] > 0, "q").otherwise(""), F.lit("\x02\n\n"))).when(x["pre"] > 0, "")
                .when(~tok.startswith("<"), decoded(F.regexp_replace(tok, r"[\x20\x09-\x0D]+", " ")))
                .when(tag.rlike("^h[1-6]$"), F.when(opens, F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" "))).otherwise("\n\n"))
                .when(tag.isin("p", "div", "section", "article", "main", "figure", "table", "ul", "ol", "blockquote"), F.when(fact("nested"), "").otherwise("\n\n"))
                .when(tag.isin("strong", "b"), "**").when(tag.isin("em", "i"), "*").when(tag == "br", "\n").when(tag == "hr", "\n\n---\n\n")
                .when(tag == "code", "`")
                .when(tag == "li", F.when(opens, bullet).otherwise(""))
                .when(tag == "a", F.when(opens, "[").otherwise(F.concat(F.lit("]("), F.coalesce(decoded(fact("href")), F.lit("")), F.lit(")"))))
                .when(tag == "img", F.concat(F.lit("!["), word("alt"), F.lit("]("), word("src"), F.lit(")")))
                .when(tag == "tr", F.when(opens, "\n|").otherwise(F.when(fact("width").isNotNull(), F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), fact("width")))).otherwise("")))
                .when(tag.isin("td", "th"), F.when(opens, " ").otherwise(" |"))
                .otherwise("")
            )
            m = F.when((x["cell"] > 0) & (x["html"] == 0) & ~tok.startswith("<"), F.replace(m, F.lit("|"), F.lit("\\|"))).otherwise(m)
            return let(m, lambda v: F.when((x["quote"] > 0) & (tag != "blockquote"), F.replace(v, F.lit("\n"), F.lit("\n> "))).otherwise(v))

        # comments, scripts and what isn't a tag say nothing
        silent = tok.startswith("<") & (tok.startswith("<!--") | tag.isin("script", "style") | (~tok.startswith("</") & (tag == "")))
        return F.when(silent, "").otherwise(let(tag, made))

    md = F.array_join(F.zip_with("_t", "_f", marker), "")
    md = F.regexp_replace(F.regexp_replace(md, r"(?m)[ \t]+$", ""), r"(\n>)+(?=\n[^>]|$)", "")
    md = F.regexp_replace(F.regexp_replace(md, r"\n{2,}(?:>\n)+(?=> )", "\n\n"), r"(?:\n>)+(?=\n> )", "\n>")
    md = F.regexp_replace(md, r"\n{3,}", "\n\n")
    md = F.trim(F.regexp_replace(F.regexp_replace(md, r"(?m)^ (?=\S)", ""), r"^\s+|\s+$", ""))
    d = once(s.select("page_id", md.alias("md"), code_of(F.col("_e")).alias("blocks")), "md", "blocks")
    fenced = F.transform("blocks", lambda p: F.concat(code_fence(p["code"]), code_language(p["classes"], p["code"]), F.lit("\n"), p["code"], F.lit("\n"), code_fence(p["code"])))
    d = once(d.select("page_id", "md", fenced.alias("blocks")), "blocks")
    block = lambda s: F.get("blocks", F.replace(s, F.lit("q"), F.lit("")).try_cast("int") - 1)
    segments = F.transform(F.split("md", "\x02"), lambda s, i: F.when(i % 2 == 0, s).when(s.endswith("q"), F.replace(block(s), F.lit("\n"), F.lit("\n> "))).otherwise(block(s)))
    out = d.select("page_id", F.array_join(segments, "").alias("markdown"))
    return pages.select("page_id").join(out, "page_id", "left").select("page_id", F.coalesce("markdown", F.lit("")).alias("markdown"))


def body_text(pages: DataFrame) -> DataFrame:
    """(page_id, body): the text of each page's body, without scripts and styles; empty where there is none."""
    s = page_structure(pages, tags=("body",)).withColumn("e", first_ranked([("tag", "body")]))
    return s.select("page_id", F.coalesce(shown(text_in(F.col("e"))), F.lit("")).alias("body"))


def paywall_flags(pages: DataFrame) -> DataFrame:
    """(page_id, signs, paywalled): no main text; or under 500 characters of it and two phrases in the body; or under a tenth
    of a body of more than 2,000."""
    # both texts are made in the page's row
    s = laid_out(dealt(pages), kept=("html",), tags=("body",)).withColumn("e", first_ranked([("tag", "body")]))
    s = once(s.select("page_id", "html", F.coalesce(shown(text_in(F.col("e"))), F.lit("")).alias("body")), "body")
    d = main_text_of(laid_out(s, selector_sql(REMOVED, classes="split(class, '\\\\s+')"), kept=("body",)), CONTENT, "body")
    signs = sum((F.when(F.contains(F.lower("body"), F.lit(p)), 1).otherwise(0) for p in PAYWALL), F.lit(0))
    n, whole = F.length("text"), F.length("body")
    flag = (n == 0) | ((n < 500) & (F.col("signs") >= 2)) | ((whole > 2000) & (n < whole * 0.1))
    return d.withColumn("signs", signs.cast("long")).select("page_id", "signs", flag.alias("paywalled"))


def visible_content(pages: DataFrame, least: int = 50) -> DataFrame:
    """(page_id, text): all paragraphs of more than `least` characters of each page that has one, by blank lines."""
    texts = F.filter(F.transform(F.filter("elements", lambda e: e["tag"] == "p"), lambda e: shown(text_in(e))), lambda t: F.length(t) > least)
    d = once(page_structure(pages, tags=("p",)).select("page_id", texts.alias("t")), "t").where(F.size("t") > 0)
    return d.select("page_id", F.array_join("t", "\n\n").alias("text"))
