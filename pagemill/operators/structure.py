"""Page structure in one pass: every element with its parent, its place among its siblings and where its text lies.

A page is one row: its text, and an array of its elements in page order. Pages are dealt once, by page_id; everything else happens
within a page's row, whose tags a function in Python walks once, so a task needs memory for some pages. (A walk by aggregate() copies
its whole state with each tag.)
Consumers open up the elements that they want, with their texts, and mark them with what they lie in; that keeps the rows
where they are, so a query over one table has one scan and one exchange.

Pages without html have an empty text and no elements. Page ids are taken to be unique."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.elements import BREAK, Hits, Walk
from pagemill.functions.text import collapsed, decoded, let
from pagemill.operators.pages import TOKEN, VOID

EDGES = r"""^["']|["']$"""  # quotes of a value
LEAST_PARTS = 64  # of a page table that is opened up
WALKED = "text binary, elements array<struct<pos:int,close:int,up:int,parent:int,depth:int,nth:int,tag:string,id:string,classes:array<string>,role:string,names:array<string>,values:array<string>,start:int,size:int>>"
HITS = "array<struct<scope:int,pos:int,close:int,parent:int,field:string,rank:int,take:string,raw:string>>"


def is_void() -> Column:
    return (F.col("kind") == "open") & (F.col("tag").isin(VOID) | F.col("tok").rlike(r"/>$") & F.col("tag").isin("path", "use", "rect", "circle"))


def with_ends(tokens: DataFrame) -> DataFrame:
    """tokens, which have `void`, with, for openings, `close`: the place of the token that an element ends with. The n-th opening and the n-th
    closing token of a tag at one depth are a pair. An element that isn't closed ends before the next one of its tag, or with
    the innermost closed one around it, whichever is first, else with the page (then close is beyond it); void elements are
    one token long. Windows within a page only."""
    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    # the depth within a tag is told from the end of the page too, so that one order of tokens gives it and the next opening
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    later = Window.partitionBy("page_id", "tag").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    dep = F.sum(step).over(Window.partitionBy("page_id", "tag")) - F.coalesce(F.sum(step).over(later), F.lit(0))
    t = tokens.withColumn("d", dep).withColumn("next_open", F.last(F.when(opens, F.col("pos")), ignorenulls=True).over(later))
    t = t.withColumn("d", F.when(opens, F.col("d")).when(closes, F.col("d") + 1))
    by_depth = Window.partitionBy("page_id", "tag", "d").orderBy("pos")
    t = t.withColumn("next_kind", F.lead("kind").over(by_depth)).withColumn("next_pos", F.lead("pos").over(by_depth)).withColumn("prev_kind", F.lag("kind").over(by_depth))
    t = t.withColumn("pair", F.when(F.col("void"), F.col("pos")).when(opens & (F.col("next_kind") == "close"), F.col("next_pos")))
    closed = opens & ~F.col("void") & F.col("pair").isNotNull()
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("level", F.sum(F.when(closed, 1).when(closes & (F.col("prev_kind") == "open"), -1).otherwise(0)).over(page))
    at_level = Window.partitionBy("page_id", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("around", F.last(F.when(closed, F.col("pair")), ignorenulls=True).over(at_level))
    loose = F.least(F.col("next_open") - 1, F.when(F.col("level") > 0, F.col("around") - 1), F.lit(1 << 30))
    t = t.withColumn("close", F.when(opens, F.greatest(F.coalesce("pair", loose), F.col("pos"))).cast("int"))
    return t.select(*tokens.columns, "close")


def by_page(pages: DataFrame, key: str = "page_id", least: int = LEAST_PARTS) -> DataFrame:
    """pages dealt by their key, in one part more than shuffles have, `least` at least. Parts aren't put together again: a page's rows
    take far more room in memory than its html does in the shuffle. (With the number of the shuffle that pages come from it would be
    left out, and that one's parts are put together.)"""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.repartition(max(parts + 1, least), key)


def held(name: str, value: str, body: str) -> str:
    """SQL: body with name standing for value, which is worked out once. (transform() would copy the result with all that it holds, which
    makes a state that grows cost time with its square.)"""
    return f"aggregate(cast(array() AS array<int>), {value}, ({name}, none) -> {name}, {name} -> {body})"


def dealt(pages: DataFrame) -> DataFrame:
    """(page_id, html), what laid_out() starts from."""
    return by_page(pages.select("page_id", F.coalesce(F.nullif(F.col("html"), F.lit("")), F.lit(" ")).alias("html")))


def walked_by(f, kind: str):
    """A function over pages in Python. It is called once a page: a filter on what it gives would be pushed below it with a call of its
    own, were it not called nondeterministic."""
    return F.udf(f, kind, useArrow=False).asNondeterministic()


def page_structure(pages: DataFrame, removed: str | None = None, with_tokens: bool = False, tags: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, text, elements): text is binary; elements have pos and close (places of tokens), up (index of the parent, from 0),
    parent (its pos), depth, nth (place among the elements opened under the same one, from 1), tag, id, classes, role, names and
    values of the attributes, start and size (of the text, in bytes). Elements that fulfil `removed`, SQL over tag, id, class
    and role, are left out with all that they hold. `with_tokens` adds toks, the page's tokens by place. With `tags` only elements
    of these are kept; up still counts all.

    All of it is within a page's row: a task holds some pages at a time."""
    return laid_out(dealt(pages), removed, ("toks",) if with_tokens else (), tags)


def laid_out(s: DataFrame, removed: str | None = None, kept: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, text, elements, kept) of dealt() and its columns `kept`, as page_structure() has them."""
    if removed or "toks" in kept:
        s = once(s.withColumn("toks", F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))), "toks")
    if removed:
        for name in ("role", "class", "id"):
            pattern = sql_text(rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
            removed = held(name, f"coalesce(CASE WHEN tok RLIKE '\\\\s' THEN regexp_replace(get(regexp_extract_all(tok, {pattern}, 1), 0), {sql_text(EDGES)}, '') END, '')", removed)
        removed = held("tag", "lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9-]*)', 1))", removed)
        s = s.withColumn("_places", F.expr(f"array_compact(transform(toks, (tok, i) -> CASE WHEN startswith(tok, '<') AND NOT startswith(tok, '</') THEN CASE WHEN {removed} THEN i END END))"))
        s = once(s, "_places")  # a Python function's input can't hold a lambda
    walk = walked_by(Walk(frozenset(tags) or None), WALKED)
    s = s.select("page_id", *kept, walk("html", *["_places"] * bool(removed)).alias("_s")).select("page_id", *kept, "_s.text", "_s.elements")
    return once(s, *kept, "text", "elements")


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_value(name: str, e: str = "e") -> str:
    """An attribute of element e as it stands in the page, null where there is none."""
    return f"get({e}.values, cast(array_position({e}.names, {sql_text(name)}) - 1 AS int))"


@dataclass(frozen=True)
class El:
    """What an element is: tag, classes, id, role and an attribute, which holds, equals or begins with a value; empty parts fit
    any. It has to lie in `inside`, and to be a child of `under`. `tags` and `any_cls` are alternatives; `without` is a class
    that it lacks."""

    tag: str = ""
    cls: str = ""
    id: str = ""
    attr: str = ""
    op: str = "has"
    value: str = ""
    inside: El | None = None
    under: El | None = None
    tags: tuple[str, ...] = ()
    any_cls: tuple[str, ...] = ()
    role: str = ""
    without: str = ""

    def fits(self, tag: str, id: str, classes: list[str], role: str, names: list[str], values: list[str]) -> bool:
        """Whether an element is one, but for where it lies."""
        if (self.tag and tag != self.tag) or (self.tags and tag not in self.tags) or (self.role and role != self.role) or (self.id and id != self.id):
            return False
        if (self.any_cls and not any(c in classes for c in self.any_cls)) or not all(c in classes for c in self.cls.split()) or (self.without and self.without in classes):
            return False
        if not self.attr or self.op == "has":
            return not self.attr or self.attr in names
        there = values[names.index(self.attr)] if self.attr in names else ""
        return {"equals": there == self.value, "holds": self.value in there, "begins": there.startswith(self.value)}[self.op]

    def is_bare(self) -> bool:
        """Whether an element without attributes may be one."""
        return not (self.cls or self.any_cls or self.id or self.role or self.attr and (self.op == "has" or self.value))

    def places(self) -> list[El]:
        return [x for x in (self.inside, self.under) if x]


def text_in(e: Column) -> Column:
    """The raw text of an element of the structure; BREAK stands for the ends of blocks."""
    return F.decode(F.substring(F.col("text"), e["start"] + 1, e["size"]), "UTF-8")


def shown(raw: Column) -> Column:
    """A raw text as it shows: blocks set apart, references decoded, white space collapsed."""
    return collapsed(decoded(F.replace(raw, F.lit(BREAK), F.lit(" "))))


def written(raw: Column) -> Column:
    """A raw text as it is written, where white space counts."""
    return decoded(F.replace(raw, F.lit(BREAK), F.lit("")))


def marked(rows: DataFrame, marks: dict[str, str]) -> DataFrame:
    """rows (page_id, e, ...) with a column for each mark: the pos of the innermost element around each one that fulfils its
    condition, SQL over the row, itself not counted; null where there is none. Openings and ends are summed up in page order to
    levels; the holder of a level is the last one opened. No element meets another."""
    kept, flags = rows.columns, [f"_is{i}" for i in range(len(marks))]
    rows = rows.selectExpr("*", *[f"coalesce({c}, false) AS {n}" for n, c in zip(flags, marks.values())])
    # at one place: ends first, then what is asked, then the opening itself, so that no element is within itself
    at = lambda place, kind: f"named_struct('at', {place}, 'kind', {kind})"
    rows = rows.selectExpr("*", f"explode(CASE WHEN {' OR '.join(flags)} THEN array({at('e.pos', 1)}, {at('e.pos', 2)}, {at('e.close + 1', 0)}) ELSE array({at('e.pos', 1)}) END) AS _x")
    order = "ORDER BY _x.at, _x.kind, e.pos ROWS UNBOUNDED PRECEDING"
    step = "CASE WHEN _x.kind = 2 THEN 1 WHEN _x.kind = 0 THEN -1 ELSE 0 END"
    rows = rows.selectExpr("*", *[f"sum(CASE WHEN {n} THEN {step} ELSE 0 END) OVER (PARTITION BY page_id {order}) AS _l{n}" for n in flags]).where("_x.kind > 0")
    holders = [f"last(CASE WHEN {n} AND _x.kind = 2 THEN e.pos END, true) OVER (PARTITION BY page_id, _l{n} {order}) AS _h{n}" for n in flags]
    rows = rows.selectExpr("*", *holders).where("_x.kind = 1")
    return rows.selectExpr(*kept, *[f"CASE WHEN _l{n} > 0 THEN _h{n} END AS {name}" for name, n in zip(marks, flags)])


BLOCK = 64  # holders that are asked together whether one of them reaches to an element


def once(rows: DataFrame, *names: str) -> DataFrame:
    """rows with these columns worked out once: one row of a generator, which nothing is merged with or pushed through."""
    kept = [c for c in rows.columns if c not in names]
    return rows.select(*kept, F.explode(F.array(F.struct(*names))).alias("_once")).select(*kept, *[f"_once.{n}" for n in names])


def holders(condition: str) -> str:
    """SQL: those of the page's elements _e that fulfil a condition over e, in page order, in blocks that know how far they reach. There
    are about as many blocks as holders in one, so that an element asks few of both."""
    hs = f"transform(filter(_e, e -> {condition}), e -> named_struct('pos', e.pos, 'close', e.close))"
    size = f"least({BLOCK}, cast(ceil(sqrt(size(hs))) AS int))"
    cut = f"transform(array({hs}), hs -> CASE WHEN size(hs) = 0 THEN array() ELSE transform(sequence(0, (size(hs) - 1) div {size}), i -> slice(hs, cast(i * {size} + 1 AS int), {size})) END)[0]"
    return f"transform({cut}, hs -> named_struct('low', hs[0].pos, 'high', array_max(hs.close), 'hs', hs))"


def around(name: str, place: str) -> str:
    """SQL: the holders `name` that a place of the page lies in, from their opening on."""
    return f"flatten(transform(filter({name}, b -> b.low <= {place} AND b.high >= {place}), b -> filter(b.hs, h -> h.pos <= {place} AND h.close >= {place})))"


def innermost(name: str) -> str:
    """SQL: the pos of the last one of the holders `name` around element e, itself not counted; null where there is none. An element
    meets blocks, and the holders of those that reach to it."""
    near = f"filter({name}, b -> b.low < e.pos AND b.high >= e.pos)"
    return f"array_max(flatten(transform({near}, b -> filter(b.hs, h -> h.pos < e.pos AND h.close >= e.pos).pos)))"


@dataclass(frozen=True)
class Pick:
    """A field's value: of elements `el`, the text as it shows (`text`), as it is written (`raw`), null (`none`), or an attribute."""

    field: str
    el: El
    take: str = "text"
    rank: int = 0


def picks(field: str, *els: El, take: str = "text") -> list[Pick]:
    """Alternatives in their order."""
    return [Pick(field, el, take, i) for i, el in enumerate(els)]


def hits_of(fields: list[Pick], scopes: dict[str, El] | None) -> Hits:
    asked = [*(scopes or {}).items()]
    els = [*[p.el for p in fields], *[el for _, el in asked]]
    for el in els:
        els += [p for p in el.places() if p not in els]
    els = list(dict.fromkeys(els))
    return Hits(els, [(els.index(p.el), p.field, p.rank, p.take) for p in fields], [(els.index(el), name) for name, el in asked])


def shown_hits(rows: DataFrame) -> DataFrame:
    rows = rows.select("page_id", F.explode("h").alias("h")).select("page_id", "h.*")
    # decoded once, after all alternatives have met
    cut = F.when(F.col("take").isin("text", "raw"), F.replace(F.col("raw"), F.lit(BREAK), F.when(F.col("take") == "text", " ").otherwise(""))).otherwise(F.col("raw"))
    shows = let(decoded(cut), lambda v: F.when(F.col("take") == "text", collapsed(v)).otherwise(v))
    return rows.select("page_id", "scope", "field", "rank", "pos", "close", "parent", shows.alias("value"))


def collect_hits(structure: DataFrame, fields: list[Pick], scopes: dict[str, El] | None = None) -> DataFrame:
    """(page_id, scope, field, rank, pos, close, parent, value) of every element that is picked, in no order. `scope` is the pos of
    the nearest scope around it, -1 without one: a scope within a scope owns its own fields. A row of field `scope` stands for
    every scope itself, with its name as value."""
    found = walked_by(hits_of(fields, scopes).of_structure, HITS)
    return shown_hits(structure.select("page_id", found("text", "elements").alias("h")))


def page_hits(pages: DataFrame, fields: list[Pick], scopes: dict[str, El] | None = None) -> DataFrame:
    """collect_hits() of the structure of pages, found in the walk over a page's tags; elements that aren't picked don't leave it."""
    found = walked_by(hits_of(fields, scopes).of_page, HITS)
    return shown_hits(dealt(pages).select("page_id", found("html").alias("h")))


def first_values(hits: DataFrame, valid: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, scope, field, pos, value): of each field the first element of each alternative, and of these the first
    alternative whose value isn't empty and fulfils `valid`."""
    each = hits.groupBy("page_id", "scope", "field", "rank").agg(F.min_by(F.struct("pos", "value"), "pos").alias("v")).select("page_id", "scope", "field", "rank", "v.*")
    ok = F.coalesce("value", F.lit("")) != ""
    for field, condition in (valid or {}).items():
        ok = ok & ((F.col("field") != field) | F.coalesce(condition, F.lit(False)))
    return each.where(ok).groupBy("page_id", "scope", "field").agg(F.min_by(F.struct("pos", "value"), "rank").alias("v")).select("page_id", "scope", "field", "v.*")


def record(hits: DataFrame, single: list[str], many: list[str] = (), valid: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, scope, fields): single fields by first_values(), the others as arrays of all values in page order, from the first
    alternative that has any."""
    field = F.col("field")
    kept = [F.max(F.when(field == n, F.col("value"))).alias(n) for n in single]
    out = first_values(hits.where(field.isin(list(single))), valid).groupBy("page_id", "scope").agg(*kept)
    if not many:
        return out
    values = lambda n: F.array_sort(F.collect_list(F.when((field == n) & (F.coalesce("value", F.lit("")) != ""), F.struct("rank", "pos", "value"))))
    lists = hits.where(field.isin(list(many))).groupBy("page_id", "scope").agg(*[values(n).alias(n) for n in many])
    of = lambda n: F.transform(F.filter(n, lambda x: x.rank == F.get(n, F.lit(0)).rank), lambda x: x.value)
    lists = lists.select("page_id", "scope", *[of(n).alias(n) for n in many])
    return out.join(lists, ["page_id", "scope"], "full").select("page_id", "scope", *single, *[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in many])
