"""Page structure, records of sites, rules at scale and versioned usage, on small pages with values worked out by hand."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagemill.operators import html, rules, sites
from pagemill.operators.structure import El, Pick, collect_hits, first_values, page_structure, picks, shown, text_in
from pagemill.streaming import counts


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()


def page(spark, *htmls, url="https://a.com/b/c?x=1"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


class Tree(HTMLParser):
    """Elements of well-formed pages: (tag, parent's number, place among siblings, text)."""

    def __init__(self):
        super().__init__()
        self.found, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        up = self.stack[-1] if self.stack else None
        self.found.append([tag, up, sum(f[1] == up for f in self.found) + 1, ""])
        if tag == "br":
            self.handle_data(" ")
        if tag not in ("br", "img"):
            self.stack.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        for i in self.stack:
            self.found[i][3] += data


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["text", "span", "b", "i", "em", "br", "img"])
        if kind == "text" or depth > 4:
            out.append(rng.choice(["word ", "é ", "x", " "]))
        elif kind in ("br", "img"):
            out.append(f"<{kind}>")
        else:
            out.append(f"<{kind} class='c{depth}'>{random_page(rng, depth + 1)}</{kind}>")
    return "".join(out)


def test_structure_is_the_tree(spark):
    rng = random.Random(8)
    htmls = [f"<span>{random_page(rng)}</span>" for _ in range(40)]
    got = page_structure(page(spark, *htmls)).select("page_id", F.transform("elements", lambda e: F.struct(e["tag"], e["up"], e["nth"], shown(text_in(e)))).alias("e"))
    for r in got.collect():
        tree = Tree()
        tree.feed(htmls[r.page_id])
        assert [tuple(e) for e in r.e] == [(t, u, n, " ".join(x.split())) for t, u, n, x in tree.found]


def test_structure_of_empty_and_broken_pages(spark):
    rows = page_structure(page(spark, None, "", "<p>a<p>b", "<div><p>x</div>tail")).orderBy("page_id").collect()
    assert [len(r.elements) for r in rows] == [0, 0, 2, 2]
    assert [e.up for e in rows[2].elements] == [None, None] and [e.up for e in rows[3].elements] == [None, 0]
    gone = page_structure(page(spark, "<div>a<nav><p>b</p></nav><p>c</p></div>"), "tag = 'nav'").first()
    assert [(e.tag, e.up) for e in gone.elements] == [("div", None), ("p", 0)] and bytes(gone.text).decode().replace("\x01", "") == "ac"


def test_children_scopes_and_alternatives(spark):
    p = page(spark, "<ul class=a><li>1<ul><li>2</li></ul></li></ul><q class=s><b>in</b><q class=s><b>deep</b></q></q><i id=x> </i><i class=y>$0.00</i><i class=z>7</i>")
    fields = [Pick("child", El("li", under=El("ul", cls="a"))), Pick("bold", El("b")), *picks("price", El("i", id="x"), El("i", cls="y"), El("i", cls="z"))]
    h = collect_hits(page_structure(p), fields, {"s": El("q", cls="s")})
    assert [(r.value) for r in h.where("field = 'child'").collect()] == ["1 2"]
    scopes = sorted(r.pos for r in h.where("field = 'scope'").collect())
    assert sorted((r.scope, r.value) for r in h.where("field = 'bold'").collect()) == [(scopes[0], "in"), (scopes[1], "deep")]
    assert [r.value for r in first_values(h.where("field = 'price'"), {"price": F.col("value") != "$0.00"}).collect()] == ["7"]


def test_best_block_by_names(spark):
    p = page(
        spark,
        "<body><div class='unlikely comment'><p>one, two, three, four, five, six, seven, eight</p></div><div class='article-body'><p class='entry'>A sentence that is long enough to count.</p></div></body>",
        "<body><table><p>not scored, though it is long enough.</p></table></body>",
        "<body><div><p>short</p></div></body>",
    )
    got = sites.best_blocks(p).collect()
    assert [(r.page_id, r.tag, r.score) for r in got] == [(0, "div", round(0.4 + 1 + 2, 6))]


def test_markdown_leaves_code_alone(spark):
    p = page(spark, "<article><pre>x\n y\n\n\n\nz</pre><p>a``</p><pre>```</pre><table><tr><td colspan=2>s</td></tr></table><table><tr><td>p</td></tr></table></article>")
    assert html.page_markdown(p).first().markdown == "```\nx\n y\n\n\n\nz\n```\n\na``\n\n````\n```\n````\n\n<table><tr><td colspan=2>s</td></tr></table>\n\n| p |\n| --- |"
    assert html.page_markdown(p, "remove").first().markdown.endswith("````")


def test_quotes_own_their_fields(spark):
    def part(name, inner, tag="div", more=""):
        return f"<{tag} data-testid='{name}' {more}>{inner}</{tag}>"

    quote = f"<div role='link'><span>@them said</span>{part('tweetText', 'quoted')}{part('tweetPhoto', '<img src=q.png>')}</div>"
    post = part("tweet", part("tweet", "<a role='link' href='/me/status/1'>t</a><a role='link' href='/me'>Me</a>" + part("tweetText", "own") + quote + "<button aria-label='1.2K Likes'></button><button aria-label='1,234 replies'></button><video poster='v.jpg' loop></video>"), "article")
    got = sites.social_posts(page(spark, post, "<p>none</p>")).orderBy("post_no").collect()
    assert [(r.kind, r.of, r.handle, r.text, r.likes, r.replies, [tuple(m) for m in r.media]) for r in got] == [("post", None, "me", "own", 1200, 1234, [("gif", "v.jpg")]), ("quote", 1, "them", "quoted", 0, 0, [("image", "q.png")])]


def test_engagement(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(["123 replies", "1.2K Likes", "1,234", "2.5m", "3B x", "none", "", None])], "i int, v string")
    assert [r.n for r in rows.select("i", sites.engagement(F.col("v")).alias("n")).orderBy("i").collect()] == [123, 1200, 1234, 2_500_000, 3_000_000_000, 0, 0, 0]


def test_json_is_cut_where_braces_balance(spark):
    rows = [(0, 'var p = {"a":"} \\" {","b":{}};var q={}'), (1, "var p = {open"), (2, "no"), (3, None), (4, "p={" + '"k":"' + "{" * 5_000 + '"} tail')]
    got = spark.createDataFrame(rows, "i int, h string").select("i", sites.assigned_json(F.col("h"), "p").alias("j")).orderBy("i").collect()
    assert [r.j for r in got[:4]] == ['{"a":"} \\" {","b":{}}', None, None, None] and got[4].j == rows[4][1][2:-5]


def test_video_kinds_by_precedence(spark):
    pages = [("https://www.youtube.com/shorts/x", "<body><i class=ytp-live-badge></i></body>"), ("https://www.youtube.com/watch?v=1", "<body><i class=ytp-live-badge></i>This video is unavailable</body>"), ("https://www.youtube.com/watch?v=2", "<body>sign in to confirm your age</body>"), ("https://www.youtube.com/watch?v=3", "<body>This video is unavailable</body>"), ("https://www.youtube.com/watch?v=4", "")]
    got = sites.video_pages(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.kind, r.supported) for r in got] == [("shorts", True), ("live", False), ("age-restricted", False), ("unavailable", False), ("normal", True)]


def test_paper_of_listed_authors(spark):
    p = page(spark, "<h1 class=title>On  X</h1><div class=authors>Ann Lee, Bo Wu, Cy Do</div><div class=dateline>[Submitted on 3 May 2021]</div>", url="https://arxiv.org/abs/2105.00001v3")
    papers = sites.paper_pages(p)
    r = papers.withColumn("cite", sites.paper_citation()).withColumn("bib", sites.paper_bibtex("1999")).first()
    assert (r.paper_id, r.version, list(r.authors), r.submitted, r.cite) == ("2105.00001", 3, ["Ann Lee", "Bo Wu", "Cy Do"], "3 May 2021", 'Ann Lee et al. (2021). "On X". arXiv:2105.00001')
    assert r.bib.startswith("@article{lee2021210500001,\n  title     = {On X},\n  author    = {Ann Lee and Bo Wu and Cy Do},")
    docs = sites.documentation_pages(page(spark, "<nav class=breadcrumb><a>A</a><a>B</a></nav><h1>B</h1>"))
    assert sites.render_documentation(docs, spark.createDataFrame([(0, "text")], "page_id long, content string")).first().body == "# B\n\n> 📍 Path: A → B\n> 📁 Section: A\n\ntext"


def test_rules_meet_by_equality_at_scale(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 9]))) for _ in range(20_000)]
    table = rules.rule_table(spark, [(i, "title-contains", n, i % 4_000 == 7, [f"t{i}"], 0, True) for i, n in enumerate(names)], "rule_no int, type string, value string, invert boolean, tags array<string>, priority int, enabled boolean")
    titles = ["".join(rng.choice("ABCDefgh ") for _ in range(60)) for _ in range(5)] + ["", None]
    pages = spark.createDataFrame([(i, "https://x.com", t, None, None, None, None, None) for i, t in enumerate(titles)], "page_id long, url string, title string, content string, keywords array<string>, categories array<string>, author string, site_name string")
    got = rules.rule_tags(pages, table)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(p, i) for p, t in enumerate(titles) for i, n in enumerate(names) if (n in (t or "").lower()) != (i % 4_000 == 7)}
    assert {(r.page_id, r.rule_no) for r in got.collect()} == want


def test_globs_meet_by_equality(spark):
    schema = "domain string, name string, url_pattern string, priority int, is_custom boolean, enabled boolean"
    table = rules.rule_table(spark, [("*.b.com", "one", None, 0, False, True), ("**.com", "deep", None, 0, False, True), ("[wx].b.?om", "set", None, 0, False, True), ("*", "any", None, -1, False, True), ("?.??", "marks", None, 0, False, True)], schema)
    pages = spark.createDataFrame([(0, "https://w.b.com/"), (1, "https://a.w.b.com/"), (2, "https://z.de/"), (3, "nothing")], "page_id long, url string")
    got = rules.all_matches(pages, table)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.page_id, r.name) for r in got.collect()} == {(0, "one"), (0, "deep"), (0, "set"), (0, "any"), (1, "deep"), (1, "any"), (2, "any"), (2, "marks"), (3, "any")}


def test_usage_is_left_as_it_is_by_a_replay(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame([(i, t, s) for i, t, s in rows], "event_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))

    first, second = batch((1, "News", "2024-01-01"), (2, "news ", "2024-01-02"), (3, "b", "2024-01-02"), (4, " ", "2024-01-02")), batch((5, "NEWS", "2024-02-01"), (6, "c", "2024-02-02"), (7, "c", "2024-02-03"))
    for number, rows in ((0, first), (1, second), (1, second)):
        counts.merge_tag_usage(rows, number, str(tmp_path), 2)
    got = {r.tag_key: (r.uses, r.tag, str(r.last_used)[:10]) for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert got == {"news": (3, "News", "2024-02-01"), "c": (2, "c", "2024-02-03")}


def test_usage_stream_is_the_batch(spark, tmp_path):
    rows = [(i, f"T{i % 7}", f"2024-01-{i % 27 + 1:02d}") for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, day string").select("event_id", "event_type", F.to_timestamp("day").alias("ts"))
    for i in range(3):
        events.where(f"event_id % 3 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = counts.keep_tag_usage(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).start()
    query.processAllAvailable()
    query.stop()
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    from pagemill.operators.history import tag_usage

    keys = ["tag_key", "uses", "last_used"]
    assert last == 2 and sorted(map(tuple, spark.read.parquet(str(tmp_path / f"out/{last}")).select(keys).collect())) == sorted(map(tuple, tag_usage(events).select(keys).collect()))


def test_daily_counts_of_a_batch(spark):
    events = spark.createDataFrame([("2024-01-01 05:00:00",), ("2024-01-01 23:00:00",), ("2024-01-02 00:00:00",)], "ts string")
    assert sorted((str(r[0]), r[1]) for r in counts.clip_counts_stream(events, period="daily").collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]
