"""Operators on small tables with expected values that were worked out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text, urls
from pagemill.operators import batch, history, html, metadata, notes, pages, records, rules, sequences, sites, suggest, titles
from pagemill.sources import tables
from pagemill.streaming import counts


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()


def each(spark, expr, values):
    """expr applied to a column of strings."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", expr(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def page(spark, *htmls, url="https://a.com/b/c?x=1"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_urls(spark):
    base = F.lit("https://a.com/b/c?x=1#f")
    hrefs = ["//cdn.b.com/y", "/r", "d", "../e", "./f/./g/../h", "?q=2", "#top", "", "https://x.org/z", "mailto:me", "../../../up", "i/..", " j "]
    want = ["https://cdn.b.com/y", "https://a.com/r", "https://a.com/b/d", "https://a.com/e", "https://a.com/b/f/h", "https://a.com/b/c?q=2", "https://a.com/b/c?x=1#top", "https://a.com/b/c?x=1#f", "https://x.org/z", None, "https://a.com/up", "https://a.com/b/", "https://a.com/b/j"]
    assert each(spark, lambda v: urls.resolved(base, v), hrefs) == want
    assert each(spark, urls.normalized, ["https://A.com/x/?a=1&b=2&a=3&utm_source=y#f", "https://a.com/?a", "https://a.com/", "not a url"]) == ["https://a.com/x?a=3&b=2", "https://a.com?a=", "https://a.com", "not a url"]
    once = each(spark, urls.normalized, want[:9])
    assert each(spark, urls.normalized, once) == once
    assert each(spark, urls.page_type, ["https://x.com/a/status/1", "https://youtube.com/shorts/xyz", "https://a.com/doc.pdf", "https://a.com/doc.pdfs"]) == ["twitter", "youtube", "pdf", "web"]
    assert each(spark, lambda v: urls.page_type(v, F.lit("application/pdf; q")), ["https://a.com/x"]) == ["pdf"]
    keys = each(spark, urls.site_key_of, ["https://arxiv.org/abs/2301.12345", "https://arxiv.org/pdf/2301.12345v2.pdf", "https://arxiv.org/abs/hep-th/9901001", "https://www.amazon.com/x/dp/b012345678/ref=1", "https://www.amazon.com/dp/B01234567", "https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?t=1&v=abcdefghijk", "https://github.com/o/r/issues/12"])
    assert [k and (k.site, k.key, k.key2) for k in keys] == [("paper", "2301.12345", None), ("paper", "2301.12345", "v2"), ("paper", "hep-th/9901001", None), ("product", "B012345678", None), None, ("video", "abcdefghijk", None), ("video", "abcdefghijk", None), ("issue", "o/r", "12")]
    assert each(spark, urls.page_kind, ["https://github.com/o/r", "https://github.com/o/r/pull/3", "https://gist.github.com/x", "https://news.ycombinator.com/item?id=1", "https://www.allrecipes.com/x", "https://a.com"]) == ["repo", "pr", "gist", "story", "recipe", "other"]
    assert each(spark, lambda v: urls.same_site(v, F.lit("https://www.b.co/x")), ["https://b.co", "https://m.b.co/y", "https://c.co"]) == [True, True, False]


def test_url_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# head\nhttps://a.com \r\n\n  b.com\nhttps://a.com\n")
    assert [r.url for r in tables.read_url_list(spark, str(tmp_path)).orderBy("file", "block", "line").collect()] == ["https://a.com", "b.com", "https://a.com"]
    assert tables.read_url_list(spark, str(tmp_path), True).count() == 2


def test_text(spark):
    assert each(spark, text.decoded, ["a &lt;b&gt; &amp;lt; &#39;&#x20AC;&#128512; &euro;", None, "&#0;&#xD800;x"]) == ["a <b> &lt; '€😀 €", None, "x"]
    assert each(spark, notes.number_of, ["1.2k", "15.3k", "2.5m", "1.2k points", "score: 500", "", "abc", "1.2K Likes", "10.5k views", "1,234,567", "2.5B"]) == [1200, 15300, 2500000, 1200, 500, None, None, 1200, 10500, 1234567, 2500000000]
    assert each(spark, notes.duration_words, ["PT1H30M", "1 hr 15 min", "", "PT1M", "P1DT2H"]) == ["1 hour 30 minutes", "1 hr 15 min", None, "1 minute", "1 day 2 hours"]
    assert each(spark, sequences.timestamp_seconds, ["1:05", "1:00:01", "x", "7", ""]) == [65, 3601, 0, 0, 0]
    stats = history.reading_stats(spark.createDataFrame([(1, " ".join(["w"] * 200)), (2, " \n\t"), (3, None), (4, " a  b ")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in stats] == [(1, 200, 399, 1), (2, None, None, None), (3, None, None, None), (4, 2, 3, 1)]


def test_titles(spark):
    raw = ["My Article - Medium", "Hello &amp; World", "Price: &#36;99", "User/Repo: Description - GitHub", "Breaking: state-of-the-art", "a plain one..."]
    assert each(spark, titles.cleaned, raw) == ["My Article", "Hello & World", "Price: $99", "User/repo: Description", "state-of-the", "a plain one"]
    assert each(spark, titles.deep_cleaned, ["Article Title (on GitHub)", "Article Title - 2024", "Issue Title #456"]) == ["Article Title", "Article Title", "Issue Title"]
    assert each(spark, titles.cut, ["x" * 101, "word " * 30, "short"]) == ["x" * 100 + "…", ("word " * 20).strip() + "…", "short"]
    rows = [(1, "T - Medium", "T", "Name", "OG", "og", "# Head ##\nx"), (2, None, None, None, None, None, ""), (3, "A b (c)", None, None, None, None, "A first line\nx")]
    got = titles.suggest_titles(spark.createDataFrame(rows, "page_id long, title string, headline string, name string, og_title string, twitter_title string, markdown string")).orderBy("page_id", "rank").collect()
    assert [(r.page_id, r.title, r.source) for r in got] == [(1, "T", "original"), (1, "Name", "headline"), (1, "OG", "og"), (2, "Untitled", None), (3, "A b (C)", "original"), (3, "A b", "cleaned"), (3, "A first line", "generated")]


def test_spans_of_open_elements(spark):
    p = page(spark, "<div><p>one<p>two<ul><li>a<li>b</ul></div><img src=x><p>three</p>")
    t = pages.page_tokens(p)
    got = {(r.tag, r.open_pos): r.close_pos for r in html.page_intervals(t).collect()}
    tok = {r.pos: r.tok for r in t.collect()}
    inner = {k: "".join(tok[i] for i in range(k[1], end + 1)) for k, end in got.items()}
    assert sorted(inner.values()) == sorted(["<div><p>one<p>two<ul><li>a<li>b</ul></div>", "<p>one", "<p>two<ul><li>a<li>b</ul>", "<ul><li>a<li>b</ul>", "<li>a", "<li>b", "<img src=x>", "<p>three</p>"])


def test_main_content_and_paywall(spark):
    words = "some words of the story, told again. " * 20
    p = page(
        spark,
        f"<body><nav>menu</nav><div role='main'><h1>T</h1><p>{words}</p><div class='x ads'>buy</div></div></body>",
        f"<body><main>m</main><article>{words}<header>h</header></article></body>",
        "<body><script>var a = '<p>no</p>'</script><div class=content>c &amp; d</div></body>",
        "<body><article>short, subscribe to premium</article></body>",
        "<p></p>",
    )
    got = [r.text for r in html.main_content(p).orderBy("page_id").collect()]
    assert got == ["T " + words.strip(), words.strip(), "c & d", "short, subscribe to premium", ""]
    assert [r.paywalled for r in html.paywall_flags(p).orderBy("page_id").collect()] == [False, False, False, True, True]
    assert [r.tag for r in sites.best_blocks(p).where("page_id = 0").collect()] == ["div"]


def test_markdown_tables_and_code(spark):
    p = page(
        spark,
        '<article><h2>A <em>b</em></h2><p>x &amp; <b>y</b><br>z <a href="/q?a=1&amp;b=2">l</a></p><ol><li>one<li>two</ol><blockquote><p>q1</p><p>q2</p></blockquote><hr>'
        "<pre class='lang-js'>let a = `b`;\n  c()</pre><table><tr><th>h</th><th>k</th></tr><tr><td>1</td><td>a|b</td></tr></table></article>",
        "<article><table><tr><td colspan=2>a</td></tr></table><pre>select 1</pre><pre><code>x ```` y</code></pre></article>",
    )
    md = html.page_markdown(p).orderBy("page_id").first().markdown
    assert md == "## A *b*\n\nx & **y**\nz [l](/q?a=1&b=2)\n\n1. one\n2. two\n\n> q1\n>\n> q2\n\n---\n\n```javascript\nlet a = `b`;\n  c()\n```\n\n| h | k |\n| --- | --- |\n| 1 | a\\|b |"
    assert [tuple(r) for r in html.gfm_tables(p).collect()] == [(0, 1, "| h | k |\n| --- | --- |\n| 1 | a\\|b |")]
    assert not html.table_cells(p).where("page_id = 1").first().plain
    assert [(r.page_id, r.language, r.fence) for r in html.code_blocks(p).orderBy("page_id", "block_no").collect()] == [(0, "javascript", "```"), (1, "sql", "```"), (1, "", "`````")]


def test_metadata_and_jsonld(spark):
    head = '<html lang="en"><head><title> A &amp;\n B </title><meta name="description" content=""><meta property="og:description" content="d"><meta name="application-name" content="App"><link href="/c" rel="canonical"></head>'
    r = metadata.page_metadata(page(spark, head)).first()
    assert (r.title, r.description, r.site_name, r.canonical_url, r.language, r.keywords, r.og_images) == ("A & B", "d", "App", "https://a.com/c", "en", None, None)
    script = lambda *raw: "".join(f'<script type="application/ld+json">{x}</script>' for x in raw)
    p = page(
        spark,
        script('[{"@type":"WebPage","name":"w"},{"@type":"https://schema.org/NewsArticle","headline":" h ","author":[{"name":"x"},"y"],"image":{"url":"i"},"keywords":["a","b,a"]}]'),
        script("{bad", '<!-- {"@graph":[{"@type":"Thing"},{"@type":["Thing","Article"],"author":{"name":"z"},"headline":{"no":1},"name":"n"}],"@type":"WebPage"} -->'),
        script('{"name":"no type"}'),
    )
    got = {r.page_id: r for r in metadata.best_jsonld(p).collect()}
    assert set(got) == {0, 1}
    assert (got[0].schema_type, got[0].headline, got[0].authors, got[0].images, got[0].keywords, got[0].score) == ("NewsArticle", "h", ["x", "y"], ["i"], ["a", "b"], 45)
    assert (got[1].schema_type, got[1].headline, got[1].authors, got[1].score) == ("Article", "n", ["z"], 33)
    assert metadata.jsonld_nodes(p).where("page_id = 1").count() == 3


def hosts(spark, *names):
    return spark.createDataFrame([(i, f"https://{h}") for i, h in enumerate(names)], "page_id long, url string")


def test_templates_and_domains(spark):
    p = hosts(spark, "a.b.medium.com/x", "medium.com/r/q/comments/1", "MEDIUM.com/item?id=123", "new.reddit.com/", "localhost/")
    t = rules.rule_table(spark, [("medium.com", "plain", None, 1, False, True), ("*.medium.com", "one", None, 1, False, True), ("**.medium.com", "deep", None, 1, False, True), ("old.reddit.com", "old", None, 1, False, True), ("medium.com", "item", "/item*", 2, False, True), ("medium.com", "forum", "^/r/[^/]+/comments/", 3, True, True), ("*", "any", None, 0, False, True)], "domain string, name string, url_pattern string, priority int, is_custom boolean, enabled boolean")
    got = {}
    for r in rules.all_matches(p, t).orderBy("rank").collect():
        got.setdefault(r.page_id, []).append(r.name)
    assert got == {0: ["deep", "plain", "any"], 1: ["forum", "plain", "any"], 2: ["item", "plain", "any"], 3: ["any"], 4: ["any"]}
    assert rules.match_templates(p, t, ["forum"]).where("page_id = 1").first().name == "plain"
    d = rules.rule_table(spark, [("github.com", ["exact"], True), ("*.github.com", ["sub"], True)], "domain string, tags array<string>, enabled boolean")
    tags = sorted((r.page_id, r.tag) for r in rules.domain_tags(hosts(spark, "www.github.com/x", "github.com", "gist.github.com", "mygithub.com"), d).collect())
    assert tags == [(0, "exact"), (1, "exact"), (2, "sub")]
    auth = [r.method for r in rules.flag_auth(hosts(spark, "x.com/a", "me.substack.com", "netflix.com", "nytimes.com/x")).orderBy("page_id").collect()]
    assert auth == ["profile", "cookies", "none", "profile"]


def test_small_joins(spark):
    sug = spark.createDataFrame([(1, "A"), (1, "b"), (2, "A")], "page_id long, tag string")
    left = rules.drop_dismissed(sug, spark.createDataFrame([("B",)], "tag string"), spark.createDataFrame([(2, "a")], "page_id long, tag string"))
    assert [tuple(r) for r in left.select("page_id", "tag").collect()] == [(1, "A")]
    prim = spark.createDataFrame([(1, "good text", "h", False), (2, "", "h", False), (3, "walled text", "h", True), (4, "no", "h", False)], "page_id long, text string, handle string, walled boolean")
    back = spark.createDataFrame([(2, "from one", "f"), (4, "x", None)], "page_id long, text string, handle string")
    more = spark.createDataFrame([(2, "from two", "g"), (3, "mirror", None)], "page_id long, text string, handle string")
    assert [tuple(r) for r in rules.coalesce_sources(prim, [back, more]).orderBy("page_id").collect()] == [(1, "good text", "h", 0), (2, "from one", "f", 1), (3, "mirror", "h", 2), (4, "no", "h", 0)]
    n = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "group_id long, title string")
    assert {(r.title, r.links) for r in rules.group_backlinks(n).collect()} == {("x", "## Related\n\n- [[y]]"), ("y", "## Related\n\n- [[x]]"), ("z", "")}
    known = rules.rules_with_known_note(spark.createDataFrame([("t", "Note"), ("u", "none")], "term string, note string"), spark.createDataFrame([("note",)], "title string"))
    assert [r.term for r in known.collect()] == ["t"]
    s = rules.template_summary(spark.createDataFrame([("*.a.com", True), ("a.com", False), ("b.com", True)], "domain string, enabled boolean"))
    assert {tuple(r) for r in s.collect()} == {("a.com", 2, 1, 1), ("b.com", 1, 1, 0), ("*", 3, 2, 1)}


def test_suggestions(spark):
    d = spark.createDataFrame([(1, "Spark joins data. Spark joins rows; spark JOINS again. `spark code` [spark](http://x) ünter tags tags")], "doc_id long, text string")
    words = {r.word: (r.freq, r["rank"]) for r in suggest.score_keywords(d, []).collect()}
    assert set(words) == {"spark", "joins"} and words["spark"] == (4, 1)
    pair = suggest.score_bigrams(d, []).collect()
    assert [(r.first_word, r.second_word, r.freq) for r in pair] == [("spark", "joins", 3)]
    assert [r.tag for r in suggest.content_tags(d, []).collect()] == ["spark-joins"]
    meta = spark.createDataFrame([(1, ["C++ & More!", "x"], ["X", "y"], "article"), (2, None, None, "other")], "page_id long, keywords array<string>, jsonld_keywords array<string>, og_type string")
    m = suggest.metadata_tags(meta)
    assert [(r.tag, r.confidence) for r in m.orderBy("seq").collect()] == [("c-more", 0.9), ("x", 0.9), ("x", 0.85), ("y", 0.85), ("article", 0.7)]
    other = spark.createDataFrame([(1, "X", 0.95, 0), (1, "dom", 0.8, 0)], "page_id long, tag string, confidence double, seq long")
    assert [(r.tag, r.confidence) for r in suggest.suggest_tags([m, other]).orderBy("rank").collect()] == [("c-more", 0.9), ("x", 0.9), ("y", 0.85), ("dom", 0.8), ("article", 0.7)]
    c = spark.createDataFrame([(1, "https://a.com/recipe/1", "Cake recipe", "Ingredients:\n2 cups flour", "Recipe", None), (2, "https://github.com/x", "Guide", "nothing", None, ["api"]), (3, "https://a.com", "x", "y", None, None)], "page_id long, url string, title string, content string, schema_type string, keywords array<string>")
    assert [(r.page_id, r.category, r.confidence) for r in suggest.detect_categories(c).collect()] == [(1, "recipe", 0.95), (2, "code", 0.8)]


def test_notes(spark):
    make = lambda tags, kind: spark.range(1).select(notes.note_tags(F.lit(tags), F.lit(kind)).alias("t")).first().t
    assert make(" a, B ,A,, b", "web") == ["a", "B"] and make("", "web") == ["web-clip"] and make("", "pdf") == ["pdf"] and make("YouTube", "youtube") == ["YouTube"]
    assert each(spark, notes.file_name, ['a/b: "c"?', " \x01 ", None, "x" * 120]) == ["a-b- -c--", "Untitled", "Untitled", "x" * 100]
    assert each(spark, notes.quoted, ['a"b\\c\r\nd\te']) == ['"a\\"b\\\\c\\nd\\te"']
    assert [notes.yaml_key(k) for k in ("a b", "1x", " ", "ok_-1")] == ["a_b", "x_1x", "x", "ok_-1"]
    d = spark.createDataFrame([("s", "t", " ", "2024", ["x", " "], "article", True, 3.0, [], "v")], "source string, title string, author string, date_clipped string, tags array<string>, type string, flag boolean, n double, l array<string>, z string")
    got = d.select(notes.frontmatter_yaml(d, {"z": "z", "flag": "flag", "n": "n", "l": "l", "type": "z"}).alias("f")).first().f
    assert got == '---\nsource: "s"\ntitle: "t"\ndate_clipped: "2024"\ntags:\n  - "x"\ntype: "article"\nflag: true\nl: []\nn: 3\nz: "v"\n---\n\n'
    v = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q", 3, "c")], "file_path string, page_id long, note string")
    assert {tuple(r) for r in notes.vault_merge(v).collect()} == {("p", "b", 2), ("q", "c", 1)}
    assert {tuple(r) for r in notes.vault_merge(v, "append").collect()} == {("p", "a\nb", 2), ("q", "c", 1)}
    t = spark.createDataFrame([(1, "---\nx: Spark\n---\nSpark SQL and spark, not sparks. `Spark` [[Spark]] Spark again")], "doc_id long, text string")
    r = notes.link_terms(t, [("spark", "Spark"), ("spark sql", "SQL")]).first()
    assert r.text == "---\nx: Spark\n---\n[[SQL|Spark SQL]] and [[Spark|spark]], not sparks. `Spark` [[Spark]] Spark again" and r.links == 2


def test_images_and_filters(spark):
    d = spark.createDataFrame([(1, 'a ![x](http://h/p.PNG?q) ![y](local.png)\n\n\n\n![z](https://h/n "t") ![x](http://h/p.PNG?q) [l](u)')], "doc_id long, text string")
    refs = sequences.image_refs(d)
    assert [tuple(r) for r in refs.orderBy("image_no").collect()] == [(1, 1, "x", "http://h/p.PNG?q", "image-1.png"), (1, 2, "z", "https://h/n", "image-2.img")]
    r = sequences.rewrite_images(d, refs.where("image_no = 1")).first()
    assert r.text == 'a ![x](attachments/image-1.png) ![y](local.png)\n\n\n\n![z](https://h/n "t") ![x](attachments/image-1.png) [l](u)' and (r.total, r.rewritten) == (4, 2)
    assert sequences.filter_markdown(d, images=False, links=False).first().text == "a\n\n  l"


def test_threads_polls_answers(spark):
    rows = [(1, i, a, r, None, "me") for i, (a, r) in enumerate([("x", None), ("me", None), ("me", None), ("y", "ME"), ("z", None), ("me", None)])] + [(2, 0, "me", None, None, "me")]
    p = spark.createDataFrame(rows, "page_id long, ord int, author string, reposter string, reposter_name string, main string")
    assert [tuple(r) for r in sequences.detect_threads(p).orderBy("ord").collect()] == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    o = spark.createDataFrame([(1, "a", 0, 3, 9, 5), (1, "b", 1, 1, 9, 5), (2, "c", 0, 1, 1, None)], "poll_id long, option string, pos int, votes long, total_said long, ends_at int")
    assert [tuple(r) for r in sequences.poll_totals(o, F.lit(6)).orderBy("pos").collect()] == [(1, 0, "a", 3, 4, 75, True), (1, 1, "b", 1, 4, 25, True)]
    a = spark.createDataFrame([(1, 0, False, 9, "u", "x"), (1, 1, True, 0, "", "y"), (1, 2, False, 5, "v", " ")], "question_id long, pos int, accepted boolean, votes long, author string, body string")
    assert [(r["rank"], r.author) for r in sequences.top_answers(a, 3).orderBy("rank").collect()] == [(1, "Community"), (2, "u")]
    c = spark.createDataFrame([(1, 0, None, "x", 80), (1, 1, "u", "", 0), (1, 2, "v", "z", None)], "page_id long, pos int, author string, body string, indent int")
    assert [(r.author, r.depth) for r in sequences.top_comments(c, 2).collect()] == [("[deleted]", 2)]
    t = spark.createDataFrame([(1, 0, "asr"), (1, 1, None), (2, 0, "asr")], "video_id long, pos int, kind string")
    assert {tuple(r) for r in sequences.best_caption_track(t).collect()} == {(1, 1), (2, 0)}


def test_captions_and_items(spark):
    raw = json.dumps({"events": [{"tStartMs": 0, "segs": [{"utf8": "a "}, {"utf8": "b"}]}, {"tStartMs": 5}, {"tStartMs": 3661000, "segs": [{"utf8": " c\n"}]}, {"tStartMs": 1, "segs": [{"utf8": " "}]}]})
    c = sequences.read_captions(spark.createDataFrame([("v", raw), ("w", "bad")], "video_id string, json string"))
    assert [r.transcript for r in sequences.transcripts(c).collect()] == ["**[0:00]** a b\n\n**[1:01:01]** c"]
    i = spark.createDataFrame([(1, 1, 0, "a", False), (1, 1, 1, "b", True), (1, 1, 2, " ", True), (1, 1, 3, "c", None)], "doc_id long, page_no int, seq int, str string, has_eol boolean")
    assert [r.line for r in sequences.lines_from_items(i).orderBy("line_no").collect()] == ["a b", "c"]
    b = spark.createDataFrame([(1, 1, "x" * 10), (1, 2, ""), (1, 3, "y" * 10)], "doc_id long, page_no int, text string")
    r = sequences.budget_text(b, 5, 40).first()
    assert r.text == "## Page 1\n\nxxxxxxxxxx\n\n## Page 3\n\nyyyyyy" and r.truncated
    assert not sequences.budget_text(b, 5, 400).first().truncated and sequences.budget_text(b, 2, 400).first().truncated


def test_crawl(spark):
    a = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    p = spark.createDataFrame([(1, "https://s.com/a", a("b", "c", "/login", "x.pdf", "https://sub.s.com/d", "https://o.com/")), (2, "https://s.com/b", a("a", "e")), (3, "https://s.com/c", a("e", "b"))], "page_id long, url string, html string")
    got = [(r.url, r.depth, r.status) for r in batch.crawl(p, "https://s.com/a#t", 2, 10).orderBy("visit").collect()]
    assert got == [("https://s.com/a", 0, "success"), ("https://s.com/b", 1, "success"), ("https://s.com/c", 1, "success"), ("https://sub.s.com/d", 1, "failed"), ("https://s.com/e", 2, "failed")]
    assert batch.crawl(p, "https://s.com/a", 2, 10, False).where("url like '%sub%'").count() == 0
    assert [r.url for r in batch.crawl(p, "https://s.com/a", 1, 2).orderBy("visit").collect()] == ["https://s.com/a", "https://s.com/b"]
    m = batch.crawl_manifest(batch.crawl(p, "https://s.com/a", 1, 4), spark.createDataFrame([(1, "T"), (2, None)], "page_id long, title string"))
    assert [(r.title, r.file_path) for r in m.orderBy("visit").collect()] == [("T", "Clips/T"), ("Untitled", "Clips/depth-1/Untitled"), ("Untitled", "Clips/depth-1/Untitled"), ("Unknown", None)]


def test_records(spark):
    rows = "<table><tr class='athing'><td><span class='titleline'><a href='/1'>One</a></span></td></tr><tr><td class='subtext'>3 points by <a class='hnuser'>u</a> 1 comment</td></tr><tr class='athing'><td><span class='rank'>7.</span><span class='titleline'><a href='/2'>Two</a></span></td></tr></table>"
    d = records.story_listing(page(spark, rows))
    assert [tuple(r) for r in d.orderBy("rank").collect()] == [(0, 1, "One", "/1", 3, "u", 1), (0, 7, "Two", "/2", None, "", None)]
    assert records.render_stories(d).first().body == "1. [One](/1) (3 points, by u, 1 comments)\n7. [Two](/2)"
    talk = "<table><tr class='comtr'><td><img width=80><a class=hnuser>v</a><span class='commtext c00'>hi <i>there</i></span></td></tr><tr class='comtr'><td><img width=0></td></tr></table>"
    assert [(r.author, r.depth, r.body) for r in sequences.top_comments(records.story_comments(page(spark, talk))).collect()] == [("v", 2, "hi there")]
    node = {"@graph": [{"@type": ["Thing", "http://schema.org/Recipe"], "name": "Soup", "recipeIngredient": ["water"], "recipeInstructions": [{"@type": "HowToStep", "text": "boil"}, "eat"], "totalTime": "PT1H5M", "recipeYield": "2"}]}
    r = records.recipes(page(spark, f'<script type="application/ld+json">{json.dumps(node)}</script>'))
    assert (r.first().name, r.first().steps, r.first().total, r.first().servings) == ("Soup", ["boil", "eat"], "1 hour 5 minutes", "2")
    assert records.render_recipe(r).first().body == "**Total:** 1 hour 5 minutes\n**Servings:** 2\n\n## Ingredients\n\n- water\n\n## Instructions\n\n1. boil\n2. eat"


def test_steps(spark):
    d = spark.createDataFrame([(1, "u1", True, ["a"], "", ("x",)), (2, "u2", False, None, "y", ("x",)), (3, "u3", True, None, None, ("y",))], "seq int, url string, success boolean, tags array<string>, kind string, data struct<kind: string>")
    got = batch.run_steps(d, [lambda x: batch.step_filter(x, "kind", "y"), lambda x: batch.step_tags(x, ["t", "t"]), lambda x: batch.step_top(x, 5)])
    assert [(r.url, r.tags) for r in got.collect()] == [("u3", ["t", "t"])]
    assert [r.url for r in batch.step_filter(d, "kind", "x").collect()] == ["u1"]
    s = history.run_summary(d.withColumn("depth", F.col("seq"))).first()
    assert tuple(s) == (3, 2, 1, 3, False)
    links = '<a href="https://www.google.com/url?q">google</a><a href="https://r.com/1"><h3>First</h3> more</a><a href="https://r.com/1">again</a><a href="https://r.com/2">ab</a><a href="/x">local</a><a class=q href=https://r.com/3>Third one</a>'
    assert [(r.url, r.title) for r in batch.search_results(page(spark, links)).collect()] == [("https://r.com/1", "First"), ("https://r.com/3", "Third one")]


def test_history(spark):
    rows = [(i, f"2024-01-01T00:00:{i % 60:02d}" if i < 55 else None, 1, "save" if i < 55 else None) for i in range(57)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = [r.event_id for r in history.clip_history(e).collect()]
    assert len(kept) == 50 and kept[0] == 54 and kept[-1] == 5
    h = spark.createDataFrame([(f"Clip {i}", f"https://h/{i}", f"2024-01-0{i}T10:00:00", ["tag"] if i == 3 else []) for i in range(1, 6)] + [("bad", "u", "no date", [])], "title string, url string, date string, tags array<string>")
    assert [r.title for r in history.filter_history(h, "", "2024-01-02", "2024-01-03").collect()] == ["Clip 2", "Clip 3"]
    assert [r.title for r in history.filter_history(h, "TAG").collect()] == ["Clip 3"] and history.filter_history(h, "bad").count() == 1
    assert [r.tag_key for r in history.tag_prefix(e, "SA").collect()] == ["save"] and history.tag_prefix(e, "x").count() == 0


def test_streams_are_their_batch_twins(spark, tmp_path):
    src = str(tmp_path / "events")
    e = spark.createDataFrame([(i, "A" if i % 3 else "b", f"https://h/{i % 4}/?utm_source={i}") for i in range(40)], "event_id long, event_type string, url string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60)).withColumn("user_id", F.lit(1))
    e.repartition(3).write.parquet(src)
    stream = tables.stream_table(spark, src, e.schema, 1)
    q = counts.tag_usage_stream(stream).writeStream.format("memory").queryName("usage").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("usage").collect()} == {tuple(r) for r in history.tag_usage(e).collect()}
    q = counts.dedupe_stream(stream, "ts").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.norm_url for r in spark.table("once").collect()) == [f"https://h/{i}" for i in range(4)]
    out = str(tmp_path / "kept")
    q = counts.keep_history(stream, out, 5).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/2").collect()) == [35, 36, 37, 38, 39]
