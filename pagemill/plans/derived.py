"""Richer pages than the page store has, made by Spark from `documents`: one article page per document, its fields taken
from the words of its text. What the page operators should find in them is known from the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOSTS = ["blog.example.com", "www.example.org", "news.example.net", "docs.sample.dev", "shop.sample.com", "example.com"]


def article_pages(docs: DataFrame) -> DataFrame:
    """(page_id, url, html)."""
    d = docs.where("doc_id is not null").select("doc_id", "lang", "text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("word"))
    run = lambda a, n: F.array_join(F.slice("w", a + 1, n), " ")
    n = F.col("doc_id")
    host = F.get(F.array(*[F.lit(h) for h in HOSTS]), F.pmod(n, F.lit(len(HOSTS))).cast("int"))
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    date = F.format_string("2024-%02d-%02d", F.pmod(n, F.lit(12)) + 1, F.pmod(n, F.lit(28)) + 1)
    author: Column = F.when(n % 3 == 0, s('{"@type":"Person","name":"', w(7), '"}')).when(n % 3 == 1, s('"', w(7), '"')).otherwise(s('["', w(7), '",{"name":"', w(8), '"}]'))
    node = s('{"@type":["BlogPosting"],"headline":"', w(0), " ", w(1), '","author":', author, ',"datePublished":"', date, '","keywords":"', w(11), ", ", w(12), ",", w(11), '","wordCount":', F.size("w").cast("string"), "}")
    jsonld = s('{"@context":"https://schema.org","@graph":[{"@type":"WebPage","name":"', w(3), '"},', node, "]}")
    html = s(
        '<!DOCTYPE html><html lang="', F.coalesce("lang", F.lit("xx")), '"><head><meta charset="utf-8"><title>', w(0), " ", w(1), " &amp; ", w(2), " - GitHub</title><!-- <meta name=\"author\" content=\"nobody\"> -->",
        '<meta name="description" content="', w(4), "  ", w(5), " &quot;", w(6), "&quot;\"><meta name='author' content='", w(7), " ", w(8), "'>",
        '<meta property="article:published_time" content="', date, 'T08:00:00Z">', F.when(n % 2 == 0, s('<link rel="canonical" href="../posts/./', n.cast("string"), '">')).otherwise(""),
        '<meta property="og:title" content="', w(0), " ", w(1), '"><meta property="og:type" content="article"><meta content="/p/', n.cast("string"), '" property="og:url">',
        '<meta property="og:image" content="//cdn.example.com/1.png"><meta property="og:image" content="b.png"><meta property="og:image" content="//cdn.example.com/1.png">',
        F.when(n % 4 == 1, s('<meta property="og:site_name" content="Site ', w(9), '">')).otherwise(""), '<meta name="twitter:site" content="@', w(10), '"><meta name="twitter:title" content="', w(1), " ", w(0), '">',
        '<meta name="keywords" content="', w(11), ", ", w(12), " ,", w(11), '"><meta property="article:tag" content="', w(13), '"><meta name=news_keywords content="x1,', w(12), '">',
        '<script type="application/ld+json">', F.when(n % 5 == 0, s("<!--", jsonld, "-->")).when(n % 5 == 1, s("[", jsonld, "]")).otherwise(jsonld), '</script><script type="application/ld+json">{bad</script>',
        '<script>var x = "<p>no text</p>";</script></head><body><header><a href="/">Home</a></header><nav><ul><li><a href="../up/./x">Up</a><li><a href=\'?q=1#f\'>Query</a></ul></nav>',
        '<article class="post full"><h1>', w(0), " &lt;", w(1), "&gt;</h1><p>", run(14, 30), " It is said again and again, <strong>", w(2), "</strong> and <em>", w(3), "</em> in <code>", w(4), '</code> at <a href="https://example.org/x?a=1&amp;b=', w(5), '">', w(6), "</a>.<p>",
        F.array_join(F.slice("w", F.lit(45), F.greatest(F.size("w"), F.lit(1))), " "), ', after all.</p><div class="ad"><p>Buy now, subscribe to premium</p></div><h2>Lists</h2><ul><li>', w(7), "</li><li>", w(8), "<ol><li>", w(9), "</li><li>", w(10), '</li></ol></li></ul><blockquote><p>', run(20, 5),
        '</p></blockquote><pre><code class="language-py">def ', w(11), "(x):\n    return x &lt; 1</code></pre><table><tr><th>", w(12), "</th><th>n|o</th></tr><tr><td>", w(13), "</td><td>", F.size("w").cast("string"), "</td></tr></table>",
        '<img src="/img/', n.cast("string"), '.png" alt="', w(0), '"></article><aside class="sidebar"><p>See also, other pages, and more of them.</p></aside><footer>&copy; &#169; &#xA9; 2024</footer></body></html>',
    )
    return d.select(F.col("doc_id").alias("page_id"), s("https://", host, "/blog/2024/", n.cast("string"), "?utm_source=feed").alias("url"), html.alias("html"))


def site_pages(docs: DataFrame) -> DataFrame:
    """(page_id, url, html): a site with a page per document, but for every 11th; page i links to 2i + 1 and 2i + 2, to the one
    above it, to another site, to a login and to a file."""
    n = F.col("doc_id")
    link = lambda i: F.concat(F.lit('<a href="/p/'), i.cast("string"), F.lit('">on</a>'))
    html = F.concat(F.lit("<html><head><title>Page "), n.cast("string"), F.lit('</title></head><body><a href="/login">in</a><a href="https://other.test/x">out</a>'), link(n * 2 + 1), F.lit("<a href='#top'>top</a>"), link(n * 2 + 2), link(F.greatest(F.floor((n - 1) / 2), F.lit(0))), F.lit('<a href="f.pdf">file</a></body></html>'))
    return docs.where("doc_id is not null and pmod(doc_id, 11) <> 5").groupBy("doc_id").agg(F.lit(1)).select(n.alias("page_id"), F.concat(F.lit("https://www.tree.test/p/"), n.cast("string"), F.lit("/?utm_source=x")).alias("url"), html.alias("html"))


def words_sql(docs: str = "documents") -> str:
    """DuckDB: doc_id, lang and w, the words of each document, with w padded so that w[1] to w[100] exist."""
    return f"SELECT doc_id, lang, len(v) AS n_words, v AS own, v || list_transform(range(100), lambda i: 'word') AS w FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS v FROM {docs} WHERE doc_id IS NOT NULL)"


def question_pages(conversations: DataFrame) -> DataFrame:
    """(page_id, url, html): a question page per conversation, its turns as answers. The turns of one conversation are gathered."""
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0)
    votes = F.pmod(F.col("turn") * 7, F.lit(5)).cast("string")
    vote = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('<div class="js-vote-count" data-value="'), votes, F.lit('">x</div>'))).otherwise(F.concat(F.lit('<div class="js-vote-count"> '), votes, F.lit(" </div>")))
    user = F.when(F.col("role") == "user", F.concat(F.lit('<div class="user-details"><a href="/u">'), "role", F.lit("</a></div>"))).otherwise("")
    cls = F.when(F.col("turn") % 3 == 2, "answer accepted-answer").otherwise("answer")
    block = F.concat(F.lit('<div class="'), cls, F.lit('">'), vote, F.lit('<div class="s-prose"><p>'), word, F.lit("</p><p>&amp; on</p></div>"), user, F.lit('<time datetime="2024-01-0'), F.pmod("turn", F.lit(9)).cast("string"), F.lit('"></time></div>'))
    parts = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    html = F.concat(F.lit('<html><body><h1>Q</h1><div id="answers">'), F.array_join(F.transform(parts, lambda p: p.b), "\n"), F.lit("</div></body></html>"))
    return conversations.groupBy("conv_id").agg(html.alias("html")).select(F.col("conv_id").alias("page_id"), F.concat(F.lit("https://stackoverflow.com/questions/"), F.col("conv_id").cast("string")).alias("url"), "html")


def listing_pages(events: DataFrame) -> DataFrame:
    """(page_id, url, html): listings of 30 stories, one for each event, by event_id."""
    page = F.floor(F.col("event_id") / 30)
    number = F.row_number().over(Window.partitionBy(page).orderBy("event_id"))
    e = events.where("event_id is not null").withColumn("page", page).withColumn("n", number)
    rank = F.when(F.col("n") % 2 == 1, F.concat(F.lit('<span class="rank">'), F.col("n").cast("string"), F.lit(".</span>"))).otherwise("")
    sub = F.when(F.col("n") % 3 == 0, '<td class="subtext">ad</td>').otherwise(F.concat(F.lit('<td class="subtext"><span>'), F.col("n").cast("string"), F.lit(' points</span> by <a class="hnuser" href="user?id=1">u'), F.col("event_id").cast("string"), F.lit("</a> | <a>"), F.col("n").cast("string"), F.lit("&nbsp;comments</a></td>")))
    row = F.concat(F.lit('<tr class="athing submission"><td>'), rank, F.lit('</td><td><span class="titleline"><a href="/s?a=1&amp;i='), F.col("event_id").cast("string"), F.lit('">A '), "event_type", F.lit(" &gt; b</a> <span>(<a href='/from'>x</a>)</span></span></td></tr><tr>"), sub, F.lit("</tr>"))
    parts = F.array_sort(F.collect_list(F.struct("n", row.alias("r"))))
    html = F.concat(F.lit("<html><body><table>"), F.array_join(F.transform(parts, lambda p: p.r), ""), F.lit("</table></body></html>"))
    return e.groupBy("page").agg(html.alias("html")).select(F.col("page").alias("page_id"), F.lit("https://news.ycombinator.com/news").alias("url"), "html")


def recipe_pages(docs: DataFrame) -> DataFrame:
    """(page_id, url, html): a recipe page per document, its JSON-LD made of the text's words."""
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("word"))
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    d = docs.where("doc_id is not null").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    n = F.col("doc_id")
    steps = F.when(n % 3 == 0, s('["', w(3), '","', w(4), '"]')).when(n % 3 == 1, s('[{"@type":"HowToStep","text":"', w(3), '"},{"@type":"HowToSection","name":"s","itemListElement":[{"text":"', w(4), '"},{"name":"', w(5), '"}]}]')).otherwise(s('"', w(3), '"'))
    node = s('{"@context":"https://schema.org","@type":"Recipe","name":"', w(0), " ", w(1), '","recipeIngredient":["', w(2), '"," ","', w(3), '"],"recipeInstructions":', steps, ',"cookTime":"PT', F.pmod(n, F.lit(3)).cast("string"), 'H20M","recipeYield":["4","4 servings"],"aggregateRating":{"ratingValue":4.5}}')
    html = s('<html><head><script type="application/ld+json">{"@type":"WebSite","name":"x"}</script><script type="application/ld+json">', node, "</script></head><body></body></html>")
    return d.select(n.alias("page_id"), F.concat(F.lit("https://a.com/recipes/"), n.cast("string")).alias("url"), html.alias("html"))
