"""What the findings of round 4 asked for."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import SparkSession

from pagemill.functions.elements import Walk
from pagemill.operators import html, records, sites
from pagemill.operators.structure import El, Pick, collect_hits, page_hits, page_structure
from tests.test_findings_r03 import pages_of, plan_of, same_as_sql


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()


def test_all_visible_paragraphs(spark, tmp_path):
    """a page's paragraphs after the 20th, and after the first one in the query, were left out."""
    long = [f"{i} is a paragraph that is longer than fifty characters, you see" for i in range(50)]
    rows = html.visible_content(pages_of(spark, "".join(f"<p>{t}</p><p>short</p>" for t in long), "<p>short</p>")).collect()
    assert [r.text for r in rows] == ["\n\n".join(long)]
    docs = [(1, "en", " ".join(f"w{chr(97 + i % 26)}x" for i in range(300)) + " theend"), (2, "en", "few words"), (3, "en", None), (4, "de", " ".join(["abcdefghijkl"] * 30))]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sum("theend, after all." in r for r in same_as_sql(spark, tmp_path, "h17_visible_content")) == 1


def test_pages_are_walked_once(spark):
    """every token cost a copy of the whole state of the walk, and every element met every alternative in expressions; now
    hits are found in one walk, which is called once a page, and rows are sorted for what needs it only."""
    story, article = (plan_of(f(pages_of(spark, "<p>a"))) for f in (records.story_listing, sites.encyclopedia_pages))
    assert "sort_array(" not in story and [p.count("EvalPython") for p in (story, article)] == [1, 1]
    assert article.count("Sort [") < 5


def test_walk_of_large_and_broken_pages():
    """time grows with a page, deep or broken, and not with its square; elements that overlap end where they did."""
    walk = Walk()
    part = "<div><p>a<p>b<b>d</div></b><br><tr><td x=1>é"

    def seconds(n: int) -> float:
        start = time.process_time()
        assert len(walk(part * n)[1]) == 7 * n
        return time.process_time() - start

    seconds(2_000)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.01)
    text, elements = walk("<b>1<i>2</b>3</i>4<u>5")
    assert [(e[6], e[0], e[1], e[2], text[e[12] : e[12] + e[13]]) for e in elements] == [("b", 0, 4, None, b"12"), ("i", 2, 6, 0, b"23"), ("u", 8, 9, None, b"5")]


def test_hits_of_a_structure_and_of_pages_agree(spark):
    """hits found in the walk are those of the page's structure; an element owns none of what overlaps it from before."""
    page = pages_of(spark, "<div class=s><a href='x y'>1</a><div class=s><q><a>2</a></q></div><a>&lt; 3</a></div><a>4</a><ul class='s t'><li id=k>5<li>6</ul>" * 30, "", None)
    fields = [Pick("link", El("a", inside=El("div", cls="s"))), Pick("href", El("a"), "href"), Pick("child", El("a", under=El("q"))), Pick("key", El(id="k"), "raw"), Pick("any", El(attr="href", op="begins", value="x"), "none")]
    scopes = {"s": El(cls="s"), "t": El("ul", any_cls=("t", "u"))}
    rows = [sorted(map(str, f.collect())) for f in (page_hits(page, fields, scopes), collect_hits(page_structure(page), fields, scopes))]
    assert rows[0] == rows[1] and len(rows[0]) == 30 * (3 + 4 + 1 + 1 + 1 + 4)
