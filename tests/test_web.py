"""Web page operators on literal pages."""

import hashlib

import pytest

from riskloom.operators import web
from riskloom.operators.scoring import ColumnScorer
from pyspark.sql import functions as F

HTML = """<html><head><title> My &amp; page </title><style>p{}</style><script>var x = "</p><a href='/no/no'>";</script></head>
<body><nav><a href="/news/in-nav">Navigation story</a></nav><header>Top line</header>
<article><h2><a href="/news/slug-one">First long story</a></h2><p>Lead  text <b>bold</b></p></article>
<article><a href="/news/slug-one?q=1">First long story again</a><h3>Heading for two <a href="two/part">go</a></h3><p>Second</p>
<a href="https://other.example/news/story">Elsewhere story</a><a href="/tag/x/y">Tagged long story</a><a href="/single">One segment story</a>
<a href="/news/short">tiny</a><a href="mailto:a@b.c">Mail address link</a><a href="/blog/last/">No paragraph follows</a></article>
<!-- <a href="/news/comment">Commented story</a> --><aside><a href="/news/aside">Aside long story</a></aside><footer>End</footer></body></html>"""
PLAIN = "<html><body><nav>menu</nav><p>Only a &lt;text&gt;</p>\n<p> here </p></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://h.example/a/index", HTML), (2, "https://h.example/plain", PLAIN), (3, "https://h.example/none", "<nav>only</nav>"), (4, "https://h.example/null", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_visible_text(pages):
    rows = {r["page_id"]: r for r in web.page_texts(pages).collect()}
    assert rows[1]["title"] == "My & page"
    assert rows[1]["text"].split("\n")[:3] == ["My & page", "First long story", "Lead  text"]
    assert "Top line" not in rows[1]["text"] and "Commented" not in rows[1]["text"] and "var x" not in rows[1]["text"]
    assert rows[2]["text"] == "Only a <text>\nhere" and rows[2]["title"] == ""


def test_links(pages):
    links = [r["link"] for r in web.page_links(pages).where("page_id = 1").orderBy("pos").collect()]
    assert links[0] == "https://h.example/news/in-nav" and "https://h.example/a/two/part" in links
    assert not any("comment" in x or "no/no" in x or x.startswith("mailto") for x in links)


def test_articles(pages):
    rows = {r["url"]: r for r in web.articles(pages).where("page_id = 1").collect()}
    assert set(rows) == {"https://h.example/news/slug-one", "https://h.example/a/two/part", "https://h.example/blog/last"}
    first = rows["https://h.example/news/slug-one"]
    assert first["text"] == "First long story\n\nLead  textbold"
    assert first["external_id"] == "url:" + hashlib.sha1(b"https://h.example/news/slug-one").hexdigest()[:24]
    assert rows["https://h.example/a/two/part"]["title"] == "Heading for twogo"  # short link text, so the heading counts
    assert rows["https://h.example/blog/last"]["text"] == "No paragraph follows"


def test_article_limit(pages):
    assert web.articles(pages, limit=1).where("page_id = 1").first()["url"] == "https://h.example/news/slug-one"


def test_pages_without_articles_become_items(pages):
    row = web.articles(pages).where("page_id = 2").first()
    mark = hashlib.sha1("https://h.example/plain\nOnly a <text>\nhere".encode()).hexdigest()[:16]
    assert row["external_id"] == f"url:https://h.example/plain:{mark}" and row["text"] == "Only a <text>\nhere"


def test_page_checks(pages):
    scorer = ColumnScorer("s", {"toxic": lambda c: F.lit(0.7)})
    rows = {r["page_id"]: r for r in web.check_pages(pages, [scorer], ["LEAD", "absent"]).collect()}
    assert rows[1]["status"] == "checked" and rows[1]["keyword_matches"] == ["LEAD"] and rows[1]["threat_level"] == "high"
    assert rows[3]["status"] == "empty" and rows[3]["threat_score"] is None
    assert rows[4]["status"] == "error" and rows[4]["keyword_matches"] is None


def test_element_names_are_matched_whole(spark):
    html = "<body><nav-item>keep</nav-item><p>ok</p><nav class='x'>n</nav><p>z</p><nav>m</nav></body>"
    row = web.page_texts(spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")).first()
    assert row["text"].split("\n") == ["keep", "ok", "z"]


def test_articles_need_no_shuffle(pages):
    assert "Exchange" not in web.articles(pages)._jdf.queryExecution().executedPlan().toString().replace("InMemoryTableScan", "")


def test_nothing_is_cut_unless_asked(spark):
    links = "".join(f'<h2><a href="/news/story-{i}">{"Long title " * 40}{i}</a></h2><p>{"word " * 200}{i}</p>' for i in range(60))
    pages = spark.createDataFrame([(1, "https://h.example/", f"<main>{links}</main>"), (2, "https://h.example/p", "<p>" + "x" * 900 + "</p>"),
                                   (3, "https://h.example/p", "<p>" + "x" * 900 + "y</p>")], "page_id long, url string, html string")
    rows = web.articles(pages).collect()
    assert len([r for r in rows if r["page_id"] == 1]) == 60
    assert all(r["title"].startswith("Long title " * 40) and r["text"].endswith("word " + r["url"].rsplit("-", 1)[1]) for r in rows if r["page_id"] == 1)
    assert len({r["external_id"] for r in rows if r["page_id"] > 1}) == 2
    short = web.articles(pages, limit=25, title_chars=300, paragraph_chars=400, fingerprint_chars=500).collect()
    assert len([r for r in short if r["page_id"] == 1]) == 25 and len({r["external_id"] for r in short if r["page_id"] > 1}) == 1
    assert all(len(r["title"]) == 300 for r in short if r["page_id"] == 1)
