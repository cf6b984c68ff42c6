"""Registered queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import scoring, web
from riskloom.plans import sql as q
from riskloom.plans.registry import query
from riskloom.plans.scoring_queries import _scored, column_scorers
from riskloom.plans.views import Lake


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _unescape(x: str) -> str:
    for entity, char in web.ENTITIES:
        x = f"replace({x}, '{entity}', {_quoted(char)})"
    return x


def _visible(html: str, noise) -> str:
    kept = f"regexp_replace({html}, {_quoted(web.noise_pattern(noise))}, '', 'g')"
    piece = q.strip(_unescape("p"))
    return f"array_to_string(list_filter(list_transform(string_split_regex({kept}, {_quoted(web.TAG)}), lambda p: {piece}), lambda p: p <> ''), chr(10))"


_TITLE = q.strip(_unescape(f"regexp_extract_all(html, {_quoted(web.TITLE)}, 1)[1]"))


@query("page_texts", "H1 S8", f"SELECT page_id, url, coalesce({_TITLE}, '') AS title, {_visible('html', web.PAGE_NOISE)} AS text FROM pages")
def page_texts(lake: Lake):
    return web.page_texts(lake.spread("pages", "page_id"))


_PARTS = """lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"""


@query("page_links", "H2", f"""
    SELECT page_id, pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN {_PARTS} || href END AS link
    FROM (SELECT page_id, url, unnest(range(len(h))) AS pos, {_unescape("trim(unnest(h), '\"''')")} AS href FROM (
        SELECT page_id, url, regexp_extract_all(regexp_replace(html, {_quoted(web.noise_pattern(('script', 'style')))}, '', 'g'), {_quoted(web.ANCHOR)}, 1) AS h FROM pages))""")
def page_links(lake: Lake):
    return web.page_links(lake.table("pages"))


@query("page_articles", "H3 H4 F8 F9", f"""
    SELECT page_id, 'url:' || url || ':' || substr(sha1(title || chr(10) || text), 1, 16) AS external_id, url AS source, title, text, url FROM (
        SELECT page_id, url, coalesce({_TITLE}, url) AS title, {_visible('html', web.LINK_NOISE)} AS text FROM pages)""")
def page_articles(lake: Lake):
    return web.articles(lake.spread("pages", "page_id"))


# The given pages link only from their navigation; the same links placed in the page body exercise the article path.
_SEGMENTS = ["news", "tag"]


def _linked_pages(lake: Lake):
    """Pages whose body links to other pages: one article per document of the same number, one tag page, one copy with a query."""
    pages = lake.table("pages").select("page_id", "url")
    root = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1))
    slug = F.col("page_id").cast("string")
    link = lambda path, label: F.concat(F.lit('<a href="'), path, F.lit('">'), label, F.lit("</a>"))
    html = F.concat(
        F.lit("<html><body><nav>"), link(F.concat(F.lit("/news/nav-"), slug), F.lit("navigation link")), F.lit("</nav><main><h2>"),
        link(F.concat(F.lit("/news/story-"), slug), F.concat(F.lit("Story number "), slug)), F.lit("</h2><p>First part of "), slug, F.lit(" here.</p>"),
        link(F.concat(root, F.lit("/news/story-"), slug, F.lit("/?copy=1#top")), F.lit("Story number again")),
        link(F.lit("/tag/some/topic"), F.lit("A topic page")), link(F.lit("https://elsewhere.example.net/news/story"), F.lit("Another host")),
        link(F.lit("/short"), F.lit("One segment only")),
        F.lit("<h3>Long heading "), slug, F.lit(" "), link(F.concat(F.lit("/blog/b-"), slug), F.lit("more")), F.lit("</h3><p>Second &amp; last.</p></main></body></html>"))
    return pages.select("page_id", "url", html.alias("html"))


_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"


@query("linked_articles", "H3 F8 F9", f"""
    SELECT page_id, 'url:' || substr(sha1(canonical), 1, 24) AS external_id, url AS source, title, title || chr(10) || chr(10) || snippet AS text, canonical AS url FROM (
        SELECT page_id, url, {_ROOT} || '/news/story-' || page_id AS canonical, 'Story number ' || page_id AS title, 'First part of' || ' ' || page_id || ' here.' AS snippet FROM pages
        UNION ALL SELECT page_id, url, {_ROOT} || '/blog/b-' || page_id, 'Long heading ' || page_id || 'more', 'Second & last.' FROM pages)""")
def linked_articles(lake: Lake):
    return web.articles(_linked_pages(lake))


_WORDS = ["the", "que", "und", "Zebra"]


@query("page_checks", "H5 J9", f"""
    WITH texts AS (SELECT page_id, url, coalesce({_TITLE}, '') AS title, {_visible('html', web.PAGE_NOISE)} AS text FROM pages),
    {_scored('texts', 'page_id', 'text')}
    SELECT page_id, t.url, CASE WHEN text <> '' THEN title END AS title, CASE WHEN text = '' THEN 'empty' ELSE 'checked' END AS status,
           CASE WHEN text <> '' THEN {q.rnd('mean')} END AS threat_score, CASE WHEN text <> '' THEN {q.level('mean')} END AS threat_level,
           CASE WHEN text <> '' THEN array_to_string(list_filter(['the', 'que', 'und', 'Zebra'], lambda k: contains(lower(text), lower(k))), '|') END AS keyword_matches
    FROM texts t LEFT JOIN models m USING (page_id)""")
def page_checks(lake: Lake):
    out = web.check_pages(lake.spread("pages", "page_id"), column_scorers(), _WORDS)
    return out.withColumn("keyword_matches", F.array_join("keyword_matches", "|"))


@query("chunk_counts", "A14", f"SELECT doc_id, (length({q.strip('text')}) + 3999) // 4000 AS chunks FROM documents")
def chunk_counts(lake: Lake):
    return lake.spread().select("doc_id", F.size(scoring.chunks(F.col("text"))).cast("long").alias("chunks"))
