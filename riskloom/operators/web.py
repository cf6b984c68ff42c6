"""Operators over landed web pages (page_id, url, html)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.fixed_values import NON_ARTICLE_PREFIXES
from riskloom.functions.arrays import first_of_runs, let
from riskloom.functions.text import strip
from riskloom.functions.urls import article_id, canonical_url, page_id, path_segments, resolve_link, url_parts
from riskloom.operators.monitor import contained_keywords
from riskloom.operators.scoring import classify

PAGE_NOISE = ("script", "style", "nav", "footer", "header")
LINK_NOISE = ("script", "style", "nav", "footer", "aside")
CONTAINERS = ("article", "main", "section")
HEADINGS = ("h1", "h2", "h3", "h4")

TAG = r"""</?[A-Za-z!?][^"'>]*(?:(?:"[^"]*"|'[^']*')[^"'>]*)*>"""
ANCHOR = r"""(?is)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def noise_pattern(names: tuple[str, ...]) -> str:
    """Comments and whole elements, matched left to right in one pass."""
    return "(?is)<!--.*?-->|" + "|".join(rf"<{n}(?:[\s/][^>]*)?>.*?</{n}\s*>" for n in names)


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def visible_text(html: Column, noise: tuple[str, ...] = PAGE_NOISE) -> Column:
    """Text pieces between tags, trimmed, one per line."""
    kept = F.regexp_replace(html, noise_pattern(noise), "")
    pieces = F.transform(F.split(kept, TAG), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), "\n")


def page_title(html: Column) -> Column:
    """Text of the first title element; null without one."""
    found = F.regexp_extract_all(html, F.lit(TITLE), F.lit(1))
    return strip(unescape(F.get(found, F.lit(0))))


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", "url", F.coalesce(page_title(F.col("html")), F.lit("")).alias("title"), visible_text(F.col("html")).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): every absolute http link in document order."""
    live = F.regexp_replace("html", noise_pattern(("script", "style")), "")
    hrefs = F.regexp_extract_all(live, F.lit(ANCHOR), F.lit(1))
    bare = F.transform(hrefs, lambda h: unescape(F.regexp_replace(h, "^[\"']|[\"']$", "")))
    found = pages.select("page_id", "url", F.posexplode_outer(bare).alias("pos", "href")).where(F.col("pos").isNotNull())
    return found.withColumn("link", resolve_link(F.col("url"), F.col("href"))).where(F.col("link").startswith("http")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "link")


class _LinkParser(HTMLParser):
    """Collects links with their text, heading ancestor and following paragraph."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None]] = []
        self.links: list[dict] = []
        self.waiting: list[dict] = []
        self.hidden = self.inside = 0
        self.headings: list[dict] = []
        self.texts: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        node = None
        if not self.hidden and (tag == "a" or tag == "p" or tag in HEADINGS):
            node = {"text": []}
            self.texts.append(node["text"])
            href = dict(attrs).get("href") if tag == "a" else None
            if href is not None:
                heading = self.headings[-1] if self.headings else None
                node.update(href=href.strip(), inside=self.inside > 0, heading=heading, paragraph=None)
                self.links.append(node)
                self.waiting.append(node)
            elif tag == "p":
                for link in self.waiting:
                    link["paragraph"] = node
                self.waiting = []
            elif tag in HEADINGS:
                self.headings.append(node)
        self.hidden += tag in LINK_NOISE
        self.inside += tag in CONTAINERS
        self.open.append((tag, node))

    def handle_endtag(self, tag):
        if not any(name == tag for name, _ in self.open):
            return
        while True:
            name, node = self.open.pop()
            self.hidden -= name in LINK_NOISE
            self.inside -= name in CONTAINERS
            if node is not None:
                self.texts.pop()
                if name in HEADINGS:
                    self.headings.pop()
            if name == tag:
                return

    def handle_data(self, data):
        if self.texts and not self.hidden:
            piece = data.strip()
            if piece:
                for text in self.texts:
                    text.append(piece)


def _page_links(html: str | None) -> list[dict]:
    """Links inside article containers (all links where a page has none), with nesting-aware texts."""
    parser = _LinkParser()
    parser.feed(html or "")
    parser.close()
    only_inside = any(link["inside"] for link in parser.links)
    rows = []
    for pos, link in enumerate(parser.links):
        if link["href"] and (link["inside"] or not only_inside):
            texts = ["".join(n["text"]) if n else "" for n in (link, link["heading"], link["paragraph"])]
            rows.append(dict(zip(("pos", "href", "link_text", "heading", "paragraph"), (pos, link["href"], *texts))))
    return rows


def _link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(links=[_page_links(html) for html in batch["html"]])


def with_links(pages: DataFrame) -> DataFrame:
    """Pages with the array of their candidate links in document order."""
    links = "array<struct<pos: long, href: string, link_text: string, heading: string, paragraph: string>>"
    types = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url", "html").schema}
    schema = ", ".join(f"{name} {kind}" for name, kind in types.items()) + f", links {links}"
    return pages.select("page_id", "url", "html").mapInPandas(_link_batches, schema)


def article_links(links: Column, url: Column, limit: int | None = None) -> Column:
    """Links that lead to articles of the same host, first sighting per canonical address; all, or the first ``limit``."""
    _, home, _ = url_parts(url)

    def shape(link: Column) -> Column:
        return let(resolve_link(url, link["href"]), lambda full: F.struct(
            canonical_url(full).alias("canonical"), link["pos"].alias("pos"), full.alias("full"), link["link_text"].alias("link_text"),
            link["heading"].alias("heading"), link["paragraph"].alias("paragraph")))

    def leads(link: Column) -> Column:
        scheme, host, path = url_parts(link["full"])
        skipped = F.lit(False)
        for prefix in NON_ARTICLE_PREFIXES:
            skipped = skipped | F.lower(path).startswith(prefix)
        return (scheme.isin("http", "https") & (host == home) & (link["canonical"] != F.regexp_replace(url, "/+$", ""))
                & (F.size(path_segments(path)) >= 2) & ~skipped)

    def titled(link: Column) -> Column:
        title = F.when(F.length(link["link_text"]) >= 8, link["link_text"]).when(F.length(link["heading"]) >= 8, link["heading"])
        return F.struct(link["pos"].alias("pos"), link["canonical"].alias("canonical"), title.alias("full_title"), link["paragraph"].alias("paragraph"))

    kept = F.filter(F.transform(links, shape), leads)
    first = F.transform(first_of_runs(kept, "canonical"), titled)
    ordered = F.sort_array(F.filter(first, lambda x: x["full_title"].isNotNull()))
    return ordered if limit is None else F.slice(ordered, 1, limit)


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def articles(pages: DataFrame, limit: int | None = None, title_chars: int | None = None, paragraph_chars: int | None = None,
             fingerprint_chars: int | None = None) -> DataFrame:
    """Article items of each page; a page without any yields itself as one item.

    A page is one row: its links are parsed and chosen inside the row, and nothing
    is shuffled.  All articles are kept with whole titles and paragraphs; the
    arguments cut them for a display (see ``fixed_values``).
    """
    found = article_links(F.col("links"), F.col("url"), limit)
    joined = with_links(pages).select("page_id", F.col("url").alias("source"), "html", F.explode_outer(found).alias("found"))
    snippet = _cut(F.col("found.paragraph"), paragraph_chars)
    full_title, canonical = F.col("found.full_title"), F.col("found.canonical")
    body = F.when(F.length(snippet) > 0, F.concat(full_title, F.lit("\n\n"), snippet)).otherwise(full_title)
    lone = canonical.isNull()
    shaped = joined.select(
        "page_id", "source", canonical.alias("canonical"),
        F.when(lone, F.coalesce(page_title(F.col("html")), F.col("source"))).otherwise(_cut(full_title, title_chars)).alias("title"),
        F.when(lone, visible_text(F.col("html"), LINK_NOISE)).otherwise(strip(body)).alias("text"))
    lone = F.col("canonical").isNull()
    identity = F.when(lone, page_id(F.col("source"), F.col("title"), F.col("text"), fingerprint_chars)).otherwise(article_id(F.col("canonical")))
    return shaped.select("page_id", identity.alias("external_id"), "source", "title", "text", F.coalesce("canonical", "source").alias("url"))


def check_pages(pages: DataFrame, scorers: list, keywords: list[str]) -> DataFrame:
    """Status, score and keyword matches of each page."""
    texts = page_texts(pages)
    scored = classify(texts, "text", scorers)
    words = F.array(*[F.lit(k) for k in keywords]) if keywords else F.array().cast("array<string>")
    status = F.when(F.col("text").isNull(), "error").when(F.col("text") == "", "empty").otherwise("checked")
    done = status == "checked"
    return scored.select(
        "page_id", "url", F.when(done, F.col("title")).alias("title"), status.alias("status"),
        F.when(done, F.col("threat_score")).alias("threat_score"), F.when(done, F.col("threat_level")).alias("threat_level"),
        F.when(done, contained_keywords(F.col("text"), words)).alias("keyword_matches"))
