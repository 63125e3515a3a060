"""Queries over the HTML of ``pages`` that need the element tree: cleaning, links, whole-page extraction, selectors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import cleaning as C
from weftline.operators.dom import postprocess, to_markdown
from weftline.plans.texts import bm25
from weftline.session import table


def _pages(s, d):
    return table(s, d, "pages").where("html is not null")


def _per(s, d, name, fn, kind):
    return C.per_page(_pages(s, d), "page_id", "url", "html", name, fn, kind)


def page_light_markdown(s, d):
    """Markdown of each page after the light cleaning, addresses absolute."""
    return C.pages(_pages(s, d), "page_id", "url", "html", ("markdown", "content_hash"))


def page_main_html(s, d):
    """HTML and Markdown of each page's main content."""
    kind = pa.struct([("html", pa.string()), ("markdown", pa.string())])

    def made(root, base):
        main = C.absolute(C.main_content(root), base)
        return {"html": C.to_html(main), "markdown": postprocess(to_markdown(main))}

    return _per(s, d, "main", made, kind).select("page_id", "main.html", "main.markdown")


def page_filtered(s, d):
    """What two selectors include once a third is left out."""
    return _per(s, d, "markdown", lambda root, base: postprocess(to_markdown(C.filtered(root, ("article p", "#content p"), ("blockquote",)))), pa.string())


def page_all_links(s, d):
    return _per(s, d, "links", C.all_links, pa.list_(pa.string())).select("page_id", F.explode("links").alias("link"))


def page_link_details(s, d):
    return _per(s, d, "links", C.link_details, pa.list_(C.LINK_T)).select("page_id", F.posexplode("links").alias("n", "l")).select("page_id", "n", "l.*")


def page_map_links(s, d):
    return _per(s, d, "links", C.map_links, pa.list_(C.MAP_T)).select("page_id", F.posexplode("links").alias("n", "l")).select("page_id", "n", "l.*")


def page_frameworks(s, d):
    f = _per(s, d, "framework", lambda root, base: C.framework(root), pa.string())
    return f.groupBy(F.coalesce("framework", F.lit("none")).alias("framework")).agg(F.count("*").alias("pages"))


def page_query_text(s, d):
    return _per(s, d, "query", lambda root, base: C.page_query(root), pa.string())


def page_structured(s, d):
    """Linked data, Open Graph, Twitter cards and meta tags as JSON."""
    return C.pages(_pages(s, d), "page_id", "url", "html", ("structured_data",))


def page_fit_markdown(s, d):
    return C.pages(_pages(s, d), "page_id", "url", "html", ("fit_markdown",))


def page_extract(s, d):
    """Everything that is known of a page, in one pass over its source."""
    return C.pages(_pages(s, d), "page_id", "url", "html", tuple(C.PAGE_T))


def page_named_selectors(s, d):
    """Named CSS and XPath selectors in one pass."""
    names = {"headline": "h1", "paths": "//p/a", "link": "nav a@href", "cells": "//table//td/text()", "first": "//ul/li[1]"}
    kind = pa.map_(pa.string(), pa.list_(pa.string()))
    x = _per(s, d, "found", lambda root, base: list(C.named(root, names).items()), kind)
    return x.select("page_id", F.explode("found").alias("name", "found")).select("page_id", "name", F.array_join("found", "|").alias("found"))


def page_headlines_xpath(s, d):
    """Texts of first-level headings by XPath."""
    x = _per(s, d, "found", lambda root, base: C.xpath(root, "//h1/text()"), pa.list_(pa.string()))
    return x.select("page_id", F.array_join("found", " ").alias("headline")).where("headline <> ''")


def page_table_counts(s, d):
    """Tables and header cells of each page."""
    def count(root, base):
        tags = [n.tag for n in root.walk()]
        return {"tables": tags.count("table"), "headers": tags.count("th")}

    x = _per(s, d, "c", count, pa.struct([("tables", pa.int32()), ("headers", pa.int32())]))
    return x.select("page_id", "c.tables", "c.headers")


def page_bm25(s, d):
    """BM25 of each page's HTML blocks for what the page says it is about."""
    kind = pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))
    b = _per(s, d, "b", lambda root, base: [{"tag": n.tag, "text": C.joined(n)} for n in C.text_blocks(root)], kind)
    b = b.select("page_id", F.posexplode("b").alias("block", "b")).select("page_id", "block", "b.tag", "b.text")
    q = page_query_text(s, d).select("page_id", F.explode(T.tokens("query")).alias("term")).groupBy("page_id", "term").agg(F.count("*").alias("times"))
    return bm25(b, q)


QUERIES = {f.__name__: f for f in (
    page_light_markdown, page_main_html, page_filtered, page_all_links, page_link_details, page_map_links, page_frameworks, page_query_text, page_structured,
    page_fit_markdown, page_extract, page_named_selectors, page_headlines_xpath, page_table_counts, page_bm25,
)}

SQL = {
    "page_frameworks": """select case when regexp_matches(html, 'class="[^"]*gitbook') then 'gitbook' else 'none' end as framework, count(*) as pages from pages where html is not null group by 1""",
    "page_headlines_xpath": r"""with x as (select page_id, regexp_extract_all(html, '(?is)<h1\b[^>]*>([^<]*)</h1>', 1) as h from pages where html is not null),
        y as (select page_id, array_to_string(list_filter(list_transform(h, lambda z: trim(replace(replace(replace(replace(replace(z, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'))), lambda z: z <> ''), ' ') as headline from x)
        select page_id, headline from y where headline <> ''""",
    "page_table_counts": r"""select page_id, len(regexp_extract_all(html, '(?i)<table\b'))::int as tables, len(regexp_extract_all(html, '(?i)<th[\s>]'))::int as headers from pages where html is not null""",
}
