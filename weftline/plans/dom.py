"""Queries on the element tree of ``pages.html``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import dom as D
from weftline.session import table


def _p(s, d):
    return table(s, d, "pages").where("html is not null")


def html_markdown(s, d):
    return D.markdown(_p(s, d), "page_id", "html")


def html_tables(s, d):
    """Rows of data tables."""
    x = D.tables(_p(s, d), "page_id", "html").select("page_id", F.posexplode("tables").alias("table_no", "t"))
    return x.select("page_id", "table_no", F.col("t.headers").alias("headers"), F.posexplode("t.rows").alias("row_no", "cells"))


def html_table_counts(s, d):
    x = D.tables(_p(s, d), "page_id", "html")
    return x.select("page_id", F.size("tables").alias("tables"), F.aggregate("tables", F.lit(0), lambda a, t: a + F.size(t["rows"])).alias("rows"))


def html_select(s, d):
    return D.selected(_p(s, d), "page_id", "html", "main h1, article h1, #content h1").select("page_id", F.explode("found").alias("headline"))


def html_link_targets(s, d):
    return D.selected(_p(s, d), "page_id", "html", "a[href^=http]", "href").select("page_id", F.size("found").alias("absolute_links"))


def html_products(s, d):
    """Product data of pages made of each part, as JSON-LD."""
    p = table(s, d, "part")
    offer = F.struct(F.col("p_retailprice").alias("price"), F.lit("EUR").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"))
    ld = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("sku"), offer.alias("offers")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), ld, F.lit("</script></head><body></body></html>"))
    x = D.products(p.select("p_partkey", html.alias("html")), "p_partkey", "html")
    return x.select("p_partkey", "product.name", "product.brand", "product.sku", F.col("product.price").cast("double").alias("price"), "product.currency", "product.availability")


def html_images(s, d):
    p = table(s, d, "part")
    html = F.format_string('<img src="/i/%d.png" alt="%s" srcset="/i/%d.png 1x, /i/%d@2.png 2x">', "p_partkey", "p_name", "p_partkey", "p_partkey")
    x = D.images(p.select("p_partkey", html.alias("html")), "p_partkey", "html").select("p_partkey", F.explode("images").alias("i"))
    return x.select("p_partkey", "i.src", "i.alt", F.size("i.srcset").alias("sizes"))


def html_blocks(s, d):
    return D.pruned_blocks(_p(s, d), "page_id", "html").select("page_id", F.explode("blocks").alias("b")).select("page_id", "b.*")


QUERIES = {f.__name__: f for f in (html_markdown, html_tables, html_table_counts, html_select, html_link_targets, html_products, html_images, html_blocks)}
SQL = {
    "html_products": """select p_partkey, p_name as name, p_brand as brand, p_partkey::varchar as sku, p_retailprice as price, 'EUR' as currency, 'InStock' as availability from part""",
    "html_images": "select p_partkey, '/i/' || p_partkey || '.png' as src, p_name as alt, 2::int as sizes from part",
    "html_link_targets": r"""select page_id, len(list_filter(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"(http[^"]*)"', 1), lambda x: true))::int as absolute_links from pages where html is not null""",
    "html_table_counts": r"""with t as (select page_id, regexp_extract_all(html, '(?is)<table>.*?</table>') as t from pages where html is not null),
        c as (select page_id, list_transform(t, lambda x: len(regexp_extract_all(x, '(?i)<tr>'))) as n from t)
        select page_id, len(n)::int as tables, coalesce(list_sum(list_transform(n, lambda x: x - 1)), 0)::int as rows from c""",
}
