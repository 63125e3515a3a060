"""Small operators on inputs worked out by hand: robots, site maps, crawl state, monitors, chunks, embedded data."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import text as T
from weftline.operators import graph as G
from weftline.operators.dom import parse, to_markdown
from weftline.sources import documents as D
from weftline.sources import sinks
from weftline.streaming import state as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_robots():
    text = "User-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: *\nAllow: /p/q # c\nDisallow: /p\nDisallow:\nCrawl-delay: 90\nbroken"
    assert D.robots_rules_of(text) == ([(True, "/p/q"), (False, "/p")], 30.0)
    assert D.robots_rules_of(text, "B") == ([(False, "/x")], None) and D.robots_rules_of(None) == ([], None) and D.robots_rules_of("Disallow: /") == ([], None)


def test_robots_table(spark):
    hosts = spark.createDataFrame([("a", "User-agent: *\nDisallow: /p\nAllow: /p/q"), ("b", None)], "host string, robots string")
    urls = spark.createDataFrame([(1, "a", "/p/1"), (2, "a", "/p/q1"), (3, "b", "/p"), (4, "a", "/")], "page_id long, host string, path string")
    assert {r.page_id: r.allowed for r in D.robots_allowed(urls, D.robots_table(hosts), F.col("path")).collect()} == {1: False, 2: True, 3: True, 4: True}


def test_sitemaps(spark):
    sites = spark.createDataFrame(
        [("https://a.example", "Sitemap: https://a.example/i.xml\nsitemap:nothing", "<link href='/own.xml' rel='sitemap'>"), ("https://b.example", None, None)], "site string, robots string, home string"
    )
    got = {(r.site, r.sitemap) for r in D.sitemap_candidates(sites).collect()}
    assert {s for h, s in got if h.endswith("a.example")} == {"https://a.example/i.xml", "https://a.example/own.xml"} and len(got) == 2 + len(D.SITEMAP_PATHS)
    pages = [
        ("https://a.example/i.xml", "<sitemapindex><sitemap><loc>https://a.example/1.xml</loc></sitemap><sitemap><loc> https://a.example/2.xml </loc></sitemap></sitemapindex>"),
        ("https://a.example/1.xml", "<urlset><url><loc>u1</loc><lastmod>2026-01-01</lastmod></url><url><loc>u2</loc></url></urlset>"), ("https://a.example/2.xml", "<urlset><url><loc>u1</loc></url></urlset>"),
        ("https://a.example/own.xml", "<broken"),
    ]
    rows = D.sitemap_walk(D.sitemap_candidates(sites), spark.createDataFrame(pages, "url string, xml string")).collect()
    assert sorted((r.loc, r.lastmod) for r in rows) == [("u1", "2026-01-01"), ("u2", None)]
    assert D.sitemap_walk(D.sitemap_candidates(sites), spark.createDataFrame(pages, "url string, xml string"), depth=0).count() == 0


def test_resumed_crawl_equals_one_run(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f")], "src string, dst string")
    whole = {r.url: r.depth for r in G.breadth_first(edges, spark.createDataFrame([("a",)], "url string"), 4).collect()}
    half = G.breadth_first(edges, spark.createDataFrame([("a",)], "url string"), 1)
    wait = spark.createDataFrame([("d", 2)], "url string, depth int")
    G.save_state(half, wait, str(tmp_path))
    visited, frontier = G.load_state(spark, str(tmp_path))
    assert {r.url: r.depth for r in G.resumed(edges, visited, frontier, 4).collect()} == whole
    assert G.frontier_room(visited, frontier, 1) == 16
    found = spark.createDataFrame([("x1", 0), ("y", 1), ("x2", 2)], "url string, pos long")
    got = G.admitted(found, spark.createDataFrame([("y",)], "key string"), F.col("url"), F.lit(True), 9, F.length("url").cast("double"), 2.0)
    assert [r.url for r in got.collect()] == ["x1", "x2"]


def test_monitor_step():
    state, out = S.monitor_step(("", "", None), "one\ntwo\nthree", 200, 0.1, ("hotel",), "any_change")
    assert out == (None, None, "", "")
    assert S.monitor_step(state, "one\ntwo\nthree", 500, 0.1, (), "any_change")[1][0] == "status_changed" and S.monitor_step(state, "one\ntwo\nthree", 500, 0.1, (), "keyword_added")[1][0] is None
    assert S.monitor_step(state, "one\ntwo\nHotel", 200, 0.1, ("hotel",), "keyword_added")[1] == ("content_changed", 0.6667, "hotel", "")
    assert S.monitor_step(state, "one\ntwo\nfour", 200, 0.1, ("hotel",), "keyword_added")[1][0] is None and S.monitor_step(state, "one\ntwo\nfour", 200, 0.5, (), "any_change")[1][0] is None


def test_chunks_merged(spark):
    assert one(spark, T.chunks_merged("t", 4), t="a b\n\nc\n\nd e f g h\n\ni") == ["a b\n\nc", "d e f g h", "i"] and one(spark, T.chunks_merged("t", 40), t=" a \n\nb") == [" a \n\nb"]


def test_embedded(spark):
    h = "<script>AF_initDataCallback({key: 'ds:1', hash: '2', data:[1,{\"a\":2}], sideChannel: {}});</script>AF_initDataCallback({key: 'ds:2', data:[3]});AF_initDataCallback({key: 'ds:2', data:[4]});"
    assert one(spark, H.embedded_blocks("h"), h=h) == {"ds:1": '[1,{"a":2}]', "ds:2": "[4]"}
    assert one(spark, F.to_json(H.embedded_data("h")), h="[1, 2], sideChannel: {}") == "[1,2]" and one(spark, F.to_json(H.embedded_data("h")), h="[1,") is None


def test_captures(spark):
    df = spark.createDataFrame([(1, "xhr", "application/json", "u/api"), (2, "image", "application/json", "u"), (3, "fetch", None, "u"), (4, "fetch", "text/javascript", "u")], "id int, kind string, ct string, url string")
    assert [r.id for r in df.where(H.is_api_response("kind", "ct", "url")).collect()] == [1, 4] and [r.id for r in df.where(H.is_api_response("kind", "ct", "url", "api")).collect()] == [1]
    assert df.where(H.is_console_error("kind")).count() == 0


def test_markdown_of_definitions():
    md = to_markdown(parse("<dl><dt>A</dt><dd>first</dd></dl><p>At <time datetime='2026-01-01'>New Year</time></p><details><summary>More</summary><p>text</p></details>"))
    assert md == "**A**\n\n: first\n\nAt New Year (2026-01-01)\n\n**More**\n\ntext"


@pytest.mark.parametrize("url, name", [("https://a.example/x y?q=1", "a.example_x_y_q_1"), ("https://", "page"), ("http://___", "page"), ("https://a/" + "b" * 200, "a_" + "b" * 118)])
def test_safe_name(spark, url, name):
    assert one(spark, sinks.safe_name(F.col("u")), u=url) == name


def test_archives(spark):
    import io
    import json
    import zipfile

    df = spark.createDataFrame([(f"{k}_p", None if k == 1 else f"t{k}", "<p>" if k else None, '{"a":1}') for k in range(5)], "name string, text string, html string, meta string").coalesce(1)
    rows = sinks.archives(df, html="html", metadata="meta", per=2).collect()
    assert [r["rows"] for r in rows] == [2, 2, 1]
    z = zipfile.ZipFile(io.BytesIO(rows[0]["archive"]))
    assert set(z.namelist()) == {"index.json", "0_p/content.md", "0_p/metadata.json", "1_p/content.md", "1_p/content.html", "1_p/metadata.json"}
    assert z.read("0_p/content.md") == b"t0" and json.loads(z.read("index.json"))[1] == {"folder": "1_p", "length": 0}


def test_only(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert sinks.only(df, ["a", "c", "b"]).columns == ["a", "b"]


def packed(files):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


W, R, O = 'xmlns:w="urn:w"', 'xmlns:r="urn:r"', "http://x/officeDocument/2006/relationships"


def test_docx_parts():
    text, md, about = D.read_docx(packed({
        "docProps/core.xml": '<c xmlns:dc="urn:dc"><dc:title>Report</dc:title><dc:creator>Ann</dc:creator></c>',
        "word/_rels/document.xml.rels": f'<r><x Id="r1" Type="{O}/hyperlink" Target="https://a.example/" TargetMode="External"/><x Id="r2" Type="{O}/image" Target="media/i.png"/></r>', "word/media/i.png": b"1234",
        "word/document.xml": f'<w:d {W} {R}><w:body><w:p><w:r><w:rPr><w:b w:val="0"/><w:i/></w:rPr><w:t>it</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>here</w:t></w:r></w:hyperlink></w:p></w:body></w:d>',
        "word/footnotes.xml": f'<w:f {W}><w:footnote w:id="0"><w:p><w:r><w:t>sep</w:t></w:r></w:p></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>said</w:t></w:r></w:p></w:footnote></w:f>',
    }))
    assert md == "# Report\n\n**Author:** Ann\n\n---\n\n*it*[here](https://a.example/)\n\n![Image 1](embedded)\n\n## Notes\n\n[^2]: said" and text == "ithere" and about["images"] == "1"


def test_xlsx_sheets_by_relation():
    rels = f'<r><x Id="a" Type="{O}/worksheet" Target="worksheets/sheet2.xml"/><x Id="b" Type="{O}/worksheet" Target="/xl/worksheets/sheet1.xml"/></r>'
    cell = "<worksheet><row><c r='A1'><v>{}</v></c></row></worksheet>"
    _, md, about = D.read_xlsx(packed({
        "xl/workbook.xml": f'<w {R}><sheets><sheet name="First" r:id="a"/><sheet name="Second" r:id="b"/></sheets></w>', "xl/_rels/workbook.xml.rels": rels,
        "xl/worksheets/sheet1.xml": cell.format(1), "xl/worksheets/sheet2.xml": cell.format(2),
    }))
    assert md == "## First\n\n| 2 |\n|---|\n\n## Second\n\n| 1 |\n|---|" and about["sheets"] == "2"


def test_pptx_order_tables_and_notes():
    p = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    slide = lambda title, rest: f'<p:s xmlns:p="urn:p" xmlns:a="urn:a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr>{p(title)}</p:sp>{rest}</p:s>'
    rel = lambda *x: "<r>" + "".join(f'<x Id="{i}" Type="{O}/{k}" Target="{t}"/>' for i, k, t in x) + "</r>"
    text, md, about = D.read_pptx(packed({
        "ppt/presentation.xml": f'<p:d xmlns:p="urn:p" {R}><p:l><p:sldId id="256" r:id="b"/><p:sldId id="257" r:id="a"/></p:l></p:d>',
        "ppt/_rels/presentation.xml.rels": rel(("a", "slide", "slides/slide1.xml"), ("b", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide("One", p("body")), "ppt/slides/slide2.xml": slide("Two", f"<a:tbl><a:tr><a:tc>{p('H')}</a:tc></a:tr><a:tr><a:tc>{p('c')}</a:tc></a:tr></a:tbl>"),
        "ppt/slides/_rels/slide1.xml.rels": rel(("n", "notesSlide", "../notesSlides/notesSlide7.xml")), "ppt/notesSlides/notesSlide7.xml": f'<n xmlns:a="urn:a">{p("mind this")}</n>',
    }))
    assert md == "## Slide 1: Two\n\nTwo\n\n| H |\n|---|\n| c |\n\n## Slide 2: One\n\nOne\n\nbody\n\n> Note: mind this"
    assert text.endswith("[Speaker Note] mind this") and about["slides"] == "2"


def test_epub_says_of_itself():
    _, md, about = D.read_epub(packed({
        "META-INF/container.xml": '<c><rootfile full-path="c.opf"/></c>', "a.xhtml": "<html><body><p>text</p></body></html>", "b.xhtml": "<html><body></body></html>",
        "c.opf": '<p><title>Book</title><creator>Bo</creator><language>en</language><item id="Cover-img" href="c.png" media-type="image/png"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><itemref idref="b"/><itemref idref="a"/></p>',
    }))
    assert md == "# Book\n\n**Author:** Bo\n\n## Chapter 1\n\ntext" and about == {"title": "Book", "author": "Bo", "language": "en", "cover": "c.png", "chapters": "1"}


def test_shown_times_of_parts_of_seconds(spark, tmp_path):
    """Equal to SQL where a part of a second decides on the unit, for halves, a null time, the epoch and the time before it."""
    import duckdb

    from weftline.plans import registry

    at = ["2024-01-11 19:06:39.6", "2024-01-11 19:06:39.4", "2024-01-11 19:06:40.5", "2024-01-11 19:06:41.5", "2024-01-11 19:07:39.7", "2024-01-12 03:06:39.9", "1970-01-01 00:00:00", "1970-01-01 00:00:00.5", "1969-12-31 23:59:59.5", None]
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp)")
    con.executemany("insert into events values (?, ?)", list(enumerate(at)))
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = con.execute(registry.oracle_sql()["shown_times"]).fetchall()
    got = registry.queries()["shown_times"](spark, str(tmp_path)).select("event_id", "clock", "iso", "due").collect()
    assert sorted(map(tuple, got)) == sorted(want)
