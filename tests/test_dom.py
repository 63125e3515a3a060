from weftline.operators import dom as D

PAGE = """<html><body><nav><a href="/x">Menu</a></nav><main><h1>Head</h1><p>One <b>bold</b> <a href="/a" title="t">link</a><p>Two
<ul><li>a<li>b<ul><li>c</ul></ul><pre><code class="language-py">x = 1</code></pre>
<table><thead><tr><th>Name<th>Name<th></tr></thead><tbody><tr><td>1<td colspan=2>2</tr><tr><td>3<td>4<td>5</tr></tbody></table>
<div style="display: none">secret</div></main><footer>foot</footer></body></html>"""


def test_markdown():
    md = D.postprocess(D.to_markdown(D.cleaned(D.main_container(D.parse(PAGE)))))
    for part in ("# Head", "One **bold** [link](/a \"t\")", "- a\n- b\n  - c", "```py\nx = 1\n```", "| Name | Name 2 | Column 3 |"):
        assert part in md
    assert "secret" not in md and "Menu" not in md and "foot" not in md


def test_tables_and_selectors():
    root = D.parse(PAGE)
    t = D.select(root, "main table")[0]
    assert D.data_table(t)
    assert D.table_rows(t) == (["Name", "Name 2", "Column 3"], [["1", "2", "2"], ["3", "4", "5"]])
    assert [n.text() for n in D.select(root, "ul > li:not(.x), h1")][0] == "Head"
    assert D.select(root, "a[href^='/']")[0].text() == "Menu"


def test_product():
    p = D.product(D.parse('<script type="application/ld+json">{"@type":"Product","name":"N","brand":{"name":"B"},"offers":{"lowPrice":1,"highPrice":2,"priceCurrency":"EUR","availability":"https://schema.org/InStock"},"aggregateRating":{"ratingValue":4.5,"reviewCount":7}}</script>'))
    assert (p["name"], p["brand"], p["price"], p["currency"], p["availability"], p["rating"], p["rating_count"]) == ("N", "B", "1-2", "EUR", "InStock", "4.5", "7")
    m = D.product(D.parse('<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">M</span><span itemprop="offers" itemscope><meta itemprop="price" content="9"></span></div>'))
    assert (m["name"], m["price"]) == ("M", "9")
    assert D.product(D.parse("<p>x</p>")) is None


def test_in_spark(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>un<closed <b>x")], "page_id long, html string")
    got = {r.page_id: r.markdown for r in D.markdown(df, "page_id", "html").collect()}
    assert got[2] is None and got[3] == "" and "# Head" in got[1] and 4 in got
    assert D.tables(df, "page_id", "html").where("size(tables) = 1").count() == 1
    assert D.selected(df, "page_id", "html", "a", "href").where("page_id = 1").first().found == ["/x", "/a"]
