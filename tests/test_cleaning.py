"""Cleaning, links and whole-page extraction on small sources worked out by hand."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import shown as V
from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.operators import cleaning as C
from weftline.operators.dom import parse
from weftline.streaming import state as S

LONG = "A sentence that is long enough to be content of a page and of nothing else. " * 8


def md(source, **k):
    return C.light_markdown(source, "https://a.example/x/y", **k)[1]


def test_light_cleaning():
    source = (
        "<body><script>x</script><div class='cookie-banner'>We use cookies</div><div style='display: none'>hidden</div><div>one</div><div>two words</div><div><img src='/p.png' alt='P'></div>"
        "<p aria-hidden='true'>deco</p><a href='https://x.com/me'>Follow <b>us</b></a><img src='https://t.example.net/p.gif' width='1' height='1' alt='seen'><p><a href='../z?q=1#t'>Z</a></p></body>"
    )
    got = md(source)
    assert "two words" in got and "![P](https://a.example/p.png)" in got and "Follow" in got and "seen" in got and "[Z](https://a.example/z?q=1#t)" in got
    for gone in ("cookies", "hidden", "deco", "x.com", "p.gif", "one"):
        assert gone not in got


def test_main_content():
    page = f"<body><header>Top</header><nav>Menu</nav><main><h1>T</h1><p>{LONG}</p><nav class='pagination'>1 2</nav></main><aside>Side</aside><footer>Foot</footer></body>"
    got = md(page, main_only=True)
    assert got.startswith("# T") and "1 2" in got and all(x not in got for x in ("Top", "Menu", "Side", "Foot"))
    bare = f"<body><header>Top</header><p>{LONG}</p><aside>Side</aside><aside>{LONG}</aside><footer>Foot</footer><form>Search</form></body>"
    got = md(bare, main_only=True)
    assert got.count("A sentence") == 8 or got.count("A sentence") == 16
    assert all(x not in got for x in ("Top", "Side", "Foot", "Search"))


@pytest.mark.parametrize(
    "source, name",
    [
        ("<div class='md-content'>x</div>", "mkdocs"), ("<div id='__docusaurus'></div>", "docusaurus"), ("<meta name='generator' content='Hugo 0.1'>", "hugo"),
        ("<div class='book with-summary'></div>", "honkit"), ("<p>x</p>", None),
    ],
)
def test_framework(source, name):
    assert C.framework(parse(source)) == name


def test_filters():
    source = "<div><p class='a'>one two</p><p class='b'>three four</p><blockquote>five six</blockquote></div>"
    assert md(source, exclude=(".b",)) == "one two\n\n> five six"
    assert md(source, include=("blockquote", ".a")) == "> five six\n\none two"
    assert "three four" in md(source, include=("table",))


def test_links():
    source = (
        "<link rel='next' href='/2'><link rel='icon' href='/i.ico'><a href='#top'>T</a><a href='b#s' title='B' rel='nofollow' target='_blank'>Bee <i>x</i></a>"
        "<a href='mailto:a@b.c'>M</a><a href='https://o.example/'>O</a><a href='/app#/route'>R</a><form action='/find'></form><div data-href='/d'></div>"
    )
    root = parse(source)
    assert C.all_links(root, "https://a.example/x/y") == [
        "https://a.example/2", "https://a.example/app#/route", "https://a.example/d", "https://a.example/find", "https://a.example/x/b", "https://a.example/x/y", "https://o.example/",
    ]
    d = C.link_details(root, "https://a.example/x/y")
    assert [(x["url"], x["text"], x["title"], x["nofollow"], x["new_tab"], x["internal"]) for x in d] == [
        ("https://a.example/x/b", "Beex", "B", True, True, True), ("https://o.example/", "O", None, False, False, False), ("https://a.example/app", "R", None, False, False, True),
    ]
    m = C.map_links(parse("<p>Read <a href='/q#s'>this</a> now</p><a href='https://sub.a.example/'>s</a><a href='https://b.test/'>o</a>"), "https://a.example/")
    assert [(x["url"], x["title"]) for x in m] == [("https://a.example/q", "this"), ("https://sub.a.example/", "s")] and m[0]["description"] == "Readthisnow"
    assert [x["url"] for x in C.map_links(root, "https://a.example/", subdomains=False)] == ["https://a.example/b", "https://a.example/app#/route"]


def test_selectors_and_xpath():
    root = parse("<ul><li class='k one'> A </li><li>B</li></ul><p><a href='/x'>X</a> t</p><table><tr><td>1</td><td></td></tr></table>")
    assert C.xpath(root, "//li/text()") == ["A", "B"] and C.xpath(root, "//ul/li[2]") == ["B"] and C.xpath(root, "//a/@href") == ["/x"]
    assert C.xpath(root, "//li[contains(@class, 'one')]") == ["A"] and C.xpath(root, "//td") == ["1"] and C.xpath(root, "//li[last()]") == [] and C.xpath(root, "li[") == []
    assert C.named(root, {"a": "a@href", "b": "//td", "c": ".none", "d": "li"}) == {"a": ["/x"], "b": ["1"], "c": [], "d": ["A", "B"]}


def test_fit_and_query():
    source = f"<title>T</title><meta name='description' content='D'><body><nav><p>a menu of links here</p></nav><h1>H</h1><p>{LONG}</p><div><a href='/1'>one</a> <a href='/2'>two three four five</a></div></body>"
    root = parse(source)
    assert C.page_query(root) == "T H D"
    got = C.fit_markdown(root)
    assert "A sentence" in got and "menu" not in got and "two three" not in got


def test_pages(spark):
    source = "<html lang='en'><title>T</title><body><h2 id='i'>Head</h2><p>some words here</p><img src='/p.png' srcset='a 1x, b 2x'><table><tr><th>A</th></tr><tr><td>1</td></tr><tr><td>2</td></tr></table></body></html>"
    df = spark.createDataFrame([(1, "https://a.example/", source, 0), (2, None, "", 0), (3, "x", None, 0), (4, "x", "<p" + "<b>" * 500, 0), (1, "https://a.example/", source, 0)], "page_id long, url string, html string, links int")
    rows = C.pages(df, "page_id", "url", "html", tuple(C.PAGE_T)).collect()
    assert sorted(r.page_id for r in rows) == [1, 1, 2, 3, 4]
    r = next(r for r in rows if r.page_id == 1)
    assert r.metadata.title == "T" and r.metadata.language == "en" and r.headings[0].id == "i" and r.images[0].src == "https://a.example/p.png" and r.images[0].srcset[1].descriptor == "2x"
    assert r.tables[0].headers == ["A"] and "## Head" in r.markdown and r.content_hash
    assert all(v is None for k, v in next(r for r in rows if r.page_id == 3).asDict().items() if k != "page_id")
    deep = spark.createDataFrame([(1, "u", "<div>" * 30_000 + "<b>" * 2_000 + "deep words here" + "</div>" * 5, 0)], "page_id long, url string, html string, links int")
    assert "deep words here" in C.pages(deep, "page_id", "url", "html", tuple(C.PAGE_T)).first().markdown
    assert C.pages(df.limit(0), "page_id", "url", "html", ("markdown", "links")).count() == 0


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "error, html, status, code",
    [
        ("Read timed out", None, 0, "TIMEOUT"), ("certificate expired", None, 0, "NETWORK_ERROR"), ("HTTP 403", None, 0, None), ("x", "<p>Verify you are human", 0, "CAPTCHA_REQUIRED"),
        ("x", "<p>Access Denied", 0, "BLOCKED_BY_WAF"), ("x", "<p>ok", 451, "BLOCKED_BY_WAF"), (None, "please enable JavaScript", 0, "JS_REQUIRED"), ("All scraping strategies failed", None, 0, "BLOCKED_BY_WAF"), (None, None, 403, None),
    ],
)
def test_error_code(spark, error, html, status, code):
    assert one(spark, H.error_code("e", "h", "s"), e=error, h=html, s=status) == code


def test_reasons_and_banner(spark):
    assert one(spark, H.block_reason("h", "s"), h="x", s=429).startswith("Rate limited") and one(spark, H.block_reason("h", "s"), h="DataDome", s=0).startswith("Blocked by DataDome")
    assert one(spark, H.block_reason("h", "s"), h="", s=200) == H.NO_REASON
    assert one(spark, H.noscript_block("h"), h="<NOSCRIPT>on</NOSCRIPT><body>short</body>") is True
    assert one(spark, H.cache_banner_removed("h"), h="a<div id='google-cache-hdr'>x</div>b<div id='google-cache-hdr'>y</div>") == "ab<div id='google-cache-hdr'>y</div>"


@pytest.mark.parametrize(
    "href, target",
    [("../b/c", "https://a.example/x/b/c"), ("./d?q=../e", "https://a.example/x/y/d?q=../e"), ("/a/./b/..", "https://a.example/a/"), ("//o.example/p", "https://o.example/p"), ("#t", None), ("../../../..", "https://a.example/")],
)
def test_resolved(spark, href, target):
    assert one(spark, U.resolved("h", F.lit("https://a.example/x/y/z")), h=href) == target


@pytest.mark.parametrize("text, number, code", [("$1,299.99", 1299.99, "USD"), ("1.299,99 €", 1.299, "EUR"), ("R$ 5", 5.0, "USD"), ("free", None, None)])
def test_price(spark, text, number, code):
    assert one(spark, T.price("t"), t=text) == number and one(spark, T.currency("t"), t=text) == code


def test_citations(spark):
    t = "See [a](u1), ![b](u2) and [c](u1)."
    assert one(spark, T.cited("t"), t=t) == "See a⟨1⟩, !b⟨2⟩ and c⟨1⟩." and one(spark, T.references("t"), t=t) == ["⟨1⟩ u1 — a", "⟨2⟩ u2 — b"]
    assert one(spark, T.chunks_sliding("t", 3, 1), t="  ") == [] and one(spark, T.chunks_overlapping("t", 3, 1), t="") == []


def test_shown(spark):
    assert one(spark, V.provider_id("u"), u="https://m.example/!19s%2Fg%2Fabc?x") == "/g/abc" and one(spark, V.provider_id("u"), u="!19s/m/0x!2") == "/m/0x" and one(spark, V.provider_id("u"), u="x") is None
    assert one(spark, V.thumbnail("u"), u="a=w80-h90-k") == "a=w600-h400-k" and one(spark, V.without_place("q"), q="the best shops near Times Square") == "shops" and one(spark, V.without_place("q"), q="all in x") == "all in x"
    assert one(spark, V.hex_pair_id("h"), h="0x3bb6e59021aaaaab:0xfbacafc56bc15ed7") == "18135063061965397719" and one(spark, V.change(F.col("n"), F.lit("USD")), n=0) == "-$0.00"
    assert one(spark, V.clock(F.col("h"), F.lit(5)), h=0) == "12:05 AM" and one(spark, V.clock(F.col("h"), F.lit(5)), h=12) == "12:05 PM" and one(spark, V.shop_price("t"), t="1.2.3") is None
    assert one(spark, V.grouped_attributes(F.split("a", ",")), a="Wheelchair ramp,Valet,Jazz,Free parking") == {"accessibility": ["Wheelchair ramp"], "parking": ["Valet", "Free parking"], "other": ["Jazz"]}
    assert one(spark, U.map_normalized("u"), u="https://a.example/p?b=2&utm_source=x&a=1&b=3#f") == "https://a.example/p?b=2&b=3&a=1" and one(spark, U.map_normalized("u"), u="https://a.example/p#f") == "https://a.example/p#f"
    assert one(spark, U.is_page("u"), u="https://a.example/x.PDF") is False and one(spark, U.is_hard("u"), u="https://shop.amazon.test/") is False and one(spark, U.is_hard("u"), u="https://amazon.test/") is True


@pytest.mark.parametrize(
    "cron, after, want",
    [("*/15 * * * *", "2026-01-01 10:07", "2026-01-01 10:15"), ("0 9 * * 1-5", "2026-01-02 09:00", "2026-01-05 09:00"), ("30 0 29 2 *", "2026-01-01 00:00", "2028-02-29 00:30"), ("0 0 1 * 0", "2026-01-02 00:00", "2026-01-04 00:00"), ("x", "2026-01-01 00:00", None), ("0 0 31 2 *", "2026-01-01 00:00", None)],
)
def test_cron(cron, after, want):
    from datetime import datetime

    assert S.cron_after(cron, datetime.fromisoformat(after)) == (datetime.fromisoformat(want) if want else None)


def test_slots_and_cache(spark):
    e = spark.createDataFrame([(1, i, "a" if i % 2 else "b", float(t), load) for i, (t, load) in enumerate([(0, 95.0), (10, 20.0), (3599, 60.0), (3600, 80.0), (3700, 10.0)])], "user_id long, event_id long, k string, s double, load double")
    assert [r.slots for r in S.adaptive_slots(e, "user_id", "load", "s", "event_id").orderBy("event_id").collect()] == [1, 2, 2, 1, 2]
    assert [r.hit for r in S.ttl_cache(e, "user_id", "k", "s", "event_id").orderBy("event_id").collect()] == [False, False, True, True, False]
