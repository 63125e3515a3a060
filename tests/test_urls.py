import pytest
from pyspark.sql import functions as F

from weftline.functions import urls as U

CASES = [
    ("HTTPS://Example.Com/Path", "https://example.com/Path"),
    ("https://example.com/docs/index.html", "https://example.com/docs"),
    ("https://example.com/index.htm", "https://example.com/"),
    ("http://example.com:80/page", "http://example.com/page"),
    ("https://example.com:443/page", "https://example.com/page"),
    ("https://example.com:8443/page/", "https://example.com:8443/page"),
    ("https://www.example.com//a///b/", "https://example.com/a/b"),
    ("https://example.com/a?b=2&a=1#x", "https://example.com/a?a=1&b=2"),
    ("https://example.com/a?utm_source=x&ref=y", "https://example.com/a"),
    ("https://example.com/a?sid=0123456789abcdef0123", "https://example.com/a"),
    ("https://example.com/a?id=0123456789abcdef0123", "https://example.com/a?id=0123456789abcdef0123"),
    ("https://example.com/a?q=a b&z=~*", "https://example.com/a?q=a+b&z=~%2A"),
    ("https://example.com:bad/a", None),
    ("", "https:///"),
    (None, None),
]


def test_normalized(spark):
    df = spark.createDataFrame([(u,) for u, _ in CASES], "url string")
    got = [r[0] for r in df.select(U.normalized("url")).collect()]
    assert got == [x for _, x in CASES]


def test_crawl_key_and_facets(spark):
    df = spark.createDataFrame([("https://a.example/x?page=2&color=red&sort=up", "https://www.a.example/x?color=red")], "a string, b string")
    assert df.select(U.is_facet("a", "b")).first()[0]
    assert df.select(U.crawl_key("a")).first()[0] == "https://a.example/x?color=red"


@pytest.mark.parametrize(
    "url, depth, ok",
    [
        ("https://a.example/x", 1, True), ("https://www.a.example/x", 1, True), ("https://b.example/x", 1, False), ("https://a.example/x", 9, False),
        ("ftp://a.example/x", 1, False), ("https://a.example/admin/x", 1, False), ("https://a.example/admin-guide", 1, True), ("https://a.example/f.PDF", 1, False),
        ("https://a.example/private/x", 1, False),
    ],
)
def test_should_crawl(spark, url, depth, ok):
    df = spark.createDataFrame([(url, depth)], "url string, depth int")
    assert df.select(U.should_crawl("url", "depth", "a.example", exclude=("/private/*",))).first()[0] is ok


def test_scores(spark):
    df = spark.createDataFrame([("https://a.example/docs/2024/guide.pdf",)], "url string")
    r = df.select(U.keyword_score("url", ["docs", "zzz"]), U.depth_score("url"), U.ending_weight("url"), U.freshness_score("url")).first()
    assert list(r) == [0.5, 0.5, 0.7, 0.7]


def test_resolved(spark):
    base = "https://a.example/x/y?q=1"
    want = {"z": "https://a.example/x/z", "/z": "https://a.example/z", "//b.example/z": "https://b.example/z", "?p=2": "https://a.example/x/y?p=2", "#a": None, "mailto:x": None, "http://c.example": "http://c.example"}
    df = spark.createDataFrame([(h, base) for h in want], "h string, b string")
    assert {r.h: r.t for r in df.select("h", U.resolved("h", "b").alias("t")).collect()} == want


def test_null_and_empty_table(spark):
    df = spark.createDataFrame([], "url string")
    assert df.select(U.normalized("url"), U.domain("url")).count() == 0
    assert list(spark.createDataFrame([(None,)], "url string").select(U.domain("url"), U.masked("url"), F.size(U.pairs("url"))).first())[:2] == [None, None]
