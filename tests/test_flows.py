import io
import zipfile

from pyspark.sql import functions as F

from weftline.operators import graph as G
from weftline.sources import documents as D
from weftline.sources import sinks
from weftline.streaming import state as S


def test_bfs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a"), ("d", "a"), (None, "x")], "src string, dst string")
    got = {r.url: r.depth for r in G.breadth_first(e, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}
    assert G.breadth_first(e.limit(0), spark.createDataFrame([("a",)], "url string"), 2).count() == 1


def test_best_first_and_depth_first(spark):
    e = spark.createDataFrame([("p0", "p5"), ("p0", "p3"), ("p5", "p9"), ("p3", "p4")], "src string, dst string")
    best = G.best_first(e, spark.createDataFrame([("p0",)], "url string"), F.substring("url", 2, 1).cast("int"), 1, 3, 5)
    assert [r.url for r in best.orderBy("round").collect()] == ["p0", "p5", "p9"]
    d = e.select(F.lit("s").alias("site"), "src", "dst", F.monotonically_increasing_id().alias("pos"))
    d = d.withColumn("pos", F.when(F.col("dst") == "p5", 0).otherwise(1))
    got = G.depth_first(d, spark.createDataFrame([("s", "p0")], "site string, url string"), 5, 10).orderBy("n").collect()
    assert [r.url for r in got] == ["p0", "p5", "p9", "p3", "p4"]


def test_best_first_query_visits_twenty_rounds(spark, sf_dir):
    from weftline.plans import flows

    rows = flows.graph_best_first(spark, sf_dir).collect()  # the first round has the seed only
    assert max(r["round"] for r in rows) == 19 and len({r.url for r in rows}) == len(rows) == 191 and max(r.depth for r in rows) <= 5


def test_breaker_states():
    state, seen = S.CLOSED, []
    for t, ok in [(0, False), (1, False), (2, False), (3, False), (4, False), (5, True), (35, False), (36, True), (70, True), (71, False)]:
        state, name, passed = S.breaker_step(state, float(t), ok)
        seen.append((name, passed))
    assert seen == [("closed", True)] * 4 + [("open", True), ("open", False), ("open", True), ("open", False), ("closed", True), ("closed", True)]


def test_breaker_batch_equals_stream(spark, tmp_path):
    rows = [(k, i, float(i * 7 % 90), (i * k) % 3 > 0) for k in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s double, ok boolean")
    want = {tuple(r) for r in S.circuit_breaker(df).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = S.circuit_breaker_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_windows_stream(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for k, made in enumerate((S.counts_stream(s), S.session_stream(s), S.sliding_counts_stream(s), S.seen_stream(s, "user_id"))):
        q = made.writeStream.format("memory").queryName(f"w{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"w{k}").count() > 0


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
FILES = {
    "a.csv": b"name;n\nx;1\ny;2\n",
    "b.docx": _zip({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}),
    "c.xlsx": _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>h</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2"><v>1</v></c></row></worksheet>'}),
    "d.pptx": _zip({"ppt/slides/slide1.xml": '<p xmlns:a="x"><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:p><a:r><a:t>Body</a:t></a:r></a:p></p>'}),
    "e.epub": _zip({"META-INF/container.xml": '<c><rootfile full-path="o/c.opf"/></c>', "o/c.opf": '<p><title>Book</title><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><itemref idref="a"/></p>', "o/a.xhtml": "<html><body><h1>One</h1><p>text</p></body></html>"}),
    "f.rtf": rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hello \b World\b0\par Next \u228?}",
    "g.pdf": b"%PDF-1.4",
    "h.docx": b"broken",
    "i": b"<html><body><h1>Hi</h1></body></html>",
}


def test_documents(spark):
    df = spark.createDataFrame(list(FILES.items()), "path string, content binary")
    got = {r.path: r for r in D.documents(df).collect()}
    assert got["a.csv"].markdown.startswith("| name | n |") and "| x | 1 |" in got["a.csv"].markdown
    assert got["b.docx"].markdown.startswith("# Head\n\n**bold**") and got["b.docx"].text.endswith("c")
    assert "## S" in got["c.xlsx"].markdown and "| h | Col 2 | 3 |" in got["c.xlsx"].markdown
    assert got["d.pptx"].markdown.startswith("## Slide 1: Title")
    assert got["e.epub"].markdown.startswith("# Book\n\n## Chapter 1\n\n# One")
    assert got["f.rtf"].text.split("\n")[0] == "Hello World" and "ä" in got["f.rtf"].text
    assert got["g.pdf"].error and got["h.docx"].error and got["i"].kind == "html"


def test_feeds(spark):
    x = "<urlset><url><loc> https://a.example/x </loc><priority>0.5</priority></url><url></url></urlset>"
    assert [tuple(r) for r in D.sitemap(spark.createDataFrame([(x,), (None,)], "xml string")).collect()] == [("https://a.example/x", None, "0.5", None)]
    r = "<rss><item><title><![CDATA[T]]></title><link>l</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item></rss>"
    got = D.rss(spark.createDataFrame([(r,)], "xml string")).first()
    assert got.title == "T" and got.published is not None
    assert D.robots_sitemaps(spark.createDataFrame([("User-agent: *\nSitemap: https://a.example/s.xml",)], "robots string")).first()[0] == "https://a.example/s.xml"


def test_sinks(spark, tmp_path):
    import hashlib
    import hmac
    import json

    df = spark.createDataFrame([(1, "a,\"b", [1, 2]), (2, None, None)], "id int, t string, l array<int>")
    sinks.flat_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("id").first().t == 'a,"b'
    sinks.json_lines(df, str(tmp_path / "js"))
    assert json.loads(spark.read.text(str(tmp_path / "js/status")).first()[0]) == {"status": "completed"}
    s = sinks.signed(df.where("id = 1").select(F.col("t").alias("body")), "body", "k" * 70).first()
    assert s.signature == hmac.new(b"k" * 70, s.body.encode(), hashlib.sha256).hexdigest()
    z = sinks.archives(df.select(F.col("id").cast("string").alias("name"), F.col("t").alias("text")).coalesce(1)).first()
    assert zipfile.ZipFile(io.BytesIO(bytes(z.archive))).namelist() == ["index.json", "1/content.md", "2/content.md"]
