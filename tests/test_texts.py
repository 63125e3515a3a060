from weftline.functions import html as H
from weftline.functions import text as T


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "t string").select(col).first()[0]


def test_chunks(spark):
    t = " ".join(f"word{i}" for i in range(100))
    assert len(one(spark, t, T.chunks_fixed("t", 30))) == 4
    s = one(spark, t, T.chunks_sliding("t", 40, 25))
    assert [x.split()[0] for x in s] == ["word0", "word25", "word50", "word60"]
    o = one(spark, t, T.chunks_overlapping("t", 40, 10))
    assert [x.split()[0] for x in o] == ["word0", "word30", "word60"] and o[-1].endswith("word99")
    assert one(spark, "a  b", T.chunks_sliding("t", 40, 25)) == ["a  b"]
    assert one(spark, "", T.chunks_fixed("t", 30)) == []
    assert one(spark, None, T.chunks_fixed("t", 30)) in (None, [])


def test_splits(spark):
    assert one(spark, "One two. Three! four? Five", T.sentences("t")) == ["One two.", "Three! four?", "Five"]
    assert one(spark, "intro\n# A\nx\n## B\ny", T.topics("t")) == ["intro", "# A\nx", "## B\ny"]


def test_citations(spark):
    md = "See [one](https://a.example/x) and [two](https://b.example/(y) again [uno](https://a.example/x)."
    assert one(spark, md, T.cited("t")).startswith("See one⟨1⟩ and two⟨2⟩ again uno⟨1⟩")
    assert one(spark, md, T.references("t"))[0] == "⟨1⟩ https://a.example/x — one"


def test_paragraphs_and_hash(spark):
    p = "a long paragraph " * 8
    assert one(spark, f"{p}\n\nshort\n\n{p}\n\nshort", T.unique_paragraphs("t")).count("paragraph") == 8
    assert one(spark, " A\n b ", T.content_hash("t")) == one(spark, "a B", T.content_hash("t"))


def test_numbers(spark):
    assert one(spark, "$1,299.50", T.price("t")) == 1299.5
    assert one(spark, "x", T.price("t")) is None
    assert one(spark, " Big  News! ", T.slug("t")) == "big-news"


def test_html(spark):
    h = '<html lang="de"><head><title> A  b </title></head><body><script>var x="</p>"</script><h2>H <b>x</b></h2><p>Text</p></body></html>'
    assert one(spark, h, H.visible_text("t")) == "H x Text"
    assert one(spark, h, H.title("t")) == "A b"
    assert [tuple(r) for r in one(spark, h, H.headings("t"))] == [(2, "H x")]
    assert one(spark, "<p>Please verify you are human</p>", H.looks_blocked("t")) is True
    assert one(spark, "connection refused", H.error_code("t")) == "NETWORK_ERROR"


def test_blocked_pages_by_tier(spark):
    long = lambda n: ("some words of a page " * 200)[:n]
    head, soft = "<head><script>var a = 'Just a moment';</script></head>", "<body>Page not found</body>"
    cases = [
        ("<body>Pardon our interruption</body>", True), ("<body>Robot or human?</body>", True), (f"<body>not a robot {long(700)}</body>", True),
        (f"{' ' * 5000}<body>captcha, access denied {long(1000)}</body>", False), (f"<body>{long(1000)} Robot or human</body>", True),
        (f"<body>{long(3500)} just a moment</body>", False), (f"<body>{long(3500)}<i id='PX-captcha'></i></body>", True),
        (f"{head}<body>{long(1500)}</body>", True), (f"{head}<body>{long(3500)}</body>", False),
        ("<body>hi<noscript>x</noscript></body>", True), (f"<body>{long(400)}<noscript>x</noscript></body>", False), (soft, True),
        (f"<body>Page not found {long(600)}</body>", False), ("<title>Google Search</title><body>hi</body>", True),
        ("<body>Continue shopping. Privacy notice</body>", True), ("<body>Privacy notice</body>", False), ("<body></body>", False), ("", True), (None, True),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, t string").select("i", H.looks_blocked("t").alias("b")).collect()
    assert {r.i: r.b for r in rows} == {i: b for i, (_, b) in enumerate(cases)}
