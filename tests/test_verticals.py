"""Payloads of result pages, written by hand."""

import json

from weftline.operators import verticals as X
from weftline.operators.dom import parse


def frame(spark, *data):
    return spark.createDataFrame([(k, None if d is None else json.dumps(d)) for k, d in enumerate(data, 1)], "id int, data string")


def arr(n, **at):
    out = [None] * n
    for k, v in at.items():
        out[int(k[1:])] = v
    return out


def test_news(spark):
    a = arr(39, _2="One", _4=[1700000000], _6="https://a.example/1", _10=[None, None, "A", ["https://p/?url=a.example&x=1"]], _8=[arr(14, _0="/img", _13="https://i/1")])
    b = arr(39, _2="Two", _38="https://b.example/2?x", _3="said")
    data = ["gsrres", [[[a, None], [None, ["topic", None, [b, arr(39, _2="no url"), "odd"]]], [], "x"]], "q"]
    rows = X.news(frame(spark, data, None, ["gsrres"]), "id").orderBy("position").collect()
    assert [(r.position, r.title, r.url, r.source, r.source_url, r.published, r.snippet, r.thumbnail) for r in rows] == [
        (1, "One", "https://a.example/1", "A", "a.example", "2023-11-14T22:13:20+00:00", None, "https://i/1"), (2, "Two", "https://b.example/2?x", None, "https://b.example", None, "said", None),
    ]


def test_jobs(spark):
    e = arr(21, _0="7", _1="Data Engineer", _2="https://apply", _3=[None, "<p>r</p>"], _7="Acme", _9=[["Paris, France", [], "Paris", "75", "IDF", "FR"], [None]], _10="<p>d</p>", _11=[3, 4], _12=[1700000000, 5], _20=2)
    rows = X.jobs(frame(spark, [[arr(3, _0="x"), e], None, 12]), "id").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.position, r.job_id, r.slug, r.company, r.responsibilities, r.description, r.qualifications, r.categories, r.created, r.level) == (2, "7", "data-engineer", "Acme", "<p>r</p>", "<p>d</p>", None, ["3", "4"], "2023-11-14T22:13:20+00:00", 2)
    assert [(p.name, p.city, p.country) for p in r.locations] == [("Paris, France", "Paris", "FR"), ("Unknown", None, None)]
    assert [c.company for c in X.companies(frame(spark, [[["r", "Acme"], ["r", None]]]), "id").collect()] == ["Acme"]


def test_flights(spark):
    leg = lambda to, no, ac: arr(23, _6=to, _17=ac, _22=["LH", no])
    f = arr(13, _0="LH", _1=["Lufthansa"], _2=[leg("FRA", "10", "A320"), leg("JFK", "400", None)], _3="HAM", _4=[2026, 1, 31], _5=[13, 5], _6="JFK", _7=[2026, 2, 1], _8=[0, None], _9=605, _12=1)
    direct = arr(13, _0="XX", _3="A", _6="B", _9=60)
    data = [None, None, [[[f, [[None, 1234.4]], None, None, None, [310]], ["short"]]], [[[direct, []]]]]
    rows = X.flights(frame(spark, data), "id", currency="EUR").orderBy("position").collect()
    a, b = rows
    assert (a.position, a.is_best, a.airline, a.flight_number, a.aircraft, a.layovers) == (1, True, "Lufthansa", "LH 400", "A320", ["FRA"])
    assert (a.departs, a.arrives, a.days_later, a.duration, a.stops_text, a.price_text, a.emissions) == ("1:05 PM", "", "+1", "10 hr 5 min", "1 stop", "EUR 1,234", "310 kg CO₂")
    assert (b.position, b.is_best, b.airline, b.stops_text, b.price, b.layovers, b.duration) == (3, False, "XX", "Nonstop", None, [], "1 hr")


def test_stocks(spark):
    data = [arr(22, _1=["ABC", "NYSE"], _2="Abc", _4="USD", _5=[1234.5, -2.0, -0.16], _7=1236.5), arr(22, _2="Coin", _5=[1.0, 0, 0], _21="BTC-EUR"), arr(8, _2="none", _5=[1]), [1]]
    a, b = X.stocks(frame(spark, data), "id", currency="EUR").orderBy("position").collect()
    assert (a.stock, a.price, a.percentage, a.change, a.movement, a.previous_close) == ("ABC:NYSE", "$1,234.50", "-0.16%", "-$2.00", "down", "$1,236.50")
    assert (b.stock, b.price, b.movement, b.currency, b.previous_close) == ("BTC-EUR", "€1.00", "down", "EUR", None)


PAGE = """<div class=xpdopen><h3>Ans</h3><a href="https://f.example/"></a><span class=hgKElc>The <b>answer</b></span><ul><li>x</li></ul></div>
<div class=g><h3>First</h3><a href="/url?q=https://a.example/&sa=U"></a><cite>a.example</cite><div class=VwiC3b>Snippet <i>one</i></div><span class=f>Jan 5</span><a class=fl href="/x">More</a></div>
<div class=g><a href="#">no title</a></div><div class=g><h3>Third</h3><a href="https://c.example/"></a><div>A text that is long enough to be taken for the snippet of it</div></div>
<div data-q="Why?"><div class=wDYxhc>Because</div></div><div id=botstuff><a href="/search?q=b">Be</a><a href="/search?q=bc">bees</a><a href="/search?q=bc">Bees</a><a href="/x">other</a></div>"""


def test_search_page(spark):
    r = X.search_results(spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "id int, html string"), "id", "html").orderBy("id").collect()
    o = r[0].results.organic
    assert [(x.position, x.title, x.url, x.snippet, x.date) for x in o] == [(1, "First", "https://a.example/", "Snippet one", "Jan 5"), (3, "Third", "https://c.example/", "A text that is long enough to be taken for the snippet of it", None)]
    assert o[0].sitelinks[0].url == "/x" and o[0].displayed_url == "a.example"
    assert (r[0].results.featured.content, r[0].results.featured.type) == ("The answer", "list") and r[0].results.questions[0].snippet == "Because" and r[0].results.related == ["bees"]
    assert r[1].results.organic == [] and r[1].results.featured is None and r[2].results is None
    assert X.questions(parse("<p aria-expanded=false>Is it so?</p><p aria-expanded=true>No</p>")) == [{"question": "Is it so?", "snippet": None}]
