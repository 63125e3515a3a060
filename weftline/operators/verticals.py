"""Rows from the data of result pages: JSON arrays by position (news, jobs, flights, stocks), and search results from HTML.

JSON stays in the JVM: lists are exploded and fields read by path; what isn't there is null. HTML goes through the element
tree. Entries that lack what makes them one give no row; their positions are spent where the page numbers its places.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import shown as V
from weftline.operators import cleaning as C
from weftline.operators.dom import Node, select

inside = V.inside


def listed(data: Column, *steps: str | int) -> Column:
    """Elements of a JSON array as JSON text; empty where there's none."""
    x = inside(data, *steps) if steps else data
    return F.coalesce(F.from_json(F.when(F.json_array_length(x).isNotNull(), x), "array<string>"), F.array().cast("array<string>"))


def is_list(x: Column) -> Column:
    return F.json_array_length(x).isNotNull()


def present_text(x: Column) -> Column:
    return F.when(x != "", x)


def news(df: DataFrame, id_col: str, data: str = "data") -> DataFrame:
    """(id, position, title, url, source, source_url, published, snippet, thumbnail): single entries and those of clusters
    one behind the other; positions count the articles."""
    outer = df.select(id_col, F.posexplode(listed(F.col(data), 1, 0)).alias("n", "e"))
    first, cluster = inside("e", 0), inside("e", 1)
    some = F.when(is_list(first), F.array(first)).when(first.isNull() & cluster.isNotNull(), F.filter(listed(cluster, 2), is_list)).otherwise(F.array().cast("array<string>"))
    a = outer.select(id_col, "n", F.posexplode(some).alias("k", "a"))
    url = F.coalesce(present_text(inside("a", 6)), present_text(inside("a", 38)))
    icon = F.regexp_extract(F.coalesce(inside("a", 10, 3, 0), F.lit("")), r"[?&]url=([^&#]*)", 1)
    a = a.select(
        id_col, "n", "k", inside("a", 2).alias("title"), url.alias("url"), inside("a", 10, 2).alias("source"),
        F.coalesce(present_text(icon), F.concat(F.regexp_extract(url, "^([a-z]+)://", 1), F.lit("://"), F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1))).alias("source_url"),
        V.epoch_iso(inside("a", 4, 0).try_cast("bigint")).alias("published"), inside("a", 3).alias("snippet"), F.coalesce(inside("a", 8, 0, 13), inside("a", 8, 0, 0)).alias("thumbnail"),
    ).where("title is not null and title <> '' and url is not null")
    from pyspark.sql import Window

    return a.withColumn("position", F.row_number().over(Window.partitionBy(id_col).orderBy("n", "k"))).drop("n", "k")


def _html_field(x: Column) -> Column:
    return F.when(is_list(x), present_text(inside(x, 1))).otherwise(present_text(x))


def jobs(df: DataFrame, id_col: str, data: str = "data") -> DataFrame:
    """Listings of a page of vacancies: (id, position, job_id, title, slug, company, apply_url, locations, the five HTML fields,
    categories, created, updated, level); positions count the entries."""
    e = df.select(id_col, F.posexplode(listed(F.col(data), 0)).alias("n", "e")).where(is_list(F.col("e")))
    place = lambda x: F.struct(F.coalesce(present_text(inside(x, 0)), F.lit("Unknown")).alias("name"), inside(x, 2).alias("city"), inside(x, 4).alias("state"), inside(x, 5).alias("country"), inside(x, 3).alias("postal_code"))
    html = {"responsibilities": 3, "qualifications": 4, "description": 10, "benefits": 15, "min_qualifications": 19}
    from weftline.functions.text import slug

    return e.select(
        id_col, (F.col("n") + 1).alias("position"), inside("e", 0).alias("job_id"), inside("e", 1).alias("title"), slug(inside("e", 1)).alias("slug"), inside("e", 7).alias("company"),
        inside("e", 2).alias("apply_url"), F.transform(F.filter(listed(F.col("e"), 9), is_list), place).alias("locations"), *[_html_field(inside("e", k)).alias(n) for n, k in html.items()],
        listed(F.col("e"), 11).alias("categories"), V.epoch_iso(inside("e", 12, 0).try_cast("bigint")).alias("created"), V.epoch_iso(inside("e", 13, 0).try_cast("bigint")).alias("updated"), inside("e", 20).try_cast("int").alias("level"),
    ).where("coalesce(job_id, '') <> '' and coalesce(title, '') <> ''")


def companies(df: DataFrame, id_col: str, data: str = "data") -> DataFrame:
    """(id, company) of the list that stands beside the vacancies."""
    return df.select(id_col, F.explode(F.transform(listed(F.col(data), 0), lambda x: inside(x, 1))).alias("company")).where("company <> ''")


def flights(df: DataFrame, id_col: str, data: str = "data", currency: str | None = None) -> DataFrame:
    """Offers of a page of flights, the best ones before the others; positions count offers that can't be read as well. The
    last leg with a number or an aircraft names it; layovers are where all legs but the last end."""
    best, rest = listed(F.col(data), 2, 0), listed(F.col(data), 3, 0)
    o = df.select(id_col, F.size(best).alias("n_best"), F.posexplode(F.concat(best, rest)).alias("n", "o"))
    o = o.withColumn("f", inside("o", 0)).where((F.json_array_length("f") >= 13) & (F.json_array_length("o") >= 2))
    legs = F.filter(listed(F.col("f"), 2), is_list)
    number = lambda x: F.concat(present_text(inside(x, 22, 0)), F.lit(" "), present_text(inside(x, 22, 1)))
    last = lambda fn: F.element_at(F.filter(F.transform(legs, fn), lambda v: v.isNotNull()), -1)
    present = lambda fn: F.when(F.size(F.filter(F.transform(legs, fn), lambda v: v.isNotNull())) > 0, last(fn))
    stay = F.filter(F.transform(F.slice(legs, 1, F.greatest(F.size(legs) - 1, F.lit(0))), lambda x: inside(x, 6)), lambda v: v.isNotNull() & (v != ""))
    day = lambda k: F.make_date(inside("f", k, 0).try_cast("int"), inside("f", k, 1).try_cast("int"), inside("f", k, 2).try_cast("int"))
    time = lambda k: V.clock(inside("f", k, 0).try_cast("int"), inside("f", k, 1).try_cast("int"))
    minutes, stops, price = inside("f", 9).try_cast("int"), F.coalesce(inside("f", 12).try_cast("int"), F.lit(0)), inside("o", 1, 0, 1).try_cast("double")
    from weftline.functions.text import duration

    sign = F.lit(f"{currency} " if currency else "")
    return o.select(
        id_col, (F.col("n") + 1).alias("position"), (F.col("n") < F.col("n_best")).alias("is_best"), F.coalesce(inside("f", 1, 0), inside("f", 0)).alias("airline"),
        present(number).alias("flight_number"), present(lambda x: present_text(inside(x, 17))).alias("aircraft"), inside("f", 3).alias("origin"), inside("f", 6).alias("destination"),
        time(5).alias("departs"), time(8).alias("arrives"), V.day_offset(day(4), day(7)).alias("days_later"), minutes.alias("minutes"), F.coalesce(duration(minutes), F.lit("")).alias("duration"),
        stops.alias("stops"), F.when(stops == 0, "Nonstop").otherwise(F.concat(stops.cast("string"), F.when(stops > 1, " stops").otherwise(" stop"))).alias("stops_text"), stay.alias("layovers"),
        price.alias("price"), F.concat(sign, F.format_number(price, 0)).alias("price_text"), F.when(inside("o", 5, 0).try_cast("double") > 0, F.concat(inside("o", 5, 0), F.lit(" kg CO₂"))).alias("emissions"),
    )


def stocks(df: DataFrame, id_col: str, data: str = "data", currency: str | None = None) -> DataFrame:
    """(id, position, stock, name, price, percentage, change, movement, currency, previous_close) of a list of quotes; shorter
    entries and those without a name of the paper are left out. No difference counts as down."""
    e = df.select(id_col, F.posexplode(listed(F.col(data))).alias("n", "e")).where(F.json_array_length("e") >= 6)
    pair = inside("e", 1)
    name = F.when(F.json_array_length(pair) >= 2, F.concat(inside("e", 1, 0), F.lit(":"), inside("e", 1, 1))).otherwise(present_text(inside("e", 21)))
    code = F.coalesce(present_text(inside("e", 4)), F.lit(currency))
    price, diff, pct = (inside("e", 5, k).try_cast("double") for k in range(3))
    both = diff.isNotNull() & pct.isNotNull()
    from weftline.functions.text import signed_percent

    close = inside("e", 7).try_cast("double")
    return e.select(
        id_col, (F.col("n") + 1).alias("position"), name.alias("stock"), inside("e", 2).alias("name"), V.money(price, code).alias("price"), F.when(both, signed_percent(pct)).alias("percentage"),
        F.when(both, V.change(diff, code)).alias("change"), F.when(both, F.when(diff > 0, "up").otherwise("down")).alias("movement"), code.alias("currency"), F.when(close != 0, V.money(close, code)).alias("previous_close"),
    ).where("stock is not null")


#: Where result pages keep their results, snippets and dates, tried in this order.
RESULTS = ["div.g", "div.tF2Cxc", "div[data-sokoban-container]", "div.MjjYud"]
SNIPPETS = ["div[data-sncf]", "div.VwiC3b", "span.aCOpRe", "div.IsZvec", "div[style='-webkit-line-clamp:2']"]
DATES = ["span.LEwnzc", "span.MUxGbd", "span.f"]
SITELINKS = "a.fl, table.jmjoTe a, div.HiHjCd a"
ANSWERS = ["div.xpdopen", "div[data-tts='answers']", "div.IZ6rdc", "block-component[data-bm]"]
ANSWER_TEXTS = ["span.hgKElc", "div.IZx3Hd", "div.LGOjhe"]
QUESTIONS = "div.related-question-pair, div[data-q]"
QUESTION_ANSWERS = "div.wDYxhc, div[data-attrid]"
RELATED = ["div#botstuff a", "a.k8XOCe", "div.s75CSd a", "a.EIaa9b"]


def _first(n: Node, *selectors: str) -> Node | None:
    return next((x for s in selectors for x in select(n, s)[:1] if x is not n), None)


def organic(root: Node, page: int = 1, num: int = 10) -> list[dict]:
    """Results of a search page by the first layout that is found; their places count those that can't be read."""
    boxes = next((b for s in RESULTS if (b := select(root, s))), [])
    out = []
    for i, box in enumerate(boxes):
        head, link = _first(box, "h3"), _first(box, "a[href]")
        title = C.joined(head) if head else ""
        url = link.attrs.get("href", "") if link else ""
        if not title or not url or url.startswith(("/search", "#")):
            continue
        if "/url?q=" in url:
            url = url.split("/url?q=")[1].split("&")[0]
        cite, text = _first(box, "cite"), _first(box, *SNIPPETS)
        long = (t for n in box.walk() if n.tag in ("span", "div") and n is not box for t in [C.joined(n)] if len(t) > 50 and t != title)
        date = next((t for s in DATES for n in select(box, s)[:1] for t in [C.joined(n)] if re.search(r"\d{4}|\w{3}\s+\d{1,2}", t)), None)
        more = [{"title": C.joined(a), "url": a.attrs.get("href", "")} for a in select(box, SITELINKS)]
        out.append({
            "position": (page - 1) * num + i + 1, "title": title, "url": url, "displayed_url": C.joined(cite) if cite else None, "snippet": (text.text(" ") if text else None) or next(long, None), "date": date,
            "sitelinks": [m for m in more if m["title"] and m["url"] and not m["url"].startswith("#")],
        })
    return out


def featured(root: Node) -> dict | None:
    """The answer that stands before the results."""
    for box in (n for s in ANSWERS for n in select(root, s)[:1]):
        text = _first(box, *ANSWER_TEXTS)
        content = text.text(" ") if text else ""
        if content:
            head, link = _first(box, "h3"), _first(box, "a[href]")
            kind = "list" if select(box, "ol, ul") else "table" if select(box, "table") else "paragraph"
            return {"title": C.joined(head) if head else "", "url": link.attrs.get("href", "") if link else "", "content": content, "type": kind}
    return None


def questions(root: Node) -> list[dict]:
    """What people also ask, with up to three hundred characters of the answer."""
    out = []
    for n in select(root, QUESTIONS):
        span, answer = _first(n, "span"), _first(n, *QUESTION_ANSWERS.split(", "))
        q = n.attrs.get("data-q") or (C.joined(span) if span else "")
        if q:
            out.append({"question": q, "snippet": answer.text(" ")[:300] if answer else None})
    if not out:
        out = [{"question": t, "snippet": None} for n in select(root, "[aria-expanded]") for t in [C.joined(n)] if "?" in t and len(t) < 200]
    return out


def related(root: Node) -> list[str]:
    """Searches that are offered beside this one, each once whatever its case."""
    found = [(C.joined(n), n.attrs.get("href", "")) for s in RELATED for n in select(root, s)]
    kept: dict[str, str] = {}
    for text, href in found:
        if 2 < len(text) < 100 and ("/search?" in href or not href):
            kept.setdefault(text.lower(), text)
    return list(kept.values())


_LINK = pa.struct([("title", pa.string()), ("url", pa.string())])
RESULT_T = pa.struct([("position", pa.int32()), *((k, pa.string()) for k in ("title", "url", "displayed_url", "snippet", "date")), ("sitelinks", pa.list_(_LINK))])
SEARCH_T = pa.struct([
    ("organic", pa.list_(RESULT_T)), ("featured", pa.struct([(k, pa.string()) for k in ("title", "url", "content", "type")])),
    ("questions", pa.list_(pa.struct([("question", pa.string()), ("snippet", pa.string())]))), ("related", pa.list_(pa.string())),
])


def search_results(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, results struct<organic, featured, questions, related>) of search pages."""
    made = lambda root, base: {"organic": organic(root), "featured": featured(root), "questions": questions(root), "related": related(root)}
    return C.per_page(df.withColumn("_url", F.lit("")), id_col, "_url", html_col, "results", made, SEARCH_T)
