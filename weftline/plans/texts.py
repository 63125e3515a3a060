"""Queries over Markdown, HTML and document texts that built-in expressions can answer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import text as T
from weftline.session import table


def _md(s, d):
    return table(s, d, "pages").where("markdown is not null").select("page_id", "markdown")


def chunk_fixed(s, d):
    return _md(s, d).select("page_id", F.posexplode(T.chunks_fixed("markdown", 60)).alias("n", "chunk"))


def chunk_sliding(s, d):
    return _md(s, d).select("page_id", F.posexplode(T.chunks_sliding("markdown", 60, 25)).alias("n", "chunk"))


def chunk_overlap(s, d):
    return _md(s, d).select("page_id", F.posexplode(T.chunks_overlapping("markdown", 80, 20)).alias("n", "chunk"))


def chunk_sentence(s, d):
    return _md(s, d).select("page_id", F.posexplode(T.sentences("markdown")).alias("n", "chunk"))


def chunk_regex(s, d):
    return _md(s, d).select("page_id", F.posexplode(T.chunks_split("markdown")).alias("n", "chunk"))


def chunk_topic(s, d):
    return _md(s, d).select("page_id", F.posexplode(T.topics("markdown")).alias("n", "chunk"))


def para_dedup(s, d):
    return _md(s, d).select("page_id", T.unique_paragraphs(F.concat_ws("\n\n", "markdown", "markdown")).alias("markdown"))


def content_hash_groups(s, d):
    x = table(s, d, "documents").where("text is not null").groupBy(T.content_hash("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return x.where("copies > 1")


def reading_time(s, d):
    return _md(s, d).select("page_id", T.word_count("markdown").alias("words"), T.reading_seconds("markdown").alias("seconds"))


def citation_refs(s, d):
    return _md(s, d).select("page_id", F.posexplode(T.references("markdown")).alias("n", "ref"))


def page_error_codes(s, d):
    """Class of each page by its source and status."""
    p = table(s, d, "pages")
    return p.select("page_id", H.error_code(F.lit(None).cast("string"), "html", "status_code").alias("code")).where("code is not null")


def page_block_reasons(s, d):
    return table(s, d, "pages").where("html is not null or status_code >= 400").groupBy(H.block_reason("html", "status_code").alias("reason")).agg(F.count("*").alias("pages"))


def page_noscript(s, d):
    return table(s, d, "pages").where("html is not null").select("page_id", H.noscript_block("html").alias("noscript"))


def citation_text(s, d):
    return _md(s, d).select("page_id", T.cited("markdown").alias("cited"))


def bm25(blocks, queries, least: float = 1.0):
    """(page_id, block, score): Okapi BM25 of each page's blocks (page_id, block, tag, text) for its query terms
    (page_id, term, times). A term that the query repeats counts as often, in the frequencies as well; blocks weigh by their tag;
    a page of which no block reaches ``least`` keeps all.

    Query terms are few and each block's terms are counted where they are; only (page, block, term) counts move."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TAG_WEIGHTS.items() for x in kv]), F.col("tag")), F.lit(1.0))
    b = blocks.withColumn("dl", T.word_count("text")).where("dl >= 5").withColumn("weight", weight)
    whole = Window.partitionBy("page_id")
    b = b.withColumn("n", F.count("*").over(whole)).withColumn("avgdl", F.avg("dl").over(whole))
    t = b.select("page_id", "block", "dl", "n", "avgdl", "weight", F.explode(T.tokens("text")).alias("term"))
    t = t.groupBy("page_id", "block", "dl", "n", "avgdl", "weight", "term").agg(F.count("*").alias("tf"))
    t = t.join(queries, ["page_id", "term"]).withColumn("df", F.count("*").over(Window.partitionBy("page_id", "term")) * F.col("times"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    scored = t.groupBy("page_id", "block").agg((F.sum(part) * F.first("weight")).alias("score"))
    every = b.select("page_id", "block").join(scored, ["page_id", "block"], "left").select("page_id", "block", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    return every.withColumn("best", F.max("score").over(whole)).where((F.col("score") >= least) | (F.col("best") < least)).drop("best")


#: Weights of blocks by their element.
TAG_WEIGHTS = {"h1": 5.0, "h2": 4.0, "h3": 3.0, "h4": 2.5, "h5": 2.0, "h6": 1.5, "strong": 2.0, "b": 1.5, "em": 1.5, "blockquote": 2.0, "pre": 1.5, "code": 1.5}


def bm25_blocks(s, d):
    """BM25 of each page's Markdown blocks for its own title, headline and description."""
    p = table(s, d, "pages").where("markdown is not null").select("page_id", "title", "description", "markdown")
    own = F.concat_ws(" ", "title", F.regexp_extract("markdown", r"(?m)^# +(.+)$", 1), "description")
    q = p.select("page_id", F.explode(T.tokens(own)).alias("term")).groupBy("page_id", "term").agg(F.count("*").alias("times"))
    b = p.select("page_id", F.posexplode(T.chunks_split("markdown")).alias("block", "text"))
    marks = F.length(F.regexp_extract("text", r"^(#{1,6}) ", 1))
    tag = F.when(marks > 0, F.concat(F.lit("h"), marks.cast("string"))).when(F.col("text").startswith(">"), "blockquote").when(F.col("text").startswith("```"), "pre").otherwise("p")
    return bm25(b.withColumn("tag", tag), q)


def page_titles(s, d):
    return table(s, d, "pages").where("html is not null").select("page_id", H.title("html").alias("html_title"), H.language("html").alias("html_lang"), H.meta("html", "description").alias("html_description"))


def page_visible_text(s, d):
    return table(s, d, "pages").where("html is not null").select("page_id", H.visible_text("html").alias("visible"))


def page_links(s, d):
    return table(s, d, "pages").where("html is not null").select("page_id", F.explode(F.array_sort(F.array_distinct(H.hrefs("html")))).alias("href"))


def page_link_counts(s, d):
    h = H.hrefs("html")
    inner = F.size(F.filter(h, lambda x: x.rlike("^/[^/]|^/$|^#")))
    return table(s, d, "pages").where("html is not null").select("page_id", F.size(h).alias("links"), inner.alias("relative"))


def page_headings(s, d):
    return table(s, d, "pages").where("html is not null").select("page_id", F.posexplode(H.headings("html")).alias("n", "h")).select("page_id", "n", "h.level", "h.text")


def page_block_class(s, d):
    return table(s, d, "pages").where("html is not null").select("page_id", H.looks_blocked("html").alias("blocked"))


def error_codes(s, d):
    return table(s, d, "jobs").where("error is not null").groupBy(F.coalesce(H.error_code("error"), F.lit("OTHER")).alias("code")).agg(F.count("*").alias("jobs"))


def delivery_error_codes(s, d):
    w = table(s, d, "webhook_deliveries").where("error is not null")
    return w.groupBy(F.coalesce(H.error_code("error"), F.lit("OTHER")).alias("code")).agg(F.count("*").alias("n"))


def price_parse(s, d):
    """Prices as shops write them (the tables' texts show none), read again."""
    p = table(s, d, "part")
    sign = F.element_at(F.array(*[F.lit(x) for x in ("$", "€ ", "£", "R$", "kr ", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    shown = F.concat(F.lit(" "), sign, F.format_number("p_retailprice", 2))
    return p.select("p_partkey", T.price(shown).alias("price"), T.currency(shown).alias("currency"))


def text_formats(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", T.slug("p_name").alias("slug"), T.slug("p_type", "_").alias("type_id"), T.duration(F.col("p_size") * 7).alias("duration"), T.signed_percent((F.col("p_size") - 25) / 3).alias("change"))


def hex_ids(s, d):
    """Hexadecimal ids as unsigned decimals."""
    x = table(s, d, "pages").select("page_id", F.substring(F.md5("url"), 1, 16).alias("hex"))
    return x.select("page_id", F.conv("hex", 16, 10).alias("decimal"))


def pipe_tables(s, d):
    """Rows of a Markdown table per nation."""
    c = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select("n_nationkey", T.pipe_row(F.array(F.col("n_nationkey").cast("string"), "n_name", "r_name")).alias("row"))


def keyword_changes(s, d):
    """Keywords won and lost between a page's two versions in ``job_results`` under one URL."""
    w = Window.partitionBy("url").orderBy("created_at", "id")
    x = table(s, d, "job_results").where("markdown is not null").select("id", "url", F.lower("markdown").alias("new"), F.lag(F.lower("markdown")).over(w).alias("old")).where("old is not null")
    keys = F.array(*[F.lit(k) for k in ("server", "cookies", "patient", "2010", "hotel", "advertisement")])
    won = F.filter(keys, lambda k: ~F.contains("old", k) & F.contains("new", k))
    lost = F.filter(keys, lambda k: F.contains("old", k) & ~F.contains("new", k))
    return x.select("id", F.array_join(won, ",").alias("won"), F.array_join(lost, ",").alias("lost"))


QUERIES = {f.__name__: f for f in (
    chunk_fixed, chunk_sliding, chunk_overlap, chunk_sentence, chunk_regex, chunk_topic, para_dedup, content_hash_groups, reading_time, citation_refs,
    citation_text, bm25_blocks, page_titles, page_visible_text, page_links, page_link_counts, page_headings, page_block_class, error_codes,
    delivery_error_codes, page_error_codes, page_block_reasons, page_noscript, price_parse, text_formats, hex_ids, pipe_tables, keyword_changes,
)}

_W = r"list_filter(regexp_split_to_array(trim(markdown), '\s+'), lambda x: x <> '')"
_SRC = f"with x as (select page_id, markdown, {_W} as w from pages where markdown is not null)"


def _pos(listed: str, src: str = "x") -> str:
    return f"select page_id, (unnest(generate_series(0, len({listed}) - 1)))::int as n, unnest({listed}) as chunk from {src}"


_TRIM = r"list_filter(list_transform({}, lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '')"
_SENT = r"string_split(regexp_replace(regexp_replace(markdown, '([.!?])\s+([A-Z])', '\1␞\2', 'g'), '([.!?])\s+([A-Z])', '\1␞\2', 'g'), '␞')"
_TOPIC = r"string_split(regexp_replace(markdown, '(?m)^(#{1,6}\s)', '␞\1', 'g'), '␞')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOK = rf"list_filter(regexp_extract_all(lower({{}}), '[\p{{{{L}}}}\p{{{{N}}}}_]+'), lambda y: regexp_matches(y, '^[a-z]{{{{2,}}}}$') and y not in ({_STOP}))"
_TOKEN = lambda c: _TOK.replace("{{", "{").replace("}}", "}").replace("{{", "{").replace("}}", "}").replace("{}", c)
_BODY = r"case when regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') then regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) else html end"
_VIS = rf"trim(regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?is)<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_LOW = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')))".replace("{}", _BODY)


def _has(x: str, phrases: list[str]) -> str:
    return "(" + " or ".join("contains({}, '{}')".format(x, p.replace("'", "''")) for p in phrases) + ")"


_ERR = f"""case when {_has('lower(error)', ['timeout', 'timed out', 'timedout'])} then 'TIMEOUT'
  when {_has('lower(error)', ['connection', 'dns', 'resolve', 'refused', 'unreachable', 'network', 'ssl', 'certificate', 'eof'])} then 'NETWORK_ERROR'
  when contains(lower(error), 'all scraping strategies failed') then 'BLOCKED_BY_WAF' else 'OTHER' end"""
_PAGE_ERR = f"""case when {_has('h', ['captcha', 'recaptcha', 'hcaptcha', 'verify you are human', "verify you're human"])} then 'CAPTCHA_REQUIRED'
  when {_has('h', ['access denied', 'blocked', '403 forbidden', 'cloudflare', 'performance & security by', 'sucuri', 'incapsula', 'datadome', 'perimeterx'])} or status_code in (403, 451) then 'BLOCKED_BY_WAF'
  when {_has('h', ['javascript is disabled', 'enable javascript', 'requires javascript', 'javascript is required'])} then 'JS_REQUIRED' end"""
_REASON = " ".join(
    "when {} then '{}'".format(" or ".join(([_has("h", words)] if words else []) + ([f"s in ({', '.join(map(str, codes))})"] if codes else [])), text.replace("'", "''"))
    for text, words, codes in H.REASONS
)
SQL = {
    "chunk_fixed": f"{_SRC} {_pos('''list_transform(range(0, len(w), 60), lambda i: array_to_string(w[i + 1 : i + 60], ' '))''')}",
    "chunk_sliding": f"""{_SRC}, y as (select page_id, case when len(w) = 0 then [] when len(w) <= 60 then [markdown] else list_concat(
        list_transform(generate_series(0, len(w) - 60, 25), lambda i: array_to_string(w[i + 1 : i + 60], ' ')),
        case when (len(w) - 60) % 25 <> 0 then [array_to_string(w[len(w) - 59 : len(w)], ' ')] else [] end) end as c from x) {_pos('c', 'y')}""",
    "chunk_overlap": f"""{_SRC}, y as (select page_id, case when len(w) = 0 then [] when len(w) <= 80 then [markdown] else
        list_transform(range(0, (ceil((len(w) - 80) / 60.0)::int + 1) * 60, 60), lambda i: array_to_string(w[i + 1 : i + 80], ' ')) end as c from x) {_pos('c', 'y')}""",
    "chunk_sentence": f"{_SRC}, y as (select page_id, {_TRIM.format(_SENT)} as c from x) {_pos('c', 'y')}",
    "chunk_regex": f"{_SRC}, y as (select page_id, {_TRIM.format('string_split(markdown, chr(10) || chr(10))')} as c from x) {_pos('c', 'y')}",
    "chunk_topic": f"{_SRC}, y as (select page_id, {_TRIM.format(_TOPIC)} as c from x) {_pos('c', 'y')}",
    "para_dedup": r"""with x as (select page_id, markdown || chr(10) || chr(10) || markdown as m from pages where markdown is not null),
        p as (select page_id, unnest(regexp_split_to_array(m, '\n{2,}')) as part, generate_subscripts(regexp_split_to_array(m, '\n{2,}'), 1) as i from x),
        k as (select *, row_number() over (partition by page_id, lower(trim(regexp_replace(part, '\s+', ' ', 'g'))) order by i) as n from p)
        select page_id, string_agg(part, chr(10) || chr(10) order by i) as markdown from k where length(trim(part, ' ')) < 80 or n = 1 group by page_id""",
    "content_hash_groups": r"select md5(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '))) as hash, count(*) as copies, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1",
    "reading_time": f"{_SRC} select page_id, len(w)::int as words, (greatest(1, round_even(len(w) / 200.0, 0)::int) * 60)::int as seconds from x",
    "citation_refs": r"""with a as (select page_id, regexp_extract_all(markdown, '\[([^\]]+)\]\(([^)]+)\)', 2) as u, regexp_extract_all(markdown, '\[([^\]]+)\]\(([^)]+)\)', 1) as t from pages where markdown is not null),
        x as (select page_id, unnest(u) as u, unnest(t) as t, generate_subscripts(u, 1) as i from a),
        y as (select page_id, u, min(i) as i, arg_min(t, i) as t from x group by page_id, u), z as (select *, row_number() over (partition by page_id order by i) as k from y)
        select page_id, (k - 1)::int as n, '⟨' || k || '⟩ ' || u || ' — ' || t as ref from z""",
    "citation_text": r"""with a as (select page_id, regexp_extract_all(markdown, '\[([^\]]+)\]\(([^)]+)\)', 2) as u, regexp_extract_all(markdown, '\[([^\]]+)\]\(([^)]+)\)', 1) as t,
            regexp_split_to_array(markdown, '\[[^\]]+\]\([^)]+\)') as p from pages where markdown is not null),
        x as (select page_id, unnest(u) as u, unnest(t) as t, generate_subscripts(u, 1) as i from a), f as (select page_id, u, min(i) as first from x group by all),
        r as (select page_id, u, row_number() over (partition by page_id order by first) as k from f), n as (select page_id, i, t, k from x join r using (page_id, u)),
        q as (select page_id, unnest(p) as part, generate_subscripts(p, 1) as i from a)
        select page_id, string_agg(part || coalesce(t || '⟨' || k || '⟩', ''), '' order by i) as cited from q left join n using (page_id, i) group by page_id""",
    "bm25_blocks": rf"""with x as (select page_id, markdown, concat_ws(' ', title, regexp_extract(markdown, '(?m)^# +(.+)$', 1), description) as own from pages where markdown is not null),
        q as (select page_id, term, count(*) as times from (select page_id, unnest({_TOKEN('own')}) as term from x) group by all),
        y as (select page_id, {_TRIM.format('string_split(markdown, chr(10) || chr(10))')} as c from x),
        b as (select page_id, unnest(generate_series(0, len(c) - 1)) as block, unnest(c) as text from y),
        l as (select *, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda z: z <> '')) as dl, case when regexp_matches(text, '^# ') then 5.0 when regexp_matches(text, '^## ') then 4.0
            when regexp_matches(text, '^### ') then 3.0 when regexp_matches(text, '^#### ') then 2.5 when regexp_matches(text, '^##### ') then 2.0 when regexp_matches(text, '^###### ') then 1.5
            when starts_with(text, '>') then 2.0 when starts_with(text, '```') then 1.5 else 1.0 end::double as weight from b),
        m as (select *, count(*) over (partition by page_id) as n, avg(dl) over (partition by page_id) as avgdl from l where dl >= 5),
        t as (select page_id, block, dl, n, avgdl, weight, unnest({_TOKEN('text')}) as term from m),
        f as (select page_id, block, dl, n, avgdl, weight, term, count(*) as tf from t group by all),
        g as (select *, times * count(*) over (partition by page_id, term) as df from f join q using (page_id, term)),
        h as (select page_id, block, any_value(weight) * sum(times * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) as score from g group by all),
        e as (select m.page_id, m.block, round(coalesce(score, 0), 6) as score from m left join h using (page_id, block)),
        o as (select *, max(score) over (partition by page_id) as best from e)
        select page_id, block::int as block, score from o where score >= 1 or best < 1""",
    "page_error_codes": f"with x as (select page_id, coalesce(lower(html), '') as h, coalesce(status_code, 0) as status_code from pages) select page_id, {_PAGE_ERR} as code from x where h <> '' and {_PAGE_ERR} is not null",
    "page_block_reasons": f"""with x as (select coalesce(lower(html), '') as h, coalesce(status_code, 0) as s from pages where html is not null or status_code >= 400)
        select case {_REASON} else '{H.NO_REASON}' end as reason, count(*) as pages from x group by 1""",
    "page_noscript": f"select page_id, contains(lower(html), '<noscript') and length({_LOW}) < 300 as noscript from pages where html is not null",
    "page_titles": r"""select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as html_title,
        regexp_extract(html, '(?i)<html\b[^>]*\blang="([^"]*)"', 1) as html_lang, regexp_extract(html, '(?is)<meta\s+name="description"\s+content="([^"]*)"', 1) as html_description from pages where html is not null""",
    "page_visible_text": f"select page_id, {_VIS} as visible from pages where html is not null",
    "page_links": r"""select distinct page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) as href from pages where html is not null""",
    "page_link_counts": r"""with x as (select page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) as h from pages where html is not null)
        select page_id, len(h)::int as links, len(list_filter(h, lambda y: regexp_matches(y, '^/[^/]|^/$|^#')))::int as relative from x""",
    "page_headings": r"""with x as (select page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>') as h from pages where html is not null),
        y as (select page_id, list_filter(list_transform(h, lambda z: {'level': substr(z, 3, 1)::int, 'text': trim(regexp_replace(regexp_replace(z, '(?s)<[^>]+>', '', 'g'), '\s+', ' ', 'g'))}), lambda z: z.text <> '') as h from x),
        z as (select page_id, unnest(generate_series(0, len(h) - 1))::int as n, unnest(h) as v from y) select page_id, n, v.level as level, v.text as text from z""",
    "page_block_class": f"""with x as (select page_id, html, lower(html) as h, {_LOW} as t, lower(substr(html, 1, 5000)) as head, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title from pages where html is not null),
        y as (select *, length(t) as n from x) select page_id, case when html = '' then true when {_has('h', H.CHALLENGE_MARKS)} then true when n > 3000 then false
            when n >= 800 and {_has('t', H.STRONG_PHRASES)} then true when n < 800 and {_has('t', H.SHORT_PHRASES)} then true when {_has('head', H.HEAD_PHRASES)} then true
            when n < 300 and contains(h, '<noscript') then true
            when n < 500 then contains(title, 'google') or {' + '.join(f"contains(t, '{p}')::int" for p in H.STORE_PHRASES)} >= 2 or {_has('t', H.GONE_PHRASES)} else false end as blocked from y""",
    "error_codes": f"select {_ERR} as code, count(*) as jobs from jobs where error is not null group by 1",
    "delivery_error_codes": f"select {_ERR} as code, count(*) as n from webhook_deliveries where error is not null group by 1",
    "price_parse": """select p_partkey, round(p_retailprice, 2) as price, case p_partkey % 6 when 0 then 'USD' when 1 then 'EUR' when 2 then 'GBP' when 3 then 'USD' when 4 then 'SEK' end as currency from part""",
    "text_formats": r"""select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
        regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as type_id,
        case when p_size * 7 < 60 then (p_size * 7) || ' min' when (p_size * 7) % 60 = 0 then (p_size * 7) // 60 || ' hr' else (p_size * 7) // 60 || ' hr ' || (p_size * 7) % 60 || ' min' end as duration,
        case when p_size > 25 then '+' else '' end || printf('%.2f%%', (p_size - 25) / 3.0::double) as change from part""",
    "hex_ids": "select page_id, ('0x' || substr(md5(url), 1, 16))::ubigint::varchar as decimal from pages",
    "pipe_tables": "select n_nationkey, '| ' || n_nationkey || ' | ' || n_name || ' | ' || r_name || ' |' as row from nation join region on n_regionkey = r_regionkey",
    "keyword_changes": """with x as (select id, lower(markdown) as new, lag(lower(markdown)) over (partition by url order by created_at, id) as old from job_results where markdown is not null),
        k as (select ['server', 'cookies', 'patient', '2010', 'hotel', 'advertisement'] as keys)
        select id, array_to_string(list_filter(keys, lambda z: not contains(old, z) and contains(new, z)), ',') as won,
        array_to_string(list_filter(keys, lambda z: contains(old, z) and not contains(new, z)), ',') as lost from x, k where old is not null""",
}
