"""Lookups, fallbacks, embedded data, ranks after filters, differences between versions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.plans.texts import _VIS
from weftline.plans.urls import URL_CTE
from weftline.session import table

def config_join(s, d):
    """Pages under the address that their job was configured with (join on a JSON path)."""
    j = table(s, d, "jobs").select(F.col("id").alias("job_id"), U.domain(F.get_json_object("config", "$.url")).alias("site"))
    p = table(s, d, "pages").select("page_id", "job_id", U.domain("url").alias("host"))
    return p.join(j, "job_id").where("host = site").select("page_id", "job_id", "site")


def lookup_first(s, d):
    """For each crawled page the first single page of the same normalised address."""
    p = table(s, d, "pages").groupBy(U.normalized("url").alias("page")).agg(F.min("page_id").alias("page_id")).where("page is not null")
    return table(s, d, "job_results").select("id", U.normalized("url").alias("page")).join(p, "page").select("id", "page_id")


def locale_lookup(s, d):
    """Pages by the languages that their host's ending asks for."""
    return table(s, d, "pages").groupBy(U.locale("url").alias("locale")).agg(F.count("*").alias("pages"))


def thin_pages(s, d):
    """Pages of fewer than 15 words."""
    return table(s, d, "job_results").where("markdown is not null").select("id", T.word_count("markdown").alias("words")).where("words < 15")


def enriched_results(s, d):
    """Thin pages get title and description in front, failed ones have nothing else."""
    p = table(s, d, "pages").select("page_id", F.coalesce("title", F.lit("")).alias("t"), F.coalesce("description", F.lit("")).alias("de"), "markdown")
    head = F.concat(F.lit("# "), "t", F.lit("\n\n"), "de")
    made = F.when(F.col("markdown").isNull(), head).when(T.word_count("markdown") < 50, F.concat(head, F.lit("\n\n---\n\n"), "markdown")).otherwise(F.col("markdown"))
    return p.select("page_id", F.md5(made).alias("hash"), F.length(made).alias("size"))


def source_fallback(s, d):
    """For each job the first table that has pages of it."""
    a = table(s, d, "job_results").select("job_id", F.lit(0).alias("rank"))
    b = table(s, d, "pages").where("job_id is not null").select("job_id", F.lit(1))
    return a.union(b).groupBy("job_id").agg(F.min("rank").alias("source"), F.count("*").alias("pages"))


def ranked_pages(s, d):
    """Positions renumbered after a filter and a sort in which unknown sizes count as none."""
    w = Window.partitionBy("status_code").orderBy(F.coalesce("content_length", F.lit(0)).desc(), "page_id")
    p = table(s, d, "pages").where("status_code >= 400").withColumn("position", F.row_number().over(w))
    return p.where("position <= 10").select("status_code", "position", "page_id")


def embedded_config(s, d):
    """The JSON object that pages hold in a script, parsed; broken ones give nulls."""
    raw = F.regexp_extract("html", r"window\.__cfg=(\{[^<]*?\});", 1)
    p = table(s, d, "pages").where("html is not null").select("page_id", raw.alias("raw")).where("raw <> ''")
    return p.select("page_id", F.get_json_object("raw", "$.site").alias("site"), F.get_json_object("raw", "$.build").cast("int").alias("build"))


def page_metadata(s, d):
    """Title, language, description and robots of the source with size and reading time of its text."""
    p = table(s, d, "pages").where("html is not null")
    words = F.size(F.filter(F.split(H.visible_text("html"), " "), lambda x: x != ""))
    return p.select(
        "page_id", H.title("html").alias("html_title"), H.language("html").alias("html_lang"), H.meta("html", "robots").alias("html_robots"), F.length("html").alias("html_length"),
        words.alias("words"), (F.ceil(words / 200) * 60).cast("int").alias("seconds"),
    )


def link_directions(s, d):
    """Links inside the site, to sites of the same owner, and to others."""
    x = table(s, d, "job_results").select("id", "url", F.explode("links").alias("link"))
    kind = F.when(U.netloc("link") == U.netloc("url"), "internal").when(U.last_two_labels("link") == U.last_two_labels("url"), "related").otherwise("external")
    return x.groupBy("id").agg(*[F.count_if(kind == k).alias(k) for k in ("internal", "related", "external")])


def overdue_monitors(s, d):
    """The fifty monitors that are due first: active ones (their last check wasn't an error) whose next check, two hours
    after the last, isn't later than the table's end."""
    c = table(s, d, "monitor_checks").groupBy("monitor_id").agg(F.max("checked_at").alias("last"), F.max_by("status_code", F.struct("checked_at", "id")).alias("status"))
    now = c.agg(F.max("last").alias("now"))
    due = c.crossJoin(F.broadcast(now)).where(F.expr("coalesce(status, 0) < 500 and last + interval 2 hours <= now"))  # one row
    return due.orderBy("last", "monitor_id").limit(50).select("monitor_id", F.expr("last + interval 2 hours").alias("next_check"))


def search_grid(s, d):
    """Offsets of a search in rings of eight directions, and the map scale that shows each ring."""
    r = s.range(1, 5).select(F.col("id").cast("int").alias("ring"))
    g = r.select("ring", F.explode(F.expr("flatten(transform(array(-1, 0, 1), x -> transform(array(-1, 0, 1), y -> named_struct('x', x, 'y', y))))")).alias("o")).where("not (o.x = 0 and o.y = 0)")
    zoom = F.least(F.lit(21), F.greatest(F.lit(1), F.bround(14 - F.log2(F.col("ring") * 2.5)).cast("int")))
    return g.select("ring", (F.col("o.x") * F.col("ring")).alias("dx"), (F.col("o.y") * F.col("ring")).alias("dy"), zoom.alias("zoom"))


def version_diffs(s, d):
    """Lines added and removed and likeness between successive versions of a page."""
    import pandas as pd

    w = Window.partitionBy("page").orderBy("created_at", "id")
    x = table(s, d, "job_results").where("markdown is not null").select("id", U.normalized("url").alias("page"), "created_at", "markdown")
    x = x.withColumn("old", F.lag("markdown").over(w)).where("old is not null").select("id", "old", F.col("markdown").alias("new"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                m = SequenceMatcher(None, r.old.splitlines(), r.new.splitlines())
                n = {"insert": 0, "delete": 0, "replace": 0}
                for op, a, c, e, f in m.get_opcodes():
                    if op != "equal":
                        n[op] += max(c - a, f - e)
                rows.append((r.id, round(m.ratio(), 4), n["insert"], n["delete"], n["replace"]))
            yield pd.DataFrame(rows, columns=["id", "ratio", "added", "removed", "changed"])

    return x.mapInPandas(run, "id bigint, ratio double, added int, removed int, changed int")


QUERIES = {f.__name__: f for f in (
    config_join, lookup_first, locale_lookup, thin_pages, enriched_results, source_fallback, ranked_pages, embedded_config, page_metadata, link_directions,
    overdue_monitors, search_grid, version_diffs,
)}

_NET = "regexp_extract({}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?', 2)"
_DOM = r"regexp_replace(lower(" + _NET + r"), '^www\.', '')"
_TWO = lambda c: f"list_element(string_split({_DOM.format(c)}, '.'), -2) || '.' || list_element(string_split({_DOM.format(c)}, '.'), -1)"
_WORDS = r"len(list_filter(regexp_split_to_array(trim(markdown), '\s+'), lambda x: x <> ''))"


_BOTH = URL_CTE.replace("select page_id, url from pages", "select page_id, url from pages union all select -id, url from job_results")
_MADE = f"""case when markdown is null then '# ' || t || chr(10) || chr(10) || de when {_WORDS} < 50
  then '# ' || t || chr(10) || chr(10) || de || chr(10) || chr(10) || '---' || chr(10) || chr(10) || markdown else markdown end"""
SQL = {
    "config_join": f"""select page_id, job_id, {_DOM.format("json_extract_string(config, '$.url')")} as site from pages p join jobs j on p.job_id = j.id
        where {_DOM.format('p.url')} = {_DOM.format("json_extract_string(config, '$.url')")}""",
    "lookup_first": f"""with {_BOTH}, p1 as (select norm, min(page_id) as first from n where page_id > 0 and norm is not null group by norm)
        select -n.page_id as id, p1.first as page_id from n join p1 using (norm) where n.page_id < 0""",
    "locale_lookup": f"""with x as (select lower({_NET.format('url')}) as h from pages) select case when h like '%.com.au' then 'en-AU,en;q=0.9' when h like '%.co.uk' then 'en-GB,en;q=0.9'
        when h like '%.co.jp' then 'ja-JP,ja;q=0.9,en;q=0.8' when h like '%.in' then 'en-IN,en;q=0.9,hi;q=0.8' when h like '%.de' then 'de-DE,de;q=0.9,en;q=0.8' when h like '%.fr' then 'fr-FR,fr;q=0.9,en;q=0.8'
        when h like '%.es' then 'es-ES,es;q=0.9,en;q=0.8' when h like '%.it' then 'it-IT,it;q=0.9,en;q=0.8' when h like '%.ca' then 'en-CA,en;q=0.9' else 'en-US,en;q=0.9' end as locale, count(*) as pages from x group by 1""",
    "thin_pages": f"select id, {_WORDS}::int as words from job_results where markdown is not null and {_WORDS} < 15",
    "enriched_results": f"select page_id, md5({_MADE}) as hash, length({_MADE})::int as size from (select page_id, coalesce(title, '') as t, coalesce(description, '') as de, markdown from pages)",
    "source_fallback": "select job_id, min(rank)::int as source, count(*) as pages from (select job_id, 0 as rank from job_results union all select job_id, 1 from pages where job_id is not null) group by 1",
    "ranked_pages": """select status_code, position::int as position, page_id from (select status_code, page_id, row_number() over (partition by status_code
        order by coalesce(content_length, 0) desc, page_id) as position from pages where status_code >= 400) where position <= 10""",
    "embedded_config": r"""with x as (select page_id, regexp_extract(html, 'window\.__cfg=(\{[^<]*?\});', 1) as raw from pages where html is not null)
        select page_id, json_extract_string(raw, '$.site') as site, json_extract_string(raw, '$.build')::int as build from x where raw <> ''""",
    "page_metadata": rf"""with x as (select page_id, html, len(list_filter(string_split({_VIS}, ' '), lambda y: y <> '')) as w from pages where html is not null)
        select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as html_title,
        regexp_extract(html, '(?i)<html\b[^>]*\blang="([^"]*)"', 1) as html_lang, regexp_extract(html, '(?is)<meta\s+name="robots"\s+content="([^"]*)"', 1) as html_robots,
        length(html)::int as html_length, w::int as words, (ceil(w / 200.0) * 60)::int as seconds from x""",
    "link_directions": f"""with x as (select id, url, unnest(links) as link from job_results), y as (select id, case when {_NET.format('link')} = {_NET.format('url')} then 'internal'
        when {_TWO('link')} = {_TWO('url')} then 'related' else 'external' end as k from x)
        select id, count(*) filter (k = 'internal') as internal, count(*) filter (k = 'related') as related, count(*) filter (k = 'external') as external from y group by id""",
    "overdue_monitors": """with c as (select monitor_id, max(checked_at) as last, arg_max(status_code, (checked_at, id)) as status from (select * from monitor_checks where checked_at is not null) group by 1)
        select monitor_id, last + interval 2 hours as next_check from c where coalesce(status, 0) < 500 and last + interval 2 hours <= (select max(last) from c) order by last, monitor_id limit 50""",
    "search_grid": """select ring::int as ring, (x * ring)::int as dx, (y * ring)::int as dy, least(21, greatest(1, round_even(14 - log2(ring * 2.5), 0)::int))::int as zoom
        from generate_series(1, 4) r(ring), (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(y) where not (x = 0 and y = 0)""",
}
