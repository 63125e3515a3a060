"""Queries of graph traversal, stateful operators, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.operators import graph as G
from weftline.plans.urls import URL_CTE
from weftline.session import table
from weftline.sources import documents as D
from weftline.sources import sinks
from weftline.streaming import state as S


def _edges(s, d):
    return table(s, d, "job_results").select(U.domain("url").alias("src"), F.explode("links").alias("l")).select("src", U.domain("l").alias("dst"))


def _trade(s, d):
    """A graph of parts and suppliers, both ways."""
    li = table(s, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"))
    return li.select(F.col("s").alias("src"), F.col("p").alias("dst")).union(li.select("p", "s"))


def graph_bfs(s, d):
    """Nodes within three steps of one supplier."""
    return G.breadth_first(_trade(s, d), s.createDataFrame([("s1",)], "url string"), 3)


def graph_best_first(s, d):
    """Twenty rounds of the best ten nodes by number. Depth is bounded, as a crawl's is: nodes five links from the
    seed are visited but their links aren't followed."""
    score = -F.regexp_extract("url", r"(\d+)", 1).cast("double")
    return G.best_first(_trade(s, d), s.createDataFrame([("s1",)], "url string"), score, 10, 20, 5)


def graph_dfs(s, d):
    """Depth-first visit of each host's pages by their links."""
    from pyspark.sql import Window

    j = table(s, d, "job_results").select("id", F.col("url").alias("src"), U.domain("url").alias("site"), F.posexplode("links").alias("pos", "dst"))
    seeds = j.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("id", "pos"))).where("n = 1").select("site", F.col("src").alias("url"))
    return G.depth_first(j.select("site", "src", "dst", "pos"), seeds, 3, 50)


def graph_frontier(s, d):
    """What the links of the crawled pages add to the frontier."""
    j = table(s, d, "job_results").select("id", "url", "links")
    found = j.select((F.col("id") * 1000).alias("base"), F.posexplode("links").alias("p", "url")).select("url", (F.col("base") + F.col("p")).alias("pos"))
    seen = j.select(U.crawl_key("url").alias("key")).distinct()
    return G.admitted(found, seen, U.crawl_key("url"), ~U.map_junk("url"), 500)


def _requests(s, d):
    """Requests of each user, an hour of the table's time as a second."""
    e = table(s, d, "events")
    return e.select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) / 1e6D / 3600").alias("s"), (F.col("event_type") != "error").alias("ok"))


def circuit_breaker(s, d):
    return S.circuit_breaker(_requests(s, d))


def document_types(s, d):
    p = table(s, d, "pages").where("html is not null")
    path = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(F.pmod("page_id", F.lit(5)) == 0, ".pdf?x=1").when(F.pmod("page_id", F.lit(5)) == 1, ".CSV").otherwise(""))
    ct = F.when(F.pmod("page_id", F.lit(3)) == 0, "application/epub+zip")
    return p.select("page_id", D.document_type(path, ct, F.col("html").cast("binary")).alias("kind"))


def sitemap_rows(s, d):
    """Site maps of at most five hundred pages, written and read again."""
    p = table(s, d, "pages")
    one = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc><lastmod>"), F.date_format("scraped_at", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    return D.sitemap(p.groupBy(U.domain("url"), F.floor(F.col("page_id") / 500)).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(one), ""), F.lit("</urlset>")).alias("xml"))).select("loc", "lastmod")


def robots_rules(s, d):
    p = table(s, d, "pages").select("page_id", "url", U.domain("url").alias("host"))
    hosts = p.select("host").distinct()
    rules = hosts.select("host", F.lit(False).alias("allow"), F.lit("/archive/").alias("prefix")).union(hosts.select("host", F.lit(True), F.lit("/archive/the-")))
    return D.robots_allowed(p, rules, U.path("url"))


def signed_bodies(s, d):
    b = table(s, d, "jobs").select("id", F.to_json(F.struct("id", "status")).alias("body"))
    return sinks.signed(b, "body", "secret")


def archive_names(s, d):
    return table(s, d, "pages").select("page_id", sinks.file_name(F.col("url"), F.col("page_id")).alias("name"))


def _pad(x: int) -> str:
    return bytes(k ^ x for k in b"secret".ljust(64, b"\0")).hex()


_FOUND = URL_CTE.replace("select page_id, url from pages", "select -id as page_id, url from job_results union all select id * 1000 + p, url from (select id, unnest(links) as url, generate_subscripts(links, 1) - 1 as p from job_results)")
_BREAKER = """with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6::double / 3600 as s, event_type <> 'error' as ok from events where user_id is not null),
    o as (select *, row_number() over (partition by user_id order by s, event_id) as n from e),
    w as (select user_id, n, event_id, case when ok then 'closed' else 'closed' end as state, case when ok then [] else [s] end as fails, 0.0::double as opened, true as passed from o where n = 1
      union all select x.user_id, x.n, x.event_id,
        case when x.was = 'open' then 'open' when x.ok then 'closed' when x.was = 'half_open' or len(x.f) >= 5 then 'open' else 'closed' end,
        case when x.was = 'open' then x.fails when x.ok or x.was = 'half_open' or len(x.f) >= 5 then [] else x.f end,
        case when x.was = 'open' then x.opened when x.ok then 0 when x.was = 'half_open' or len(x.f) >= 5 then x.s else 0 end, x.was <> 'open'
      from (select o.user_id, o.n, o.event_id, o.s, o.ok, w.fails, w.opened, case when w.state = 'open' and o.s - w.opened >= 30 then 'half_open' else w.state end as was,
              list_append(list_filter(w.fails, lambda t: o.s - t < 60), o.s) as f from w join o on o.user_id = w.user_id and o.n = w.n + 1) x)
    select user_id, event_id, state, passed from w"""
QUERIES = {f.__name__: f for f in (graph_bfs, graph_best_first, graph_dfs, graph_frontier, circuit_breaker, document_types, sitemap_rows, robots_rules, signed_bodies, archive_names)}
SQL = {
    "signed_bodies": f"""with x as (select id, '{{{{"id":' || id || ',"status":"' || status || '"}}}}' as body from jobs)
        select id, body, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(body)))) as signature from x""".replace("{{", "{").replace("}}", "}"),
    "graph_frontier": f"""with {_FOUND}, seen as (select distinct ckey from n where page_id < 0),
        f as (select ckey as key, arg_min(url, page_id) as url, min(page_id) as pos from n where page_id > 0 and ckey not in (select ckey from seen where ckey is not null)
          and not ({" or ".join(f"contains(lower(regexp_replace(regexp_extract(url, '{U.PARTS}', 3), ';[^/]*$', '')), '{j}')" for j in U.MAP_JUNK)}) group by ckey)
        select url, key from f order by pos, key limit 500""",
    "circuit_breaker": _BREAKER,
    "graph_bfs": """with recursive e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem),
        w(url, depth) as (select 's1', 0 union select dst, depth + 1 from w join e on src = url where depth < 3) select url, min(depth)::int as depth from w group by url""",
    "document_types": """select page_id, case when page_id % 5 = 0 then 'pdf' when page_id % 5 = 1 then 'csv' when page_id % 3 = 0 then 'epub' else 'html' end as kind from pages where html is not null""",
    "sitemap_rows": "select url as loc, strftime(scraped_at, '%Y-%m-%d') as lastmod from pages",
    "robots_rules": r"""select page_id, not (starts_with(p, '/archive/') and not starts_with(p, '/archive/the-')) as allowed
        from (select page_id, regexp_extract(url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)', 3) as p from pages)""",
    "archive_names": """select page_id, lpad(page_id::varchar, 8, '0') || '_' ||
        coalesce(nullif(substr(trim(regexp_replace(regexp_replace(url, 'https?://', '', 'g'), '[^a-zA-Z0-9._-]', '_', 'g'), '_'), 1, 120), ''), 'page') as name from pages""",
}
