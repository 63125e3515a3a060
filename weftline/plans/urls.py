"""Queries over the URLs of ``pages`` and ``job_results``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.session import table

# The SQL of a URL's parts, normal form and crawl key, for the oracle: macros written as common table expressions.
_P = U.PARTS
_IN = lambda names: ", ".join("'" + n + "'" for n in names)
URL_CTE = rf"""
src as (select page_id, url from pages),
p as (select page_id, url, lower(regexp_extract(url, '{_P}', 1)) as scheme, regexp_extract(url, '{_P}', 2) as netloc,
             regexp_replace(regexp_extract(url, '{_P}', 3), ';[^/]*$', '') as path, regexp_extract(url, '{_P}', 4) as query from src),
kv as (select page_id, url, i, split_part(part, '=', 1) as k0, case when instr(part, '=') > 0 then substr(part, instr(part, '=') + 1) else '' end as v0
       from (select page_id, url, unnest(string_split(query, '&')) as part, generate_subscripts(string_split(query, '&'), 1) as i from p) where part <> ''),
kd as (select page_id, url, i, url_decode(replace(k0, '+', ' ')) as k, url_decode(replace(v0, '+', ' ')) as v from kv),
kf as (select *, first_value(v) over (partition by page_id, url, k order by i) as v1 from kd),
kk as (select * from kf where lower(k) not in ({_IN(U.TRACKING)})
       and (lower(k) in ({_IN(U.CONTENT_IDS)}) or not regexp_matches(v1, '{U.SESSION}'))),
ke as (select page_id, url, k, i, replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+') as e from kk),
q as (select page_id, url, string_agg(e, '&' order by k, i) as q,
             string_agg(e, '&' order by k, i) filter (lower(k) not in ({_IN(U.NAVIGATION)})) as qc from ke group by page_id, url),
b0 as (select *, case when scheme = '' then 'https' else scheme end as s, regexp_extract(netloc, '^(.*@)', 1) as usr,
              regexp_replace(netloc, '^.*@', '') as hp, regexp_replace(case when path = '' then '/' else path end, '/{{2,}}', '/', 'g') as p1 from p),
b1 as (select *, regexp_extract(hp, ':([^:\]]*)$', 1) as port, regexp_replace(lower(regexp_replace(hp, ':[^:\]]*$', '')), '^www\.', '') as name,
              regexp_replace(case when length(p1) > 1 then regexp_replace(p1, '/+$', '') else p1 end, '/index\.html?$', '') as p2 from b0),
b as (select page_id, url, s || '://' || usr || name || case when port = '' or (s = 'http' and port = '80') or (s = 'https' and port = '443')
             then '' else ':' || port end || case when p2 = '' then '/' else p2 end as base from b1),
n as (select b.page_id, b.url, base || case when q.q is null then '' else '?' || q.q end as norm,
             base || case when q.qc is null then '' else '?' || q.qc end as ckey from b left join q using (page_id, url))
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def url_normalize(spark, d):
    return pages(spark, d).select("page_id", U.normalized("url").alias("normalized"))


def url_normalize_crawl(spark, d):
    return pages(spark, d).select("page_id", U.crawl_key("url").alias("crawl_key"))


def url_dedup_first(spark, d):
    """Keep the first page of each normal form."""
    first = Window.partitionBy("normalized").orderBy("page_id")
    x = pages(spark, d).select("page_id", U.normalized("url").alias("normalized"))
    return x.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def url_facet_groups(spark, d):
    """Pages that are variations of one another, by crawl key."""
    x = pages(spark, d).groupBy(U.crawl_key("url").alias("crawl_key")).agg(F.count("*").alias("variations"), F.min("page_id").alias("first_page"))
    return x.where("variations > 1")


def url_parts(spark, d):
    return pages(spark, d).select(
        "page_id", U.domain("url").alias("domain"), U.path("url").alias("path"), F.size(U.segments("url")).alias("depth"),
        U.last_two_labels("url").alias("site"), U.homepage("url").alias("homepage"), U.with_scheme(F.regexp_replace("url", "^https?://", "")).alias("with_scheme"),
    )


def url_scores(spark, d):
    kw, depth = U.keyword_score("url", ["docs", "archive", "2010"]), U.depth_score("url")
    end, fresh = U.ending_weight("url"), U.freshness_score("url")
    return pages(spark, d).select(
        "page_id", kw.alias("keyword"), depth.alias("depth"), end.alias("ending"), fresh.alias("fresh"),
        U.composite_score([(kw, 2.0), (depth, 1.0), (end, 1.0), (fresh, 0.5)]).alias("score"),
    )


def url_filter_chain(spark, d):
    """Pattern, domain, ending and junk filters together."""
    ok = U.pattern_filter("url", ("/*/*",)) & ~U.map_junk("url") & U.is_page("url") & U.domain_filter("url", blocked=("docs.morlumixotas.example",))
    return pages(spark, d).where(ok).select("page_id", "url")


def url_pattern_filters(spark, d):
    """Globs or patterns, one of them negated, and a list of allowed hosts from the table itself."""
    some = U.pattern_filter("url", ("/news/*", "/blog/*"), (r"-[0-9]{5}$",)) & U.pattern_filter("url", ("*storm*",), negate=True)
    p = pages(spark, d)
    hosts = p.where("page_id % 2 = 0").select(U.domain("url").alias("domain")).distinct()
    return p.where(some & U.domain("url").endswith(".example")).withColumn("domain", U.domain("url")).join(hosts, "domain", "left_semi").select("page_id")


def url_flags(spark, d):
    """Addresses of videos, of hosts that are hard to fetch from, and of pages by their ending."""
    return pages(spark, d).select("page_id", U.is_video("url").alias("video"), U.is_hard("url").alias("hard"), U.is_page("url").alias("page"))


def url_map_normalize(spark, d):
    return pages(spark, d).select("page_id", U.map_normalized("url").alias("normalized"))


def url_request_keys(spark, d):
    """Cache keys of site map, search and crawl requests made from the jobs' configurations."""
    j = table(spark, d, "jobs").withColumn("url", F.get_json_object("config", "$.url"))
    formats = F.coalesce(F.from_json(F.get_json_object("config", "$.formats"), "array<string>"), F.array().cast("array<string>"))
    number = lambda k: F.coalesce(F.get_json_object("config", f"$.{k}"), F.lit("0"))
    return j.select(
        "id", U.map_key("url", F.col("id") % 50, F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.when(F.col("status") == "failed", F.col("error"))).alias("map_key"),
        U.search_key("url", F.lit(10), "type", formats).alias("search_key"), U.crawl_request_key("url", number("max_pages"), number("max_depth")).alias("crawl_key"),
    )


def url_should_crawl(spark, d):
    ok = U.should_crawl("url", F.size(U.segments("url")), "docs.morlumixotas.example", 2, include=("/*",), exclude=("/archive/*",))
    return pages(spark, d).where(ok).select("page_id", "url")


def url_cache_keys(spark, d):
    key = U.cache_key("url", F.array(F.lit("markdown"), F.lit("html"), F.coalesce("language", F.lit(""))))
    return pages(spark, d).select("page_id", key.alias("cache_key"))


def url_resolve(spark, d):
    """Absolute form of the links found in each page's HTML."""
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"'), 1)
    x = pages(spark, d).select("page_id", "url", F.explode(hrefs).alias("href"))
    return x.select("page_id", "href", U.resolved("href", "url").alias("target")).distinct()


def url_mask(spark, d):
    x = F.regexp_replace("url", "://", "://user:secret@")
    return pages(spark, d).select("page_id", U.masked(x).alias("masked"))


def url_map_search(spark, d):
    """Search of a site map: where the words stand decides if a page is kept."""
    t, de = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    score = F.lower("url").contains("server").cast("int") * 2 + t.contains("server").cast("int") * 3 + de.contains("server").cast("int")
    return pages(spark, d).select("page_id", score.alias("score")).where("score > 0")


QUERIES = {f.__name__: f for f in (
    url_normalize, url_normalize_crawl, url_dedup_first, url_facet_groups, url_parts, url_scores, url_filter_chain, url_should_crawl, url_pattern_filters, url_flags, url_map_normalize, url_request_keys,
    url_cache_keys, url_resolve, url_mask, url_map_search,
)}

_END = " ".join(f"when lower(path) like '%{e}' then {w}" for e, w in U.ENDING_WEIGHTS)
_JUNK = " or ".join(f"contains(lower(path), '{j}')" for j in U.MAP_JUNK)
_SEG = "list_filter(string_split(path, '/'), lambda x: x <> '')"
_DOM = r"regexp_replace(lower(netloc), '^www\.', '')"
SQL = {
    "url_normalize": f"with {URL_CTE} select page_id, norm as normalized from n",
    "url_normalize_crawl": f"with {URL_CTE} select page_id, ckey as crawl_key from n",
    "url_dedup_first": f"with {URL_CTE} select min(page_id) as page_id, norm as normalized from n group by norm",
    "url_facet_groups": f"with {URL_CTE} select ckey as crawl_key, count(*) as variations, min(page_id) as first_page from n group by ckey having count(*) > 1",
    "url_parts": f"""with {URL_CTE} select page_id, {_DOM} as domain, path, len({_SEG})::int as depth,
        list_element(string_split({_DOM}, '.'), -2) || '.' || list_element(string_split({_DOM}, '.'), -1) as site,
        case when rtrim(url, '/') = scheme || '://' || netloc then null else scheme || '://' || netloc || '/' end as homepage,
        'https://' || regexp_replace(url, '^https?://', '') as with_scheme from p""",
    "url_scores": f"""with {URL_CTE}, s as (select page_id,
        (contains(lower(url), 'docs')::int + contains(lower(url), 'archive')::int + contains(lower(url), '2010')::int) / 3.0::double as keyword,
        1.0::double / (1 + abs(len({_SEG}) - 2)) as depth, (case {_END} else 1.0 end)::double as ending,
        (case when regexp_extract(url, '(20[12][0-9])', 1) = '' then 0.5 when 2026 - regexp_extract(url, '(20[12][0-9])', 1)::int <= 0 then 1.0
              when 2026 - regexp_extract(url, '(20[12][0-9])', 1)::int = 1 then 0.9 when 2026 - regexp_extract(url, '(20[12][0-9])', 1)::int = 2 then 0.7
              when 2026 - regexp_extract(url, '(20[12][0-9])', 1)::int <= 5 then 0.4 else 0.2 end)::double as fresh from p)
        select *, (keyword * 2.0 + depth + ending + fresh * 0.5) / 4.5 as score from s""",
    "url_filter_chain": f"""with {URL_CTE} select page_id, url from p where regexp_matches(path, '^(?s:/.*/.*)$') and not ({_JUNK})
        and lower(regexp_extract(path, '(?s)^.+(\\.[^.]*)$', 1)) in ('', '.html', '.htm', '.php', '.asp', '.aspx', '.jsp', '.shtml', '.xhtml') and {_DOM} <> 'docs.morlumixotas.example'""",
    "url_pattern_filters": f"""with {URL_CTE} select page_id from p where (path like '/news/%' or path like '/blog/%' or regexp_matches(url, '-[0-9]{{5}}$')) and not regexp_matches(path, '^.*storm.*$')
        and ({_DOM} like '%.example') and {_DOM} in (select distinct {_DOM} from p where page_id % 2 = 0)""",
    "url_flags": f"""with {URL_CTE} select page_id, lower(netloc) in ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be') as video,
        regexp_matches({_DOM}, '(^|[.])({"|".join(h.replace(".", "[.]") for h in U.HARD_HOSTS)})$') or string_split({_DOM}, '.')[1] in ({_IN(U.HARD_LABELS)}) as hard,
        lower(regexp_extract(path, '(?s)^.+(\\.[^.]*)$', 1)) in ('', '.html', '.htm', '.php', '.asp', '.aspx', '.jsp', '.shtml', '.xhtml') as page from p""",
    "url_map_normalize": f"""with {URL_CTE}, f as (select *, min(i) over (partition by page_id, k) as first from kd where lower(k) not in ({_IN(U.MAP_TRACKING)})),
        e as (select page_id, string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' order by first, i) as q from f group by page_id)
        select p.page_id, case when p.query = '' then p.url else case when p.scheme = '' then '' else p.scheme || '://' end || p.netloc || regexp_extract(p.url, '{_P}', 3) || case when e.q is null then '' else '?' || e.q end end as normalized
        from p left join e using (page_id)""",
    "url_request_keys": """select id, sha256(concat_ws(':', url, (id % 50)::varchar, case when id % 2 = 0 then 'True' else 'False' end, case when id % 3 = 0 then 'True' else 'False' end, coalesce(s, ''))) as map_key,
        sha256(concat_ws(':', url, '10', type, array_to_string(list_sort(json_extract_string(config, '$.formats[*]')), ','))) as search_key,
        sha256(concat_ws(':', url, coalesce(json_extract_string(config, '$.max_pages'), '0'), coalesce(json_extract_string(config, '$.max_depth'), '0'))) as crawl_key
        from (select *, json_extract_string(config, '$.url') as url, case when status = 'failed' then error end as s from jobs)""",
    "url_should_crawl": f"""with {URL_CTE} select page_id, url from p where len({_SEG}) <= 2 and {_DOM} = 'docs.morlumixotas.example'
        and scheme in ('http', 'https') and not list_has_any(list_transform({_SEG}, lambda x: lower(x)), ['wp-admin', 'wp-login', 'wp-json', 'admin', 'login', 'logout', 'signup', 'register', 'cart', 'checkout', 'account', 'password', 'feed', 'rss', 'xmlrpc', 'cgi-bin'])
        and not regexp_matches(lower(path), '({"|".join(x.replace('.', chr(92) + '.') for x in U.SKIPPED)})$') and path like '/%' and path not like '/archive/%'""",
    "url_cache_keys": "select page_id, sha256(url || ':' || array_to_string(list_sort(['markdown', 'html', coalesce(language, '')]), ',')) as cache_key from pages",
    "url_resolve": rf"""with {URL_CTE}, h as (select page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) as href from pages),
        j as (select h.page_id, trim(h.href) as h, h.href, p.scheme || '://' || p.netloc as root, p.scheme, p.path from h join p using (page_id))
        select distinct page_id, href, case when h = '' or regexp_matches(h, '(?i)^(#|javascript:|mailto:|tel:|data:)') then null
            when regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then h when h like '//%' then scheme || ':' || h when h like '?%' then root || path || h
            else root || case when contains(q, '/.') then list_reduce(string_split(q, '/'), lambda acc, x: case when x = '..' then regexp_replace(acc, '/[^/]*$', '') when x = '.' then acc else acc || '/' || x end)
                || case when string_split(q, '/')[-1] in ('.', '..') then '/' else '' end else q end || regexp_extract(h, '[?#].*$') end as target
        from (select *, case when h like '/%' then regexp_replace(h, '[?#].*$', '') else regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || regexp_replace(h, '[?#].*$', '') end as q from j)""",
    "url_mask": "select page_id, regexp_replace(url, '://', '://***:***@') as masked from pages",
    "url_map_search": """select page_id, (contains(lower(url), 'server')::int * 2 + contains(lower(coalesce(title, '')), 'server')::int * 3
        + contains(lower(coalesce(description, '')), 'server')::int) as score from pages
        where contains(lower(url), 'server') or contains(lower(coalesce(title, '')), 'server') or contains(lower(coalesce(description, '')), 'server')""",
}
