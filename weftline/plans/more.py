"""Queries of smaller operators: exports, progress, shown values, keys for de-duplication, crawl orders, link clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import html as H
from weftline.functions import shown as V
from weftline.functions import text as T
from weftline.functions import urls as U
from weftline.session import table
from weftline.sources import sinks
from weftline.streaming import state as S


def _meta(k):
    return F.get_json_object("metadata", f"$.{k}")


def export_crawl(s, d):
    """The thirteen columns of a crawl's export; what is missing is an empty text."""
    text = lambda c: F.coalesce(c, F.lit(""))
    seconds = _meta("reading_time_seconds").cast("double")
    return table(s, d, "job_results").select(
        "id", "url", text(_meta("title")).alias("title"), text(_meta("status_code")).alias("status_code"), text(_meta("word_count")).alias("word_count"),
        F.when(F.coalesce(seconds, F.lit(0.0)) != 0, F.bround(seconds / 60, 1).cast("string")).otherwise("").alias("reading_time_min"), text(_meta("description")).alias("description"),
        F.coalesce(F.length("markdown"), F.lit(0)).alias("markdown_length"), F.lit(0).alias("html_length"), F.coalesce(F.array_size("links"), F.lit(0)).alias("links_count"),
        F.lit("no").alias("has_screenshot"), *[text(_meta(f"product_data.{k}")).alias(f"product_{k}") for k in ("name", "price", "brand")],
    )


def export_search(s, d):
    """The seven columns of a search's export, from the pages of search jobs."""
    j = table(s, d, "jobs").where("type = 'search'").select(F.col("id").alias("job_id"), "error")
    p = table(s, d, "pages").join(j, "job_id")
    return p.select(
        "page_id", "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("snippet"), F.col("markdown").isNotNull().alias("success"),
        F.coalesce(F.col("word_count").cast("string"), F.lit("")).alias("word_count"), F.coalesce(F.length("markdown"), F.lit(0)).alias("markdown_length"), F.coalesce("error", F.lit("")).alias("error"),
    )


def export_map(s, d):
    """The five columns of a site map's export, one row for each normalised address."""
    p = table(s, d, "pages").withColumn("page", U.map_normalized("url"))
    last = F.max(F.date_format("scraped_at", "yyyy-MM-dd")).alias("lastmod")
    first = lambda c: F.coalesce(F.min_by(c, "page_id"), F.lit(""))
    return p.groupBy(F.col("page").alias("url")).agg(first("title").alias("title"), first("description").alias("description"), last, F.lit("").alias("priority"))


def export_json(s, d):
    """Each job's results as one array of JSON objects without what is null or empty."""
    r = table(s, d, "job_results")
    one = F.to_json(F.struct("url", F.when(F.col("markdown") != "", F.md5("markdown")).alias("hash"), F.when(F.size("links") > 0, F.size("links")).alias("links")))
    return r.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", one.alias("o")))), lambda x: x["o"]), ",").alias("o")).select("job_id", F.concat(F.lit("["), "o", F.lit("]")).alias("json"))


def progress_events(s, d):
    """Of each user's checks of their jobs in order only those where status or count changed, and the closing ones."""
    j = table(s, d, "jobs").select("id", "user_id", "status", F.coalesce("completed_pages", F.lit(0)).alias("completed"), F.coalesce("total_pages", F.lit(0)).alias("total"), "created_at")
    w = Window.partitionBy("user_id").orderBy("created_at", "id")
    before = lambda c: F.lag(c).over(w)
    new = before("status").isNull() | (before("status") != F.col("status")) | (before("completed") != F.col("completed"))
    return j.withColumn("new", new).where("new").select("id", "status", "completed", "total", F.col("status").isin("completed", "failed", "cancelled").alias("done"))


def live_tail(s, d):
    """Each job's results in the pages of fifty in which a live view fetches them."""
    w = Window.partitionBy("job_id").orderBy("created_at", "id")
    return table(s, d, "job_results").withColumn("n", F.row_number().over(w)).groupBy("job_id", F.floor((F.col("n") - 1) / 50).cast("int").alias("fetch")).agg(F.count("*").alias("rows"), F.max("id").alias("last"))


def ndjson_rows(s, d):
    """Results as lines of JSON with the line that closes each job's stream, an error where the job failed."""
    r = table(s, d, "job_results").select("job_id", "id", F.to_json(F.struct("id", "url")).alias("line"))
    j = table(s, d, "jobs").join(r.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi")
    end = F.when(F.col("status") == "failed", F.to_json(F.struct(F.lit("error").alias("status"), F.coalesce("error", F.lit("")).alias("error")))).otherwise('{"status":"completed"}')
    return r.union(j.select("id", F.lit(None).cast("bigint"), end))


def selected_fields(s, d):
    """Only the fields on a list, whatever others there are."""
    return sinks.only(table(s, d, "jobs"), ["id", "status", "no_such_field", "total_pages"])


def shown_money(s, d):
    p = table(s, d, "part")
    code = F.element_at(F.array(*[F.lit(c) for c in ("USD", "EUR", "GBP", "CHF")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit("₹"), F.format_number("p_retailprice", 2))
    return p.select(
        "p_partkey", V.money("p_retailprice", code).alias("price"), V.change(F.col("p_retailprice") - 1000, code).alias("change"),
        V.shop_price(text).alias("parsed"), V.shop_currency(text).alias("sign"),
    )


def shown_times(s, d):
    """Times of events as clock, ISO time and how long it is until a run at them, by whole seconds: the ISO time's are cut, the
    run's rounded half to even as in SQL. A null time gives nulls, and the epoch's own second is a time like others."""
    e = table(s, d, "events").withColumn("at", F.expr("unix_micros(cast(ts as timestamp))"))
    iso = F.coalesce(V.epoch_iso(F.expr("unix_seconds(cast(ts as timestamp))")), F.when(F.col("at").isNotNull(), "1970-01-01T00:00:00+00:00"))
    clock = F.when(F.col("at").isNotNull(), V.clock(F.hour("ts"), F.minute("ts")))
    return e.select("event_id", clock.alias("clock"), iso.alias("iso"), V.next_run(F.rint(F.col("at") / 1e6).cast("bigint") - 1705000000).alias("due"))


def shown_day_offsets(s, d):
    j = table(s, d, "jobs")
    return j.select("id", V.day_offset("created_at", "completed_at").alias("offset"))


def shown_queries(s, d):
    """Titles as searches, without the place they name."""
    return table(s, d, "pages").where("title is not null").select("page_id", V.without_place("title").alias("query"))


def attribute_groups(s, d):
    """Words of pages' titles by the group of attributes they belong to."""
    p = table(s, d, "pages").where("title is not null").select("page_id", V.grouped_attributes(F.split("title", " ")).alias("groups"))
    return p.select("page_id", F.explode("groups").alias("grp", "words")).select("page_id", "grp", F.array_join("words", " ").alias("words"))


def job_config_paths(s, d):
    """Values at paths of the configuration, null where a path breaks."""
    return table(s, d, "jobs").select("id", V.inside("config", "formats", 0).alias("first"), V.inside("config", "formats", 1).alias("second"), V.inside("config", "none", "x").alias("missing"))


def query_summaries(s, d):
    """Jobs newest first with what they asked for: their query, else their address and depth."""
    get = lambda k: F.get_json_object("config", f"$.{k}")
    said = F.coalesce(F.when(get("query") != "", get("query")), F.concat(get("url"), F.lit(" → "), get("max_depth")), get("url"))
    return table(s, d, "jobs").select("id", said.alias("summary"), "created_at").orderBy(F.desc("created_at"), "id").limit(200)


def schedule_runs(s, d):
    """The newest twenty jobs of each configuration, as the runs of a schedule."""
    w = Window.partitionBy(F.get_json_object("config", "$.url"), "type").orderBy(F.desc("created_at"), F.desc("id"))
    return table(s, d, "jobs").withColumn("n", F.row_number().over(w)).where("n <= 20").select("id", "n", "status")


def content_digests(s, d):
    return table(s, d, "job_results").where("markdown is not null").select("id", F.sha2("markdown", 256).alias("sha256"))


def first_by_key(s, d):
    """The first page of each address without its closing slashes, numbered anew on its host."""
    first = Window.partitionBy(F.regexp_replace("url", "/+$", "")).orderBy("page_id")
    again = Window.partitionBy("host").orderBy("page_id")
    p = table(s, d, "pages").select("page_id", "url", U.domain("url").alias("host")).withColumn("n", F.row_number().over(first)).where("n = 1")
    return p.select("page_id", F.row_number().over(again).alias("position"))


def best_copies(s, d):
    """Of the scrapes of one address the one with most visible words, the earliest of equals."""
    p = table(s, d, "pages").where("html is not null")
    seen = F.regexp_replace(F.regexp_replace("html", r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""), H.TAG, " ")
    p = p.select(U.normalized("url").alias("page"), "page_id", T.word_count(F.regexp_replace(seen, r"\s+", " ")).alias("words"))
    return p.where("page is not null").groupBy("page").agg(F.min_by("page_id", F.struct(-F.col("words"), "page_id")).alias("page_id"), F.max("words").alias("words"))


def starting_tiers(s, d):
    """Where to begin with each host by how its deliveries went: where one went well, with what worked; after three
    failures on the first attempts, with what comes next."""
    w = table(s, d, "webhook_deliveries").groupBy(U.domain("url").alias("host")).agg(
        F.count_if("success").alias("well"), F.count_if(F.expr("not success and attempt = 1")).alias("f1"), F.count_if(F.expr("not success and attempt > 1")).alias("f2")
    )
    return w.select("host", F.expr("case when well > 0 then 0 when f1 >= 3 and f2 >= 3 then 3 when f1 >= 3 then 2 else 1 end").alias("tier"))


def link_clusters(s, d):
    """Markdown without runs of five or more lines that are links alone: runs by the difference of two counts."""
    lines = table(s, d, "job_results").where("markdown is not null").select("id", F.posexplode(F.split("markdown", "\n", -1)).alias("i", "line"))
    w = Window.partitionBy("id").orderBy("i")
    x = lines.withColumn("link", F.col("line").rlike(r"^\s*[-*]?\s*\[.{1,60}\]\(.*\)\s*$"))
    x = x.withColumn("run", F.col("i") - F.sum(F.col("link").cast("int")).over(w)).withColumn("size", F.sum(F.col("link").cast("int")).over(Window.partitionBy("id", "link", "run")))
    kept = x.where(~(F.col("link") & (F.col("size") >= 5)))
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda v: v["line"]), "\n").alias("markdown"))


def frontier_orders(s, d):
    """Positions in which the links of each page would be taken: first in first out, last in first out, and by depth."""
    r = table(s, d, "job_results").select("job_id", "id", F.posexplode("links").alias("p", "url")).withColumn("depth", F.size(U.segments("url")))
    job = Window.partitionBy("job_id")
    n = lambda *o: F.row_number().over(job.orderBy(*o))
    return r.select("id", "p", n("id", "p").alias("fifo"), n(F.desc("id"), F.desc("p")).alias("lifo"), n("depth", "url", "id", "p").alias("best"))


def sitemap_seeds(s, d):
    """Addresses of a site map that begin a crawl at depth one: of each site at most five times its pages."""
    p = table(s, d, "pages").select("page_id", U.map_normalized("url").alias("url"), U.domain("url").alias("site")).where(~U.map_junk("url"))
    w = Window.partitionBy("site")
    u = p.groupBy("site", "url").agg(F.min("page_id").alias("page_id"))
    u = u.withColumn("n", F.row_number().over(w.orderBy("page_id", "url"))).withColumn("cap", F.lit(5 * 10))
    return u.where("n <= cap").select("site", "url", F.lit(1).alias("depth"))


def crawl_flags(s, d):
    """What becomes of each crawled page: whether it counts and whether its links are followed."""
    r = table(s, d, "job_results")
    thin = T.word_count(F.coalesce("markdown", F.lit(""))) < 15
    return r.select("id", (~thin).alias("counts"), (F.col("markdown").isNotNull() & (F.coalesce(F.array_size("links"), F.lit(0)) > 0)).alias("expands"))


def merged_settings(s, d):
    """Later of two maps wins, key by key; lists are put one behind the other."""
    j = table(s, d, "jobs").select("id", F.from_json("config", "map<string,string>").alias("a"), F.create_map(F.lit("url"), F.lit("x"), F.lit("status"), "status").alias("b"))
    merged = F.map_concat(F.map_filter("a", lambda k, v: ~F.array_contains(F.map_keys("b"), k)), F.col("b"))
    return j.select("id", F.element_at(merged, "url").alias("url"), F.element_at(merged, "status").alias("status"), F.size(merged).alias("keys"))


def ttl_cache(s, d):
    """Whether each event's kind was in a cache that keeps an entry an hour from when it was made. Each user has their own."""
    e = table(s, d, "events").select("user_id", "event_id", "event_type", F.expr("unix_micros(cast(ts as timestamp)) / 1e6D").alias("s"))
    return S.ttl_cache(e, "user_id", "event_type", "s", "event_id")


def memory_levels(s, d):
    """How many tasks each user's load allows, step by step."""
    e = table(s, d, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp)) / 1e6D").alias("s"), F.least(F.abs("value"), F.lit(100.0)).alias("load"))
    return S.adaptive_slots(e, "user_id", "load", "s", "event_id")


def monitor_states(s, d):
    """Each page's versions as the checks of a monitor with two keywords."""
    r = table(s, d, "job_results").select("id", "created_at", U.normalized("url").alias("page"), "markdown", _meta("status_code").cast("int").alias("status_code")).where("page is not null")
    return S.monitored(r, "page", "markdown", "status_code", ["created_at", "id"], keywords=("server", "hotel"))


def quota_summary(s, d):
    """Each user's month with limit, use and rest of every operation; -1 is no limit."""
    limits = {"scrape": 10, "crawl": 5, "extract": 0, "search": -1, "map": 3, "monitor": 2}
    used = table(s, d, "jobs").groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("period")).agg(*[F.count_if(F.col("type") == k).alias(k) for k in limits])
    pairs = ", ".join(f"'{k}', {v}L, {k}" for k, v in limits.items())
    x = used.select("user_id", "period", F.expr(f"stack({len(limits)}, {pairs}) as (operation, most, used)"))
    return x.select("user_id", "period", "operation", "most", "used", F.expr("case when most = -1 then -1L else greatest(0L, most - used) end").alias("remaining"), (F.col("most") == -1).alias("unlimited"))


def paged_history(s, d):
    """The second page of the jobs, with the numbers of jobs and of pages."""
    j = table(s, d, "jobs")
    total = j.agg(F.count("*").alias("total"))
    page = j.orderBy(F.desc("created_at"), "id").offset(20).limit(20).select("id", "status")
    return page.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / 20))  # one row


def merged_sources(s, d):
    """Addresses of three sources one after the other, the first of equal ones kept, until two hundred are found."""
    j, p = table(s, d, "job_results"), table(s, d, "pages")
    parts = [p.select(F.lit(0).alias("source"), F.col("page_id").alias("n"), "url"), j.select(F.lit(1), "id", "url"), j.select(F.lit(2), "id", F.explode("links"))]
    x = parts[0].union(parts[1]).union(parts[2]).groupBy(F.regexp_replace("url", "/+$", "").alias("page")).agg(F.min(F.struct("source", "n")).alias("at"))
    return x.orderBy("at.source", "at.n", "page").limit(200).select("page", "at.source")


def first_extras(s, d):
    """Every page of a job with the title of the job's first page."""
    w = Window.partitionBy("job_id").orderBy("created_at", "id")
    return table(s, d, "job_results").select("id", F.first_value(_meta("title")).over(w).alias("first_title"))


def llm_chunks(s, d):
    """Documents put into chunks of at most three hundred words by whole paragraphs."""
    return table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.chunks_merged("text", 300)).alias("n", "chunk")).select("doc_id", "n", F.md5("chunk").alias("hash"), T.word_count("chunk").alias("words"))


def stripped_texts(s, d):
    return table(s, d, "pages").where("html is not null").select("page_id", F.md5(H.stripped("html")).alias("hash"))


def banner_free(s, d):
    """Sources without the banner of a cached copy."""
    return table(s, d, "pages").where("html is not null").select("page_id", F.md5(H.cache_banner_removed("html")).alias("hash"))


def page_checks(s, d):
    """Whether pages look like refused picture searches, and like results of a shop."""
    return table(s, d, "pages").where("html is not null").select("page_id", H.is_picture_search_blocked("html").alias("blocked"), H.is_shop_search("html").alias("shop"))


def cron_next(s, d):
    """When each job's schedule, made of its id, runs next after its creation."""
    cron = F.concat_ws(" ", (F.col("id") % 60).cast("string"), (F.col("id") % 24).cast("string"), F.lit("*"), F.lit("*"), F.when(F.col("id") % 3 == 0, "1-5").otherwise("*"))
    return S.cron_next(table(s, d, "jobs").select("id", "created_at", cron.alias("cron")), "id", "cron", "created_at")


QUERIES = {f.__name__: f for f in (
    export_crawl, export_search, export_map, export_json, progress_events, live_tail, ndjson_rows, selected_fields, shown_money, shown_times, shown_day_offsets, shown_queries,
    attribute_groups, job_config_paths, query_summaries, schedule_runs, content_digests, first_by_key, best_copies, starting_tiers, link_clusters, frontier_orders, sitemap_seeds,
    crawl_flags, merged_settings, ttl_cache, memory_levels, monitor_states, quota_summary, paged_history, merged_sources, first_extras, llm_chunks, stripped_texts, banner_free,
    page_checks, cron_next,
)}

_WORDS = r"len(list_filter(regexp_split_to_array(trim({}), '\s+'), lambda x: x <> ''))"
_J = "json_extract_string(metadata, '$.{}')"
_DOM = r"regexp_replace(lower(regexp_extract({}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?', 2)), '^www\.', '')"
_PATH = r"regexp_replace(regexp_extract({}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)', 3), ';[^/]*$', '')"
_SIGN = "case p_partkey % 4 when 0 then '$' when 1 then '€' when 2 then '£' else '' end"
from weftline.plans.urls import SQL as _URLS  # noqa: E402
from weftline.plans.urls import URL_CTE  # noqa: E402

_JUNK = " or ".join(f"contains(lower({{}}), '{j}')" for j in U.MAP_JUNK)
SQL = {
    "export_crawl": f"""select id, url, coalesce({_J.format('title')}, '') as title, coalesce({_J.format('status_code')}, '') as status_code, coalesce({_J.format('word_count')}, '') as word_count,
        case when coalesce({_J.format('reading_time_seconds')}::double, 0) <> 0 then round_even({_J.format('reading_time_seconds')}::double / 60, 1)::varchar else '' end as reading_time_min,
        coalesce({_J.format('description')}, '') as description, coalesce(length(markdown), 0)::int as markdown_length, 0 as html_length, coalesce(len(links), 0)::int as links_count, 'no' as has_screenshot,
        coalesce({_J.format('product_data.name')}, '') as product_name, coalesce({_J.format('product_data.price')}, '') as product_price, coalesce({_J.format('product_data.brand')}, '') as product_brand from job_results""",
    "export_search": """select page_id, url, coalesce(title, '') as title, coalesce(description, '') as snippet, markdown is not null as success, coalesce(word_count::varchar, '') as word_count,
        coalesce(length(markdown), 0)::int as markdown_length, coalesce(error, '') as error from pages join (select id as job_id, error from jobs where type = 'search') using (job_id)""",
    "export_map": f"""with m as ({_URLS['url_map_normalize']}) select normalized as url, coalesce(arg_min(title, page_id), '') as title, coalesce(arg_min(description, page_id), '') as description,
        max(strftime(scraped_at, '%Y-%m-%d')) as lastmod, '' as priority from m join pages using (page_id) group by normalized""",
    "export_json": """select job_id, '[' || string_agg('{"url":"' || url || '"' || case when markdown <> '' then ',"hash":"' || md5(markdown) || '"' else '' end ||
        case when len(links) > 0 then ',"links":' || len(links) else '' end || '}', ',' order by created_at, id) || ']' as json from job_results group by job_id""",
    "progress_events": """with x as (select id, status, coalesce(completed_pages, 0) as completed, coalesce(total_pages, 0) as total, lag(status) over w as s, lag(coalesce(completed_pages, 0)) over w as c
        from jobs window w as (partition by user_id order by created_at, id)) select id, status, completed, total, status in ('completed', 'failed', 'cancelled') as done from x where s is null or s <> status or c <> completed""",
    "live_tail": """with x as (select job_id, id, row_number() over (partition by job_id order by created_at, id) as n from job_results) select job_id, ((n - 1) // 50)::int as fetch, count(*) as rows, max(id) as last from x group by 1, 2""",
    "ndjson_rows": """select job_id, id, '{"id":' || id || ',"url":"' || url || '"}' as line from job_results union all
        select id, null, case when status = 'failed' then '{"status":"error","error":"' || coalesce(error, '') || '"}' else '{"status":"completed"}' end from jobs where id in (select job_id from job_results)""",
    "selected_fields": "select id, status, total_pages from jobs",
    "shown_money": f"""select p_partkey, {_SIGN} || format('{{:,.2f}}', p_retailprice) as price, case when p_retailprice > 1000 then '+' else '-' end || {_SIGN} || format('{{:,.2f}}', abs(p_retailprice - 1000)) as change,
        round(p_retailprice, 2) as parsed, '₹' as sign from part""",
    "shown_times": """with x as (select event_id, ts, hour(ts) as h, minute(ts) as m, (epoch(ts)::bigint - 1705000000) as s from events) select event_id,
        case when h % 12 = 0 then 12 else h % 12 end || ':' || lpad(m::varchar, 2, '0') || case when h < 12 then ' AM' else ' PM' end as clock, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') as iso,
        case when s < 0 then 'overdue' when s < 60 then 'in ' || s || 's' when s < 3600 then 'in ' || s // 60 || 'm' when s < 86400 then 'in ' || s // 3600 || 'h' else 'in ' || s // 86400 || 'd' end as due from x""",
    "shown_day_offsets": """with x as (select id, datediff('day', created_at, completed_at) as n from jobs) select id, case when n > 0 then '+' || n when n < 0 then n::varchar end as offset from x""",
    "shown_queries": r"""with x as (select page_id, title, trim(regexp_replace(trim(regexp_replace(title, '(?i)\s+(?:in|near|around|at|close to|nearby)\s+.+$', '')), '(?i)\b(?:all|the|best|top|find|show|list of|list)\b', '', 'g')) as q
        from pages where title is not null) select page_id, case when length(q) < 3 then title else q end as query from x""",
    "attribute_groups": f"""with w as (select page_id, unnest(string_split(title, ' ')) as word, generate_subscripts(string_split(title, ' '), 1) as i from pages where title is not null),
        g as (select *, case {' '.join("when " + " or ".join(f"contains(lower(word), '{k}')" for k in ks) + f" then '{g}'" for g, ks in V.ATTRIBUTE_GROUPS.items())} else 'other' end as grp from w)
        select page_id, grp, string_agg(word, ' ' order by i) as words from g group by all""",
    "job_config_paths": "select id, json_extract_string(config, '$.formats[0]') as first, json_extract_string(config, '$.formats[1]') as second, null::varchar as missing from jobs",
    "query_summaries": """select id, coalesce(nullif(json_extract_string(config, '$.query'), ''), json_extract_string(config, '$.url') || ' → ' || json_extract_string(config, '$.max_depth'), json_extract_string(config, '$.url')) as summary, created_at
        from jobs order by created_at desc, id limit 200""",
    "schedule_runs": "select id, n::int as n, status from (select id, status, row_number() over (partition by json_extract_string(config, '$.url'), type order by created_at desc, id desc) as n from jobs) where n <= 20",
    "content_digests": "select id, sha256(markdown) as sha256 from job_results where markdown is not null",
    "first_by_key": f"""with x as (select page_id, {_DOM.format('url')} as host, row_number() over (partition by rtrim(url, '/') order by page_id) as n from pages)
        select page_id, (row_number() over (partition by host order by page_id))::int as position from x where n = 1""",
    "best_copies": f"""with {URL_CTE}, x as (select norm as page, page_id, {_WORDS.format(r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')")} as words
        from n join pages using (page_id) where html is not null and norm is not null) select page, arg_min(page_id, (-words, page_id)) as page_id, max(words)::int as words from x group by page""",
    "starting_tiers": f"""with x as (select {_DOM.format('url')} as host, count(*) filter (success) as well, count(*) filter (not success and attempt = 1) as f1, count(*) filter (not success and attempt > 1) as f2 from webhook_deliveries group by 1)
        select host, case when well > 0 then 0 when f1 >= 3 and f2 >= 3 then 3 when f1 >= 3 then 2 else 1 end as tier from x""",
    "link_clusters": r"""with l as (select id, unnest(string_split(markdown, chr(10))) as line, generate_subscripts(string_split(markdown, chr(10)), 1) as i from job_results where markdown is not null),
        x as (select *, regexp_matches(line, '^\s*[-*]?\s*\[.{1,60}\]\(.*\)\s*$')::int as link from l), r as (select *, i - sum(link) over (partition by id order by i) as run from x),
        c as (select *, sum(link) over (partition by id, link, run) as size from r) select id, string_agg(line, chr(10) order by i) as markdown from c where link = 0 or size < 5 group by id""",
    "frontier_orders": f"""with x as (select job_id, id, unnest(links) as url, (generate_subscripts(links, 1) - 1)::int as p from job_results),
        y as (select *, len(list_filter(string_split({_PATH.format('url')}, '/'), lambda z: z <> '')) as depth from x)
        select id, p, (row_number() over (partition by job_id order by id, p))::int as fifo, (row_number() over (partition by job_id order by id desc, p desc))::int as lifo,
        (row_number() over (partition by job_id order by depth, url, id, p))::int as best from y""",
    "sitemap_seeds": f"""with m as ({_URLS['url_map_normalize']}), x as (select m.page_id, normalized as url, {_DOM.format('p.url')} as site, {_PATH.format('normalized')} as path from m join pages p using (page_id)),
        u as (select site, url, min(page_id) as page_id from x where not ({_JUNK.replace('{}', 'path')}) group by all)
        select site, url, 1 as depth from (select *, row_number() over (partition by site order by page_id, url) as n from u) where n <= 50""",
    "crawl_flags": f"select id, ({_WORDS.format('markdown')} >= 15) is true as counts, (markdown is not null and coalesce(len(links), 0) > 0) as expands from job_results",
    "merged_settings": """with k as (select id, status, json_keys(config) as keys from jobs) select id, 'x' as url, status, (len(list_filter(keys, lambda z: z not in ('url', 'status'))) + 2)::int as keys from k""",
    "ttl_cache": """with recursive e as (select user_id, event_type, event_id, epoch_us(ts) / 1e6::double as s, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
        w as (select *, s as made, false as hit from e where n = 1 union all
              select e.*, case when e.s - w.made < 3600 then w.made else e.s end, e.s - w.made < 3600 from w join e on e.user_id = w.user_id and e.event_type = w.event_type and e.n = w.n + 1)
        select user_id, event_id, hit from w""",
    "quota_summary": """with u as (select user_id, strftime(created_at, '%Y-%m') as period, type, count(*) as n from jobs group by all), k as (select distinct user_id, period from u),
        l(operation, most) as (values ('scrape', 10), ('crawl', 5), ('extract', 0), ('search', -1), ('map', 3), ('monitor', 2))
        select k.user_id, k.period, operation, most::bigint as most, coalesce(n, 0) as used, case when most = -1 then -1 else greatest(0, most - coalesce(n, 0)) end::bigint as remaining, most = -1 as unlimited
        from k cross join l left join u on u.user_id = k.user_id and u.period = k.period and u.type = operation""",
    "paged_history": "select id, status, total, ceil(total / 20.0)::bigint as pages from (select id, status, created_at from jobs order by created_at desc, id limit 20 offset 20), (select count(*) as total from jobs)",
    "merged_sources": """with x as (select 0 as source, page_id as n, url from pages union all select 1, id, url from job_results union all select 2, id, unnest(links) from job_results),
        y as (select rtrim(url, '/') as page, min((source, n)) as a from x group by 1) select page, a[1]::int as source from (select page, [struct_extract(a, 1), struct_extract(a, 2)] as a from y) order by a[1], a[2], page limit 200""",
    "first_extras": "select id, first_value(json_extract_string(metadata, '$.title')) over (partition by job_id order by created_at, id) as first_title from job_results",
    "stripped_texts": r"select page_id, md5(trim(regexp_replace(regexp_replace(html, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as hash from pages where html is not null",
    "banner_free": """select page_id, md5(regexp_replace(regexp_replace(html, '(?is)<div[^>]*(?:id|class)=["'']google-cache-hdr["''][^>]*>.*?</div>\\s*(?:</div>)*', ''), '(?is)<div[^>]*style=["''][^"'']*text-align:\\s*center[^"'']*["''][^>]*>.*?This is Google''s cache.*?</div>', '')) as hash
        from pages where html is not null""",
    "page_checks": """select page_id, contains(lower(html), 'unusual traffic') or contains(lower(html), 'captcha') as blocked, (contains(html, 's-search-results') or contains(html, 's-result-item'))
        and not (contains(html, 'Type the characters you see in this image') or contains(html, 'Sorry, we just need to make sure you''re not a robot') or contains(html, 'api-services-support@amazon') or contains(html, 'Enter the characters you see below')) as shop
        from pages where html is not null""",
}
