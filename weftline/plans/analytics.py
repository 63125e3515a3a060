"""Usage, delivery, quota and monitoring statistics over the job tables: aggregates, windows, joins, top-k, sets."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.streaming.state import ema_step, fold
from weftline.session import table


def _secs(a: str, b: str) -> F.Column:
    return F.expr(f"(unix_micros(cast({b} as timestamp)) - unix_micros(cast({a} as timestamp))) / 1e6D")


def usage_stats(s: SparkSession, d: str):
    """Per user in one pass: jobs, pages, averages over completed jobs, success rate."""
    j = table(s, d, "jobs")
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    return j.groupBy("user_id").agg(
        F.count("*").alias("jobs"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"),
        F.coalesce(F.sum("completed_pages"), F.lit(0)).alias("pages"), F.avg(F.when(done, F.col("completed_pages"))).alias("avg_pages"),
        F.avg(F.when(done & F.col("started_at").isNotNull() & F.col("completed_at").isNotNull(), _secs("started_at", "completed_at"))).alias("avg_seconds"),
        F.when(F.count_if(done | failed) > 0, F.round(100.0 * F.count_if(done) / F.count_if(done | failed), 1)).otherwise(0.0).alias("success_rate"),
    )


def usage_by_type_status(s, d):
    """Grouping sets over type and status in one scan."""
    j = table(s, d, "jobs").select("type", "status", "completed_pages")
    return j.groupingSets([["type"], ["status"], []], "type", "status").agg(F.count("*").alias("jobs"), F.sum("completed_pages").alias("pages"))


def usage_per_day(s, d):
    j = table(s, d, "jobs")
    last = j.agg(F.max("created_at").alias("now"))
    recent = j.crossJoin(F.broadcast(last)).where(F.expr("created_at >= now - interval 30 days"))  # one row
    return recent.groupBy(F.date_trunc("day", "created_at").cast("date").alias("day")).agg(F.count("*").alias("jobs"))


def usage_history(s, d):
    """Third page of a user's jobs, newest first, filtered by type."""
    j = table(s, d, "jobs").where("user_id = 1")
    page = j.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(2).limit(3)
    return page.select("id", "type", "status")


def usage_search(s, d):
    """Jobs whose configured address or query holds a text, in any case."""
    j = table(s, d, "jobs")
    hit = F.get_json_object("config", "$.url").ilike("%docs%") | F.get_json_object("config", "$.query").ilike("%server%")
    return j.where(hit).select("id", "type", "status")


def top_domains(s, d):
    w = table(s, d, "job_results").join(table(s, d, "jobs").select(F.col("id").alias("job_id"), "user_id"), "job_id")
    return w.groupBy(U.domain("url").alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct("user_id").alias("users")).orderBy(F.desc("pages"), "domain").limit(20)


def webhook_stats(s, d):
    """Deliveries once each (last copy), by event in one case."""
    w = table(s, d, "webhook_deliveries")
    last = w.groupBy("id").agg(F.max_by(F.struct("event", "success", "response_time_ms"), F.struct("ingested_at", "attempt")).alias("x")).select("x.*")
    return last.groupBy(F.lower("event").alias("event")).agg(
        F.count("*").alias("total"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"),
        F.round(100.0 * F.count_if("success") / F.count("*"), 2).alias("rate"), F.avg(F.when(F.col("success"), F.col("response_time_ms"))).alias("avg_ms"),
    )


def webhook_list(s, d):
    w = table(s, d, "webhook_deliveries").where("user_id = 1 and not success and lower(event) like '%completed%'")
    return w.select("id", "job_id", "attempt").distinct().orderBy(F.desc("id"), "attempt").limit(50)


def webhook_backoff(s, d):
    """Next attempt of each failed delivery: 4^n seconds, while attempts are left."""
    w = table(s, d, "webhook_deliveries").where("not success").select("id", "attempt", "max_attempts").distinct()
    wait = F.when(F.col("attempt") < F.col("max_attempts"), F.pow(F.lit(4.0), "attempt"))
    return w.select("id", "attempt", wait.alias("wait_seconds"))


def webhook_histogram(s, d):
    """Cumulative response-time buckets by event, as a metrics endpoint shows them."""
    w = table(s, d, "webhook_deliveries").where("response_time_ms is not null")
    edges = [50, 100, 250, 500, 1000, 2500, 5000, 10000]
    g = w.groupBy(F.lower("event").alias("event")).agg(*[F.count_if(F.col("response_time_ms") <= e).alias(f"le_{e}") for e in edges], F.count("*").alias("le_inf"), F.sum("response_time_ms").alias("sum_ms"))
    return g


def quota_usage(s, d):
    """Pages used by user and month, with what is left of a limit (-1: no limit)."""
    j = table(s, d, "jobs")
    g = j.groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.sum("completed_pages").alias("used"))
    limit = F.when(F.col("user_id") == 1, -1).otherwise(200)
    return g.select("user_id", "period", "used", F.when(limit == -1, F.lit(-1)).otherwise(F.greatest(F.lit(0), limit - F.col("used"))).alias("remaining"))


def quota_exceeded(s, d):
    """Jobs that start when the month's running sum has reached the limit."""
    w = Window.partitionBy("user_id", "period").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    j = table(s, d, "jobs").withColumn("period", F.date_format("created_at", "yyyy-MM"))
    return j.withColumn("before", F.coalesce(F.sum("completed_pages").over(w), F.lit(0))).where("before >= 20").select("id", "user_id", "period", "before")


def quota_previous(s, d):
    """Each month of a user beside the latest earlier month that has any use."""
    g = table(s, d, "jobs").groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("period")).agg(F.sum("completed_pages").alias("used"))
    w = Window.partitionBy("user_id").orderBy("period")
    return g.select("user_id", "period", "used", F.lag("period").over(w).alias("previous_period"), F.lag("used").over(w).alias("previous_used"))


def _checks(s, d):
    return table(s, d, "monitor_checks").distinct()


def monitor_changes(s, d):
    """Change against the previous check: content hash where both have one, else the status."""
    w = Window.partitionBy("monitor_id").orderBy("checked_at", "id")
    x = _checks(s, d).where("checked_at is not null")
    x = x.select("monitor_id", "id", "content_hash", "status_code", F.lag("content_hash").over(w).alias("old_hash"), F.lag("status_code").over(w).alias("old_status"))
    both = (F.coalesce("content_hash", F.lit("")) != "") & (F.coalesce("old_hash", F.lit("")) != "")
    kind = F.when(both & (F.col("content_hash") != F.col("old_hash")), "content").when(~F.col("status_code").eqNullSafe(F.col("old_status")) & F.col("old_status").isNotNull(), "status")
    return x.select("monitor_id", "id", kind.alias("change")).where("change is not null")


def monitor_counters(s, d):
    x = _checks(s, d)
    return x.groupBy("monitor_id").agg(F.count("*").alias("checks"), F.count_if("has_changed").alias("changes"), F.max(F.when(F.col("has_changed"), F.col("checked_at"))).cast("string").alias("last_change"))


def monitor_ema(s, d):
    """Smoothed response time, 0.7 old and 0.3 new, seeded by the first; and failures since the last success. A monitor's
    checks stream through in order, only the two numbers are held."""

    def step(state, r):
        n, ema, fails = state
        ms = getattr(r, "response_time_ms")
        ema = ema_step(ema, float(ms)) if ms == ms and ms is not None else ema
        fails = 0 if r.status_code == r.status_code and r.status_code is not None and r.status_code < 400 else fails + 1
        return (n + 1, ema, fails), (n, ema, fails)

    x = _checks(s, d).where("checked_at is not null")
    y = fold(x, "monitor_id", ["checked_at", "id", "response_time_ms", "status_code"], [], lambda: (0, None, 0), step, "monitor_id bigint, n bigint, ema double, failures int")
    last = y.groupBy("monitor_id").agg(F.max_by(F.struct("ema", "failures"), "n").alias("v"))
    return last.select("monitor_id", F.round("v.ema", 6).alias("ema_ms"), "v.failures")


def monitor_history(s, d):
    x = _checks(s, d).where("monitor_id = 7 and checked_at is not null")
    return x.orderBy(F.desc("checked_at"), F.desc("id")).limit(20).select("id", "status_code", "has_changed")


def results_of_jobs(s, d):
    """Pages with their job's kind and owner."""
    j = table(s, d, "jobs").select(F.col("id").alias("job_id"), "user_id", "type")
    return table(s, d, "job_results").join(j, "job_id").groupBy("user_id", "type").agg(F.count("*").alias("pages"), F.count_if(F.col("markdown").isNull()).alias("empty"))


def page_totals_mismatch(s, d):
    """Jobs whose counter doesn't match their stored pages."""
    n = table(s, d, "job_results").groupBy("job_id").agg(F.count("*").alias("stored"))
    j = table(s, d, "jobs").join(n, F.col("id") == F.col("job_id"), "left")
    return j.select("id", "completed_pages", F.coalesce("stored", F.lit(0)).alias("stored")).where("coalesce(completed_pages, 0) <> stored")


def cleanup_candidates(s, d):
    """Results of jobs older than 30 days before the newest job (semi join), to be deleted before the jobs."""
    j = table(s, d, "jobs")
    cut = j.agg(F.max("created_at").alias("now"))
    old = j.crossJoin(F.broadcast(cut)).where(F.expr("created_at < now - interval 30 days")).select("id")  # one row
    return table(s, d, "job_results").join(old.withColumnRenamed("id", "job_id"), "job_id", "left_semi").select("id", "job_id")


def cleanup_kept(s, d):
    """What the clean-up keeps (anti join)."""
    gone = cleanup_candidates(s, d).select("id")
    return table(s, d, "job_results").join(gone, "id", "left_anti").select("id")


def recrawled_pages(s, d):
    """URLs crawled again: keep the newest row of each normal form with its rank and number of copies."""
    x = table(s, d, "job_results").select("id", "created_at", U.normalized("url").alias("page"))
    w = Window.partitionBy("page").orderBy(F.desc("created_at"), F.desc("id"))
    x = x.withColumn("n", F.row_number().over(w)).withColumn("copies", F.count("*").over(Window.partitionBy("page")))
    return x.where("n = 1 and copies > 1").select("id", "page", "copies")


def undiscovered_links(s, d):
    """Links of crawled pages that weren't crawled, with the number of pages that point to them."""
    j = table(s, d, "job_results")
    links = j.select(F.explode("links").alias("link")).select(U.crawl_key("link").alias("page"))
    seen = j.select(U.crawl_key("url").alias("page")).distinct()
    return links.where("page is not null").groupBy("page").agg(F.count("*").alias("pointers")).join(seen, "page", "left_anti")


def source_union(s, d):
    """Pages of both tables by priority, first of each normal form."""
    a = table(s, d, "pages").select(F.lit(0).alias("rank"), F.col("page_id").alias("id"), U.normalized("url").alias("page"))
    b = table(s, d, "job_results").select(F.lit(1).alias("rank"), "id", U.normalized("url").alias("page"))
    w = Window.partitionBy("page").orderBy("rank", "id")
    return a.unionByName(b).withColumn("n", F.row_number().over(w)).where("n = 1").select("page", "rank", "id")


def site_overlap(s, d):
    """Hosts in both tables, and hosts in one of them only."""
    a = table(s, d, "pages").select(U.domain("url").alias("host"))
    b = table(s, d, "job_results").select(U.domain("url").alias("host"))
    both = a.intersect(b).withColumn("place", F.lit("both"))
    left = a.exceptAll(b.union(a).distinct().intersect(b)).distinct().join(b.distinct(), "host", "left_anti").withColumn("place", F.lit("pages"))
    return both.unionByName(left)


def late_rows(s, d):
    """Rows by days between making and ingestion."""
    x = table(s, d, "job_results").select(F.datediff("ingested_at", "created_at").alias("days"))
    return x.groupBy("days").agg(F.count("*").alias("n"))


def rate_limited(s, d):
    """Requests over 2 in the last hour of a user; refused ones count too, equal instants count once."""
    e = table(s, d, "events").select("user_id", F.expr("unix_micros(cast(ts as timestamp))").alias("us")).distinct()
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_599_999_999, 0)
    return e.withColumn("seen", F.count("*").over(w)).where("seen > 2").select("user_id", "us", "seen")


def event_sessions(s, d):
    """Sessions by user with half an hour's gap (gaps and islands)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").select("user_id", "event_id", "ts", F.lag("ts").over(w).alias("before"))
    new = F.when(F.col("before").isNull() | (F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(cast(before as timestamp))") > 1_800_000_000), 1).otherwise(0)
    e = e.withColumn("session", F.sum(new).over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def dead_letters(s, d):
    """The newest 1000 failures."""
    return table(s, d, "webhook_deliveries").where("not success").select("id", "attempt", "created_at").distinct().orderBy(F.desc("created_at"), F.desc("id"), "attempt").limit(1000).select("id", "attempt")


def job_transitions(s, d):
    """What may be done to each job: retry what failed or was cancelled, cancel what is open."""
    can = F.when(F.col("status").isin("failed", "cancelled"), "retry").when(F.col("status").isin("pending", "running"), "cancel")
    return table(s, d, "jobs").select("id", can.alias("action")).where("action is not null")


def export_rows(s, d):
    """Flat export of crawled pages as the CSV sink writes it."""
    m = lambda k: F.get_json_object("metadata", f"$.{k}")
    return table(s, d, "job_results").select(
        "id", "url", m("title").alias("title"), m("language").alias("language"), m("status_code").cast("int").alias("status_code"),
        F.coalesce(F.length("markdown"), F.lit(0)).alias("markdown_length"), F.coalesce(F.array_size("links"), F.lit(0)).alias("links_count"),
    )


def stale_hashes(s, d):
    """Rows whose stored hash isn't that of their text."""
    return table(s, d, "job_results").where("markdown is not null and content_hash is not null and md5(markdown) <> content_hash").select("id")


QUERIES = {f.__name__: f for f in (
    usage_stats, usage_by_type_status, usage_per_day, usage_history, usage_search, top_domains, webhook_stats, webhook_list, webhook_backoff, webhook_histogram,
    quota_usage, quota_exceeded, quota_previous, monitor_changes, monitor_counters, monitor_ema, monitor_history, results_of_jobs, page_totals_mismatch,
    cleanup_candidates, cleanup_kept, recrawled_pages, undiscovered_links, source_union, site_overlap, late_rows, rate_limited, event_sessions, dead_letters,
    job_transitions, export_rows, stale_hashes,
)}

_DOM = r"regexp_replace(lower(regexp_extract({}, '^(?:([^:/?#]+):)?(?://([^/?#]*))?', 2)), '^www\.', '')"


def _norm(src: str) -> str:
    """Common table expressions of the normal forms of ``src`` (a query of page_id and url)."""
    from weftline.plans.urls import URL_CTE

    return "with " + URL_CTE.replace("select page_id, url from pages", src, 1)


_OLD = "select id from jobs where created_at < (select max(created_at) from jobs) - interval 30 day"
SQL = {
    "usage_stats": """select user_id, count(*) as jobs, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed,
        coalesce(sum(completed_pages), 0)::bigint as pages, avg(completed_pages) filter (status = 'completed') as avg_pages,
        avg(epoch_us(completed_at) - epoch_us(started_at)) filter (status = 'completed' and started_at is not null and completed_at is not null) / 1e6 as avg_seconds,
        case when count(*) filter (status in ('completed', 'failed')) > 0 then round(100.0::double * count(*) filter (status = 'completed') / count(*) filter (status in ('completed', 'failed')), 1)
             else 0.0::double end as success_rate from jobs group by user_id""",
    "usage_by_type_status": "select type, status, count(*) as jobs, sum(completed_pages)::bigint as pages from jobs group by grouping sets ((type), (status), ())",
    "usage_per_day": "select created_at::date as day, count(*) as jobs from jobs where created_at >= (select max(created_at) from jobs) - interval 30 day group by 1",
    "usage_history": "select id, type, status from (select * from jobs where user_id = 1 order by created_at desc, id desc limit 3 offset 2)",
    "usage_search": "select id, type, status from jobs where json_extract_string(config, '$.url') ilike '%docs%' or json_extract_string(config, '$.query') ilike '%server%'",
    "top_domains": f"""select {_DOM.format('url')} as domain, count(*) as pages, count(distinct user_id) as users from job_results r join jobs j on r.job_id = j.id
        group by 1 order by pages desc, domain limit 20""",
    "webhook_stats": """with l as (select lower(event) as event, success, response_time_ms from webhook_deliveries qualify row_number() over (partition by id order by ingested_at desc, attempt desc) = 1)
        select event, count(*) as total, count(*) filter (success) as ok, count(*) filter (not success) as failed, round(100.0::double * count(*) filter (success) / count(*), 2) as rate,
        avg(response_time_ms) filter (success) as avg_ms from l group by event""",
    "webhook_list": """select id, job_id, attempt from (select distinct id, job_id, attempt from webhook_deliveries
        where user_id = 1 and not success and lower(event) like '%completed%') order by id desc, attempt limit 50""",
    "webhook_backoff": "select distinct id, attempt, max_attempts, case when attempt < max_attempts then pow(4.0::double, attempt) end as wait_seconds from webhook_deliveries where not success",
    "webhook_histogram": "select lower(event) as event, " + ", ".join(f"count(*) filter (response_time_ms <= {e}) as le_{e}" for e in (50, 100, 250, 500, 1000, 2500, 5000, 10000))
    + ", count(*) as le_inf, sum(response_time_ms)::bigint as sum_ms from webhook_deliveries where response_time_ms is not null group by 1",
    "quota_usage": """select user_id, strftime(created_at, '%Y-%m') as period, sum(completed_pages)::bigint as used,
        case when user_id = 1 then -1 else greatest(0, 200 - sum(completed_pages)) end::bigint as remaining from jobs group by user_id, 2""",
    "quota_exceeded": """select id, user_id, period, before from (select id, user_id, strftime(created_at, '%Y-%m') as period,
        coalesce(sum(completed_pages) over (partition by user_id, strftime(created_at, '%Y-%m') order by created_at, id rows between unbounded preceding and 1 preceding), 0)::bigint as before from jobs) where before >= 20""",
    "quota_previous": """with g as (select user_id, strftime(created_at, '%Y-%m') as period, sum(completed_pages)::bigint as used from jobs group by user_id, 2)
        select *, lag(period) over w as previous_period, lag(used) over w as previous_used from g window w as (partition by user_id order by period)""",
    "monitor_changes": """with x as (select monitor_id, id, content_hash, status_code, lag(content_hash) over w as old_hash, lag(status_code) over w as old_status
            from (select distinct * from monitor_checks where checked_at is not null) window w as (partition by monitor_id order by checked_at, id)),
        y as (select monitor_id, id, case when coalesce(content_hash, '') <> '' and coalesce(old_hash, '') <> '' and content_hash <> old_hash then 'content'
            when status_code is distinct from old_status and old_status is not null then 'status' end as change from x) select * from y where change is not null""",
    "monitor_counters": """select monitor_id, count(*) as checks, count(*) filter (has_changed) as changes, max(checked_at) filter (has_changed)::varchar as last_change
        from (select distinct * from monitor_checks) group by monitor_id""",
    "monitor_ema": """with x as (select distinct * from monitor_checks where checked_at is not null),
        t as (select monitor_id, list(response_time_ms::double order by checked_at, id) filter (response_time_ms is not null) as l from x group by monitor_id),
        f as (select monitor_id, count(*)::int as failures from (select *, max(case when coalesce(status_code, 599) < 400 then n end) over (partition by monitor_id) as ok
            from (select *, row_number() over (partition by monitor_id order by checked_at, id, response_time_ms, status_code) as n from x)) where n > coalesce(ok, 0) group by monitor_id)
        select monitor_id, round(list_reduce(l, lambda a, v: a * 0.7 + v * 0.3), 6) as ema_ms, coalesce(failures, 0)::int as failures from t left join f using (monitor_id)""",
    "monitor_history": """select id, status_code, has_changed from (select distinct * from monitor_checks where monitor_id = 7 and checked_at is not null) order by checked_at desc, id desc limit 20""",
    "results_of_jobs": "select user_id, type, count(*) as pages, count(*) filter (markdown is null) as empty from job_results r join jobs j on r.job_id = j.id group by user_id, type",
    "page_totals_mismatch": """select j.id, completed_pages, coalesce(stored, 0) as stored from jobs j left join (select job_id, count(*) as stored from job_results group by 1) n on j.id = n.job_id
        where coalesce(completed_pages, 0) <> coalesce(stored, 0)""",
    "cleanup_candidates": f"select id, job_id from job_results where job_id in ({_OLD})",
    "cleanup_kept": f"select id from job_results where id not in (select id from job_results where job_id in ({_OLD}))",
    "recrawled_pages": _norm("select id as page_id, url from job_results") + """select page_id as id, norm as page, copies from (select n.page_id, norm,
        count(*) over (partition by norm) as copies, row_number() over (partition by norm order by r.created_at desc, r.id desc) as k from n join job_results r on r.id = n.page_id) where k = 1 and copies > 1""",
    "undiscovered_links": _norm("select id as page_id, unnest(links) as url from job_results where true union all select -id, url from job_results").replace("page_id, url, i,", "page_id, url, i,")
    + """, u as (select distinct page_id, url, ckey from n), l as (select id as page_id, unnest(links) as url from job_results)
        select u.ckey as page, count(*) as pointers from l join u using (page_id, url) where u.ckey not in (select ckey from u where page_id < 0) group by 1""",
    "source_union": _norm("select page_id, url from pages union all select -id - 1, url from job_results") + """select norm as page, case when page_id >= 0 then 0 else 1 end as rank,
        case when page_id >= 0 then page_id else -page_id - 1 end as id from n qualify row_number() over (partition by norm order by case when page_id >= 0 then 0 else 1 end, case when page_id >= 0 then page_id else -page_id - 1 end) = 1""",
    "site_overlap": f"""with a as (select distinct {_DOM.format('url')} as host from pages), b as (select distinct {_DOM.format('url')} as host from job_results)
        select host, case when host in (select host from b) then 'both' else 'pages' end as place from a""",
    "late_rows": "select date_diff('day', created_at, ingested_at)::int as days, count(*) as n from job_results group by 1",
    "rate_limited": """with e as (select distinct user_id, epoch_us(ts) as us from events)
        select user_id, us, seen from (select *, count(*) over (partition by user_id order by us range between 3599999999 preceding and current row) as seen from e) where seen > 2""",
    "event_sessions": """with e as (select user_id, event_id, ts, lag(ts) over w as before from events window w as (partition by user_id order by ts, event_id)),
        s as (select *, sum(case when before is null or epoch_us(ts) - epoch_us(before) > 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id)::bigint as session from e)
        select user_id, session, count(*) as events, min(event_id) as first_event from s group by user_id, session""",
    "dead_letters": "select id, attempt from (select distinct id, attempt, created_at from webhook_deliveries where not success) order by created_at desc, id desc, attempt limit 1000",
    "job_transitions": """select id, case when status in ('failed', 'cancelled') then 'retry' else 'cancel' end as action from jobs where status in ('failed', 'cancelled', 'pending', 'running')""",
    "export_rows": """select id, url, json_extract_string(metadata, '$.title') as title, json_extract_string(metadata, '$.language') as language,
        try_cast(json_extract_string(metadata, '$.status_code') as int) as status_code, coalesce(length(markdown), 0)::int as markdown_length, coalesce(len(links), 0)::int as links_count from job_results""",
    "stale_hashes": "select id from job_results where markdown is not null and content_hash is not null and md5(markdown) <> content_hash",
}
SQL["webhook_backoff"] = SQL["webhook_backoff"].replace("distinct id, attempt, max_attempts, case", "id, attempt, case").replace("from webhook_deliveries where not success", "from (select distinct id, attempt, max_attempts from webhook_deliveries where not success)")
