"""URL functions as Spark columns: splitting, normal forms for storage, crawl and site map, predicates, scores.

All of them are built-in expressions, so a filter on a normal form stays in whole-stage code. A URL whose port
isn't a number has no normal form (null); a null URL gives null throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986, appendix B: scheme, authority, path, query, fragment.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

#: Parameters that only track where a visitor came from.
TRACKING = """
utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform utm_creative_format fbclid gclid gclsrc
dclid gbraid wbraid msclkid twclid li_fat_id mc_cid mc_eid ref _ref ref_src ref_url si s share igshid oly_enc_id oly_anon_id
vero_id wickedid __hstc __hssc __hsfp hsCtaTracking _ga _gl _hsenc _openstat nb_klid plan guccounter
""".split()
#: Parameters that name the content and are kept whatever their value looks like.
CONTENT_IDS = """
id product_id productid item_id itemid sku asin isbn upc ean article_id articleid post_id postid doc_id docid ref variant
variant_id variantid catalog_id catalogid
""".split()
#: Parameters of navigation inside one page's content.
NAVIGATION = "page p pg offset start limit per_page sort order orderby sortby dir direction view display layout tab section lang language locale hl".split()
#: Path parts that the site map leaves out, found anywhere in the path.
MAP_JUNK = """
/wishlist /cart /checkout /login /signin /signup /register /account /my-account /profile /address /saved /oauth /callback /api/
/graphql /password /forgot-password /reset-password /admin /wp-admin /wp-login
""".split()
#: Endings of files that aren't pages.
SKIPPED = ".pdf .jpg .jpeg .png .gif .svg .webp .mp4 .mp3 .zip .tar .gz .css .js".split()
#: Weights of endings, first match in this order; 1 where none matches.
ENDING_WEIGHTS = [
    (".html", 1.0), (".htm", 1.0), (".php", 0.9), (".asp", 0.9), (".aspx", 0.9), (".jsp", 0.9), (".pdf", 0.7), (".doc", 0.5), (".docx", 0.5),
    (".xml", 0.6), (".json", 0.6), (".jpg", 0.1), (".png", 0.1), (".gif", 0.1), (".svg", 0.1), (".css", 0.0), (".js", 0.0), (".zip", 0.0),
]
#: Fixed value: values that look like a session: a long hexadecimal number, a long token, or a UUID inside.
SESSION = r"(?i)^[0-9a-f]{16,}$|^[A-Za-z0-9+/=_-]{20,}$|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_c(url), PARTS, 1))


def netloc(url) -> Column:
    return F.regexp_extract(_c(url), PARTS, 2)


def path(url) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(_c(url), PARTS, 3), r";[^/]*$", "")


def query(url) -> Column:
    return F.regexp_extract(_c(url), PARTS, 4)


def domain(url) -> Column:
    """Lower-cased authority without a leading ``www.``."""
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def with_scheme(url) -> Column:
    u = _c(url)
    return F.when(u.rlike(r"^(https?:)?//"), u).otherwise(F.concat(F.lit("https://"), u))


def homepage(url) -> Column:
    """Home page of the site, null where the URL is it already."""
    home = F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/"))
    return F.when(F.regexp_replace(_c(url), "/+$", "") == F.regexp_replace(home, "/+$", ""), F.lit(None)).otherwise(home)


def last_two_labels(url) -> Column:
    labels = F.split(domain(url), r"\.")
    return F.when(F.size(labels) >= 2, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise(domain(url))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pairs(url) -> Column:
    """array<struct<k, v>> of the query, decoded, in order; parts without a name are left out."""
    parts = F.filter(F.split(query(url), "&"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            _decoded(F.regexp_extract(x, r"^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(x, r"^[^=]*=?(.*)$", 1)).alias("v")
        ),
    )


def _written(ps: Column) -> Column:
    return F.array_join(F.transform(ps, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def kept_pairs(url) -> Column:
    """Pairs that matter, sorted by name with each name's values in their order."""
    ps = pairs(url)
    first = lambda k: F.element_at(F.filter(ps, lambda p: p["k"] == k), 1)["v"]
    keep = F.filter(
        ps,
        lambda p: ~F.lower(p["k"]).isin(*TRACKING)
        & (F.lower(p["k"]).isin(*CONTENT_IDS) | ~first(p["k"]).rlike(SESSION)),
    )
    numbered = F.transform(keep, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    return F.array_sort(numbered)


def _base(url) -> Column:
    s = F.when(scheme(url) == "", F.lit("https")).otherwise(scheme(url))
    auth = netloc(url)
    user = F.regexp_extract(auth, r"^(.*@)", 1)
    hp = F.regexp_replace(auth, r"^.*@", "")
    port = F.regexp_extract(hp, r":([^:\]]*)$", 1)
    name = F.regexp_replace(F.lower(F.regexp_replace(hp, r":[^:\]]*$", "")), r"^www\.", "")
    drop = (port == "") | ((s == "http") & (port == "80")) | ((s == "https") & (port == "443"))
    p = F.regexp_replace(F.when(path(url) == "", F.lit("/")).otherwise(path(url)), "/{2,}", "/")
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    p = F.regexp_replace(p, r"/index\.html?$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    full = F.concat(s, F.lit("://"), user, name, F.when(drop, F.lit("")).otherwise(F.concat(F.lit(":"), port)), p)
    return F.when(port.rlike(r"^[0-9]*$"), full)


def _with_query(base: Column, q: Column) -> Column:
    return F.when(q == "", base).otherwise(F.concat(base, F.lit("?"), q))


def normalized(url) -> Column:
    """Normal form for storage and de-duplication."""
    return _with_query(_base(url), _written(kept_pairs(url)))


def crawl_key(url) -> Column:
    """Normal form in which navigation parameters don't count either."""
    ps = F.filter(kept_pairs(url), lambda p: ~F.lower(p["k"]).isin(*NAVIGATION))
    return _with_query(_base(url), _written(ps))


def is_facet(a, b) -> Column:
    return crawl_key(a) == crawl_key(b)


def map_junk(url) -> Column:
    p = F.lower(path(url))
    return reduce(lambda x, y: x | y, [p.contains(j) for j in MAP_JUNK])


def segments(url) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression; ``*`` crosses slashes."""
    out = ""
    for ch in glob:
        out += ".*" if ch == "*" else "." if ch == "?" else ch if ch.isalnum() or ch in "/_-" else "\\" + ch
    return f"^(?s:{out})$"


#: Path segments of pages that a crawl leaves out, compared whole.
CRAWL_JUNK = "wp-admin wp-login wp-json admin login logout signup register cart checkout account password feed rss xmlrpc cgi-bin".split()


def should_crawl(url, depth, site: str, max_depth: int = 3, include: tuple = (), exclude: tuple = ()) -> Column:
    p = path(url)
    ok = (_c(depth) <= max_depth) & (domain(url) == F.lit(site)) & scheme(url).isin("http", "https")
    ok &= ~F.arrays_overlap(F.transform(segments(url), F.lower), F.array(*[F.lit(j) for j in CRAWL_JUNK]))
    ok &= ~F.lower(p).rlike("(" + "|".join(x.replace(".", "\\.") for x in SKIPPED) + ")$")
    if include:
        ok &= reduce(lambda x, y: x | y, [p.rlike(glob_pattern(g)) for g in include])
    for g in exclude:
        ok &= ~p.rlike(glob_pattern(g))
    return ok


def ending_weight(url) -> Column:
    p = F.lower(path(url))
    out = F.lit(1.0)
    for ending, w in reversed(ENDING_WEIGHTS):
        out = F.when(p.endswith(ending), F.lit(w)).otherwise(out)
    return out


def keyword_score(url, words: list[str]) -> Column:
    u = F.lower(_c(url))
    hits = reduce(lambda a, b: a + b, [u.contains(w.lower()).cast("int") for w in words]) if words else F.lit(0)
    return hits / F.lit(float(max(1, len(words))))


def depth_score(url, best: int = 2) -> Column:
    return 1.0 / (1.0 + F.abs(F.size(segments(url)) - best))


def freshness_score(url, this_year: int = 2026) -> Column:
    year = F.regexp_extract(_c(url), r"(20[12][0-9])", 1)
    age = F.lit(this_year) - F.when(year != "", year).cast("int")
    return F.when(age.isNull(), 0.5).when(age <= 0, 1.0).when(age == 1, 0.9).when(age == 2, 0.7).when(age <= 5, 0.4).otherwise(0.2)


def composite_score(scores: list[tuple[Column, float]]) -> Column:
    total = sum(w for _, w in scores)
    return reduce(lambda a, b: a + b, [s * F.lit(w) for s, w in scores]) / F.lit(total if total > 0 else 1.0)


def cache_key(url, formats: Column) -> Column:
    return F.sha2(F.concat_ws(":", _c(url), F.array_join(F.array_sort(formats), ",")), 256)


def masked(url) -> Column:
    """User and password hidden."""
    return F.regexp_replace(_c(url), r"://[^/@:]+(?::[^/@]*)?@", "://***:***@")


def without_dots(p: Column) -> Column:
    """A path with its ``.`` and ``..`` segments worked out."""
    parts = F.split(p, "/", -1)
    made = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), F.lit(""),
        lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x)),
    )
    made = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(made, F.lit("/"))).otherwise(made)
    return F.when(p.contains("/."), made).otherwise(p)


def resolved(href, base) -> Column:
    """Absolute form of a reference; null for anchors and for schemes that lead nowhere."""
    h, b = F.trim(_c(href)), _c(base)
    root = F.concat(scheme(b), F.lit("://"), netloc(b))
    folder = F.regexp_replace(F.when(path(b) == "", F.lit("/")).otherwise(path(b)), r"[^/]*$", "")
    rest = F.regexp_extract(h, r"[?#].*$", 0)
    own = F.regexp_replace(h, r"[?#].*$", "")
    return (
        F.when((h == "") | h.rlike(r"(?i)^(#|javascript:|mailto:|tel:|data:)"), F.lit(None))
        .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h))
        .when(h.startswith("?"), F.concat(root, path(b), h))
        .otherwise(F.concat(root, without_dots(F.when(h.startswith("/"), own).otherwise(F.concat(folder, own))), rest))
    )


#: Query parameters that don't tell pages of a site map apart.
MAP_TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform utm_creative_format utm_marketing_tactic "
    "_ga _gl _gid gclid gclsrc dclid gbraid wbraid fbclid fb_action_ids fb_action_types fb_source fb_ref msclkid li_fat_id twclid "
    "_hsenc _hsmi hsa_cam hsa_grp hsa_mt hsa_src hsa_ad hsa_acc hsa_net hsa_ver hsa_la hsa_ol hsa_kw hsa_tgt mc_cid mc_eid "
    "sc_campaign sc_channel sc_content sc_medium sc_outcome sc_geo sc_country ref referer referrer source medium trk trkInfo trackingId "
    "intcmp icid int_cmp transaction_id sid sessionid jsessionid phpsessid aspsessionid mkt_tok oly_anon_id oly_enc_id otc vero_id "
    "wickedid browser_id yclid ymclid"
).split()


def map_normalized(url) -> Column:
    """Normal form for site maps: only addresses with a query change; they lose their fragment and the parameters above
    (names are compared in lower case, so the two spelled with capitals never match). Values of one name go together where it first
    stands."""
    ps = pairs(url)
    kept = F.filter(ps, lambda p: ~F.lower(p["k"]).isin(*MAP_TRACKING))
    names = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    together = F.flatten(F.transform(names, lambda n: F.filter(kept, lambda p: p["k"] == n)))
    stem = F.concat(F.when(scheme(url) == "", F.lit("")).otherwise(F.concat(scheme(url), F.lit("://"))), netloc(url), path(url))
    return F.when(query(url) == "", _c(url)).otherwise(_with_query(stem, _written(together)))


def pythonic(flag: Column) -> Column:
    return F.when(flag, F.lit("True")).otherwise(F.lit("False"))


def map_key(url, limit, subdomains, sitemap, search) -> Column:
    """Cache key of a site map's request."""
    return F.sha2(F.concat_ws(":", _c(url), _c(limit).cast("string"), pythonic(_c(subdomains)), pythonic(_c(sitemap)), F.coalesce(_c(search), F.lit(""))), 256)


def search_key(query_, results, engine, formats: Column) -> Column:
    return F.sha2(F.concat_ws(":", _c(query_), _c(results).cast("string"), _c(engine), F.array_join(F.array_sort(formats), ",")), 256)


def crawl_request_key(url, pages, depth) -> Column:
    return F.sha2(F.concat_ws(":", _c(url), _c(pages).cast("string"), _c(depth).cast("string")), 256)


#: Endings of addresses that lead to pages.
PAGE_ENDINGS = ["", ".html", ".htm", ".php", ".asp", ".aspx", ".jsp", ".shtml", ".xhtml"]
#: Hosts of videos.
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be"]
#: Hosts, with their subdomains, and first labels of hosts that are hard to fetch from.
HARD_HOSTS = (
    "google.com youtube.com facebook.com instagram.com twitter.com x.com linkedin.com reddit.com tiktok.com pinterest.com zillow.com indeed.com "
    "glassdoor.com walmart.com target.com bestbuy.com cloudflare.com netflix.com spotify.com ticketmaster.com stubhub.com craigslist.org yelp.com"
).split()
HARD_LABELS = "amazon nike adidas ebay booking airbnb expedia flipkart myntra ajio zara hm".split()
#: Languages asked for by the end of the host.
LOCALES = {
    ".in": "en-IN,en;q=0.9,hi;q=0.8", ".co.uk": "en-GB,en;q=0.9", ".de": "de-DE,de;q=0.9,en;q=0.8", ".fr": "fr-FR,fr;q=0.9,en;q=0.8",
    ".co.jp": "ja-JP,ja;q=0.9,en;q=0.8", ".es": "es-ES,es;q=0.9,en;q=0.8", ".it": "it-IT,it;q=0.9,en;q=0.8", ".com.au": "en-AU,en;q=0.9", ".ca": "en-CA,en;q=0.9",
}


def page_ending(url) -> Column:
    """From the last dot of the path on, where that isn't its first character."""
    return F.lower(F.regexp_extract(path(url), r"(?s)^.+(\.[^.]*)$", 1))


def is_page(url) -> Column:
    return page_ending(url).isin(*PAGE_ENDINGS)


def is_video(url) -> Column:
    return F.lower(netloc(url)).isin(*VIDEO_HOSTS)


def is_hard(url) -> Column:
    d = domain(url)
    return d.rlike(r"(^|\.)(" + "|".join(h.replace(".", r"\.") for h in HARD_HOSTS) + ")$") | F.substring_index(d, ".", 1).isin(*HARD_LABELS)


def locale(url) -> Column:
    """Language header by the longest ending of the host that is listed."""
    out, host = F.lit("en-US,en;q=0.9"), F.lower(netloc(url))
    for end in sorted(LOCALES, key=len):
        out = F.when(host.endswith(end), F.lit(LOCALES[end])).otherwise(out)
    return out


def pattern_filter(url, globs: tuple = (), patterns: tuple = (), negate: bool = False) -> Column:
    """Any of the globs on the path, or of the patterns anywhere in the address; all pass where there are none."""
    tests = [path(url).rlike(glob_pattern(g)) for g in globs] + [_c(url).rlike(p) for p in patterns]
    ok = reduce(lambda x, y: x | y, tests) if tests else F.lit(True)
    return ~ok if negate else ok


def domain_filter(url, allowed: tuple = (), blocked: tuple = ()) -> Column:
    """Blocked hosts never pass; where some are allowed only those do."""
    d = domain(url)
    ok = d.isin(*allowed) if allowed else F.lit(True)
    return ok & ~d.isin(*blocked) if blocked else ok
