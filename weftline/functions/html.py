"""HTML functions that need no tree: patterns over the source, inside whole-stage code."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
HREF = r'(?i)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"'
HEADING = r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"
DROPPED = r"(?is)<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)\s*>"
TAG = r"(?s)<[^>]+>"
BODY = r"(?is)<body[^>]*>(.*?)</body>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unescaped(x: Column) -> Column:
    """The five entities of XML and the blank that doesn't break."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def visible_text(html) -> Column:
    """Text of the body (without one, of all) as a reader sees it."""
    h = _c(html)
    x = F.when(h.rlike(BODY), F.regexp_extract(h, BODY, 1)).otherwise(h)
    x = F.regexp_replace(F.regexp_replace(x, DROPPED, " "), TAG, " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def title(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(_c(html), TITLE, 1), r"\s+", " "))


def hrefs(html) -> Column:
    return F.regexp_extract_all(_c(html), F.lit(HREF), 1)


def headings(html) -> Column:
    """array<struct<level, text>> in document order."""
    found = F.regexp_extract_all(_c(html), F.lit(HEADING), 0)
    made = F.transform(
        found,
        lambda x: F.struct(
            F.substring(x, 3, 1).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace(x, TAG, ""), r"\s+", " ")).alias("text")
        ),
    )
    return F.filter(made, lambda h: h["text"] != "")


def meta(html, name: str) -> Column:
    return F.regexp_extract(_c(html), rf'(?is)<meta\s+name="{name}"\s+content="([^"]*)"', 1)


def language(html) -> Column:
    return F.regexp_extract(_c(html), r'(?i)<html\b[^>]*\blang="([^"]*)"', 1)


#: Marks of a challenge in the source, whatever the length of the text.
CHALLENGE_MARKS = ["px-captcha", "human-challenge"]

#: Phrases of pages that stand between a visitor and the content, for texts of less than 800 characters.
SHORT_PHRASES = """
javascript is disabled
enable javascript
requires javascript
javascript is required
please enable javascript
you need to enable javascript
this page requires javascript
turn on javascript
activate javascript
captcha
verify you are human
verify you're human
are you a robot
not a robot
bot detection
access denied
please verify
unusual traffic
automated access
checking your browser
just a moment
attention required
please wait while we verify
ray id
performance & security by cloudflare
sucuri website firewall
pardon our interruption
press & hold
blocked by
we need to verify that you're not a robot
sorry, we just need to make sure
one more step
please click here if you are not redirected
if you are not redirected within
having trouble accessing google
your connection needs to be verified
connection is being verified
please verify your identity
robot or human
activate and hold
confirm that you're human
confirm you are human
""".strip().split("\n")

#: Those that ordinary texts of 800 to 3000 characters don't hold.
STRONG_PHRASES = """
checking your browser
just a moment
attention required
please wait while we verify
performance & security by cloudflare
sucuri website firewall
your connection needs to be verified
robot or human
activate and hold
confirm that you're human
confirm you are human
""".strip().split("\n")

#: Those that tell by the first 5000 characters of the source.
HEAD_PHRASES = """
javascript is disabled
enable javascript
attention required
just a moment
checking your browser
please wait while we verify
verify you are human
are you a robot
not a robot
please click here if you are not redirected
having trouble accessing google
""".strip().split("\n")

#: Two of these in a text of less than 500 characters are a store's page without a session.
STORE_PHRASES = ["continue shopping", "conditions of use", "privacy notice"]

#: Texts of less than 500 characters that say the page is gone.
GONE_PHRASES = """
page not found
page doesn't exist
page does not exist
this page isn't available
this page is not available
no longer available
has been removed
has been deleted
404 - not found
404 not found
error 404
sorry, we couldn't find
sorry, we could not find
the page you requested
the page you were looking for
nothing here
content not found
""".strip().split("\n")


#: White space of any script, separators of the control characters included.
BLANK = r"(?U)[\s\x1c-\x1f]+"


def body_text(html) -> Column:
    """Text of the body (without one, of all) in lower case."""
    h = _c(html)
    x = F.when(h.rlike(BODY), F.regexp_extract(h, BODY, 1)).otherwise(h)
    for name in ("script", "style", "noscript"):
        x = F.regexp_replace(x, rf"(?is)<{name}[^>]*>.*?</{name}>", " ")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, TAG, " "), BLANK, " ")))


def looks_blocked(html) -> Column:
    """Pages that stand between a visitor and the content: no source, marks of a challenge, or phrases that count
    by the length of the text; above 3000 characters only the marks count."""
    h = _c(html)

    def any_(x: Column, phrases: list[str]) -> Column:
        return functools.reduce(operator.or_, [x.contains(p) for p in phrases])

    def tiers(x: Column) -> Column:
        text, source, size = x["text"], x["source"], F.length(x["text"])
        store = functools.reduce(operator.add, [text.contains(p).cast("int") for p in STORE_PHRASES])
        return (
            F.when(any_(source, CHALLENGE_MARKS), True)
            .when(size > 3000, False)
            .when((size >= 800) & any_(text, STRONG_PHRASES), True)
            .when((size < 800) & any_(text, SHORT_PHRASES), True)
            .when(any_(x["head"], HEAD_PHRASES), True)
            .when((size < 300) & source.contains("<noscript"), True)
            .when(size < 500, x["title"].contains("google") | (store >= 2) | any_(text, GONE_PHRASES))
            .otherwise(False)
        )

    # As an element of an array, so that the texts are made once and not for each phrase.
    parts = F.struct(body_text(h).alias("text"), F.lower(h).alias("source"), F.lower(F.substring(h, 1, 5000)).alias("head"), F.lower(F.regexp_extract(h, TITLE, 1)).alias("title"))
    return F.when(h.isNull() | (h == ""), True).otherwise(F.transform(F.array(parts), tiers)[0])


def _any(x: Column, phrases: list[str]) -> Column:
    return functools.reduce(operator.or_, [x.contains(p) for p in phrases])


#: What error messages and sources hold, by class; the classes are tried in this order.
TIMEOUTS = ["timeout", "timed out", "timedout"]
NETWORK = ["connection", "dns", "resolve", "refused", "unreachable", "network", "ssl", "certificate", "eof"]
CAPTCHAS = ["captcha", "recaptcha", "hcaptcha", "verify you are human", "verify you're human"]
FIREWALLS = ["access denied", "blocked", "403 forbidden", "cloudflare", "performance & security by", "sucuri", "incapsula", "datadome", "perimeterx"]
SCRIPTS = ["javascript is disabled", "enable javascript", "requires javascript", "javascript is required"]
ALL_FAILED = "all scraping strategies failed"


def error_code(message, html=None, status=None) -> Column:
    """Class of a failure by its message, source and status; null where none applies. A message alone can only be a
    timeout, a network error, or that everything failed."""
    m = F.coalesce(F.lower(_c(message)), F.lit(""))
    h = F.coalesce(F.lower(_c(html)), F.lit("")) if html is not None else F.lit("")
    code = F.coalesce(_c(status), F.lit(0)) if status is not None else F.lit(0)
    known = (
        F.when(_any(m, TIMEOUTS), "TIMEOUT").when(_any(m, NETWORK), "NETWORK_ERROR").when(_any(h, CAPTCHAS), "CAPTCHA_REQUIRED")
        .when(_any(h, FIREWALLS) | code.isin(403, 451), "BLOCKED_BY_WAF").when(_any(h, SCRIPTS), "JS_REQUIRED").when(m.contains(ALL_FAILED), "BLOCKED_BY_WAF")
    )
    return F.when((m != "") | (h != ""), known)


#: Reasons why a page was withheld, with what its source holds and its status codes, in the order of trial.
REASONS = [
    ("Rate limited (429) — the target site is throttling requests. Try again later or use a proxy.", [], [429]),
    ("Blocked by Cloudflare WAF — the site is using Cloudflare bot protection.", ["cloudflare", "performance & security by", "ray id", "checking your browser"], []),
    ("CAPTCHA detected — the site requires human verification. Try using a browser-based strategy or proxy.", CAPTCHAS, []),
    ("Blocked by DataDome — the site uses DataDome bot detection.", ["datadome"], []),
    ("Blocked by PerimeterX — the site uses PerimeterX bot detection.", ["perimeterx"], []),
    ("Blocked by Sucuri WAF — the site uses Sucuri firewall protection.", ["sucuri"], []),
    ("Blocked by Imperva/Incapsula — the site uses Imperva bot management.", ["incapsula"], []),
    ("Blocked by Akamai Bot Manager — the site uses Akamai bot protection.", ["akamai", "your connection needs to be verified", "connection is being verified"], []),
    ("Access denied (403) — the site explicitly blocked the request.", ["access denied", "403 forbidden"], [403]),
    ("Unavailable for legal reasons (451) — content restricted in your region.", [], [451]),
    ("JavaScript required — the site needs JavaScript execution. A browser-based strategy may work.", SCRIPTS[:3], []),
]
NO_REASON = "All scraping strategies failed — the site may be using advanced bot protection. Try enabling proxy rotation."


def block_reason(html, status) -> Column:
    """Why a page was withheld, in words."""
    h, code = F.coalesce(F.lower(_c(html)), F.lit("")), F.coalesce(_c(status), F.lit(0))
    out = F.lit(NO_REASON)
    for text, phrases, codes in reversed(REASONS):
        tests = ([_any(h, phrases)] if phrases else []) + ([code.isin(*codes)] if codes else [])
        out = F.when(functools.reduce(operator.or_, tests), F.lit(text)).otherwise(out)
    return out


def noscript_block(html) -> Column:
    """A page of less than 300 characters beside its notice for browsers without scripts."""
    h = _c(html)
    return F.lower(h).contains("<noscript") & (F.length(body_text(h)) < 300)


def cache_banner_removed(html) -> Column:
    """Without the banner of a cached copy: the first element of either form."""
    x = F.regexp_replace(_c(html), r"(?is)^(.*?)<div[^>]*(?:id|class)=[\"']google-cache-hdr[\"'][^>]*>.*?</div>\s*(?:</div>)*", "$1")
    return F.regexp_replace(x, r"(?is)^(.*?)<div[^>]*style=[\"'][^\"']*text-align:\s*center[^\"']*[\"'][^>]*>.*?This is Google's cache.*?</div>", "$1")


def embedded_blocks(html) -> Column:
    """map<key, raw JSON> of the data that a page hands to its script in ``AF_initDataCallback`` calls; the last of a key counts."""
    call = r"(?s)AF_initDataCallback\(\{key:\s*'([^']+)'.*?data:(.*?)(?:,\s*sideChannel:.*?)?\}\);"
    keys, data = (F.regexp_extract_all(_c(html), F.lit(call), k) for k in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), data.alias("d"))
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys) + 1), x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["d"])))


def embedded_data(raw) -> Column:
    """The JSON of a block without what follows it; null if it isn't JSON."""
    return F.try_parse_json(F.regexp_replace(_c(raw), r"(?s),\s*sideChannel:.*$", ""))


def stripped(html) -> Column:
    """Text between tags, one blank between its parts."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(html), TAG, " "), r"\s+", " "))


def is_api_response(kind, content_type, url, pattern: str | None = None) -> Column:
    """Captured requests of scripts that were answered with data, perhaps only those whose address holds a text."""
    t = F.lower(F.coalesce(_c(content_type), F.lit("")))
    ok = _c(kind).isin("xhr", "fetch") & (t.contains("json") | t.contains("javascript"))
    return ok & _c(url).contains(pattern) if pattern else ok


def is_console_error(kind) -> Column:
    return _c(kind) == "error"


def is_picture_search_blocked(html) -> Column:
    h = F.lower(_c(html))
    return h.contains("unusual traffic") | h.contains("captcha")


#: What a shop's search page holds instead of results, and what it holds with them.
SHOP_CHALLENGES = [
    "Type the characters you see in this image", "Sorry, we just need to make sure you're not a robot", "api-services-support@amazon", "Enter the characters you see below",
]
SHOP_RESULTS = ["s-search-results", "s-result-item"]


def is_shop_search(html) -> Column:
    h = F.coalesce(_c(html), F.lit(""))
    return ~_any(h, SHOP_CHALLENGES) & _any(h, SHOP_RESULTS)
