"""Numbers, times and names as result pages show them, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shop_price(text) -> Column:
    """Number of a price from all its digits and dots; more than one dot leaves none."""
    return F.regexp_replace(_c(text), r"[^0-9.]", "").try_cast("double")


def shop_currency(text) -> Column:
    """The first character that is no digit, blank, comma or dot."""
    x = F.regexp_extract(F.trim(_c(text)), r"[^\p{Nd} ,.\n\t]", 0)
    return F.when(x != "", x)


#: Signs of currencies.
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥", "CNY": "¥", "KRW": "₩", "BRL": "R$", "AUD": "A$", "CAD": "C$"}


def sign(currency) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv]), _c(currency)), F.lit(""))


def money(value, currency) -> Column:
    """Amount with sign, thousands and two decimals; empty for null."""
    v = _c(value).cast("double")
    return F.when(v.isNull(), "").otherwise(F.concat(sign(currency), F.format_number(v, 2)))


def change(value, currency) -> Column:
    """Difference with its direction; none counts as down."""
    v = _c(value).cast("double")
    return F.when(v.isNull(), "").otherwise(F.concat(F.when(v > 0, "+").otherwise("-"), sign(currency), F.format_number(F.abs(v), 2)))


def clock(hour, minute) -> Column:
    """Time of day on twelve hours."""
    h, m = _c(hour).cast("int"), _c(minute).cast("int")
    shown = F.when(h % 12 == 0, 12).when(h > 12, h - 12).otherwise(h)
    return F.when(h.isNull() | m.isNull(), "").otherwise(F.concat(shown.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.when(h < 12, " AM").otherwise(" PM")))


def day_offset(leaves, arrives) -> Column:
    """``+1`` for an arrival on the next day; null on the same."""
    n = F.datediff(_c(arrives), _c(leaves))
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).when(n < 0, n.cast("string"))


def epoch_iso(seconds) -> Column:
    """Seconds of the epoch as an ISO time in UTC; null for none and zero."""
    return F.when(_c(seconds) != 0, F.concat(F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def next_run(seconds) -> Column:
    """How long it is until a run, in its largest unit."""
    s = _c(seconds).cast("bigint")
    unit = lambda size, name: F.concat(F.lit("in "), F.floor(s / size).cast("string"), F.lit(name))
    return F.when(s < 0, "overdue").when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).when(s.isNotNull(), unit(86400, "d"))


def provider_id(url) -> Column:
    """The place's id in a map address: ``/g/`` plain or encoded, else the older ``/m/``."""
    u = _c(url)
    found = [F.regexp_extract(u, p, 1) for p in (r"!19s(/g/[^!?&]+)", r"(?i)!19s(%2Fg%2F[^!?&]+)", r"!19s(/m/[^!?&]+)")]
    first = F.coalesce(*[F.when(x != "", x) for x in found])
    return F.try_url_decode(F.replace(first, F.lit("+"), F.lit("%2B")))


def thumbnail(url) -> Column:
    """Address of a picture in 600 by 400."""
    return F.regexp_replace(_c(url), r"=w[0-9]+-h[0-9]+-", "=w600-h400-")


def without_place(query) -> Column:
    """A search without the place it asks for and without filler words; the whole one where too little would be left."""
    x = F.trim(F.regexp_replace(_c(query), r"(?i)\s+(?:in|near|around|at|close to|nearby)\s+.+$", ""))
    x = F.trim(F.regexp_replace(x, r"(?i)\b(?:all|the|best|top|find|show|list of|list)\b", ""))
    return F.when(F.length(x) < 3, _c(query)).otherwise(x)


#: What attributes of places are about, by the first group of which they hold a word.
ATTRIBUTE_GROUPS = {
    "service_options": ["dine-in", "dine in", "takeout", "take-out", "takeaway", "delivery", "drive-through", "curbside", "outdoor seating", "no-contact delivery", "onsite"],
    "accessibility": ["wheelchair", "accessible", "braille"],
    "parking": ["parking", "valet", "garage"],
    "amenities": ["restroom", "wi-fi", "wifi", "bar", "rooftop", "fireplace", "live music", "tv", "pool"],
    "dining_options": ["breakfast", "brunch", "lunch", "dinner", "dessert", "seating", "catering", "counter"],
    "offerings": ["coffee", "alcohol", "beer", "wine", "cocktail", "vegetarian", "vegan", "halal", "kosher", "organic", "comfort food", "healthy", "quick bite"],
    "atmosphere": ["casual", "cozy", "trendy", "upscale", "romantic", "family"],
    "payments": ["credit card", "debit", "nfc", "cash"],
}


def attribute_group(attribute) -> Column:
    a, out = F.lower(_c(attribute)), F.lit("other")
    for name, words in reversed(ATTRIBUTE_GROUPS.items()):
        test = F.lit(False)
        for w in words:
            test = test | a.contains(w)
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def grouped_attributes(attributes) -> Column:
    """map<group, attributes> of an array, groups in the order of their first attribute; null for none."""
    made = F.transform(_c(attributes), lambda x: F.struct(attribute_group(x).alias("g"), x.alias("a")))
    names = F.array_distinct(F.transform(made, lambda x: x["g"]))
    entries = F.transform(names, lambda n: F.struct(n, F.transform(F.filter(made, lambda x: x["g"] == n), lambda x: x["a"])))
    return F.when(F.size(_c(attributes)) > 0, F.map_from_entries(entries))


def hex_pair_id(pair) -> Column:
    """The second of a pair of hexadecimal numbers as an unsigned decimal."""
    p = F.split(_c(pair), ":")
    return F.when(F.size(p) == 2, F.conv(F.regexp_replace(F.element_at(p, 2), "^0[xX]", ""), 16, 10))


def inside(data, *steps: str | int) -> Column:
    """What stands in JSON text at the end of a path of names and positions; null where the path breaks or a null stands
    (which can't be told from the text ``null``)."""
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in steps)
    return F.nullif(F.get_json_object(_c(data), path), F.lit("null"))
