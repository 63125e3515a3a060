"""Text functions as Spark columns: chunking, sentence and topic splits, hashes, citations, numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight in relevance.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might shall can this that these those it its not no so if as"
).split()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    return F.filter(F.split(F.trim(_c(text)), r"\s+"), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text))


def reading_seconds(text) -> Column:
    """At 200 words a minute, whole minutes, at least one; half minutes go to the even one."""
    return F.greatest(F.lit(1), F.bround(word_count(text) / 200).cast("int")) * 60


def _windows(w: Column, size: int, step: int, last: Column) -> Column:
    starts = F.sequence(F.lit(0), last, F.lit(step))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))


def chunks_fixed(text, size: int = 100) -> Column:
    w = words(text)
    return F.when(F.size(w) > 0, _windows(w, size, size, F.size(w) - 1)).otherwise(F.array().cast("array<string>"))


def chunks_sliding(text, size: int = 100, step: int = 50) -> Column:
    """Windows at every step; the last words once more where no window ends there; short texts whole, as they are; a blank one
    has none."""
    w, t = words(text), _c(text)
    full = _windows(w, size, step, F.size(w) - size)
    rest = F.pmod(F.size(w) - size, F.lit(step)) != 0
    tail = F.array(F.array_join(F.slice(w, F.greatest(F.size(w) - size, F.lit(0)) + 1, size), " "))
    short = F.when(F.size(w) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(w) <= size, short).otherwise(F.when(rest, F.concat(full, tail)).otherwise(full))


def chunks_overlapping(text, size: int = 1000, overlap: int = 100) -> Column:
    """Windows that share ``overlap`` words; none begins once the end is reached; a blank text has none."""
    w, step, t = words(text), max(1, size - overlap), _c(text)
    count = F.ceil((F.size(w) - size) / step).cast("int")
    short = F.when(F.size(w) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(w) <= size, short).otherwise(_windows(w, size, step, count * step))


def chunks_split(text, pattern: str = r"\n\n") -> Column:
    return F.filter(F.transform(F.split(_c(text), pattern), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def sentences(text) -> Column:
    return chunks_split(text, r"(?<=[.!?])\s+(?=[A-Z])")


def topics(text) -> Column:
    """Sections with their heading; the whole text where there's none."""
    return chunks_split(text, r"(?m)^(?=#{1,6}\s)")


def chunks_merged(text, most: int = 7500) -> Column:
    """Paragraphs put together as long as a chunk stays within ``most`` words; a longer paragraph is a chunk of its own,
    and a text within the limit is whole."""
    size = lambda x: F.size(words(x))
    none = F.array().cast("array<string>")
    step = lambda a, x: F.when(
        size(F.concat(a["now"], F.lit("\n\n"), x)) > most,
        F.struct(F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"), x.alias("now")),
    ).otherwise(F.struct(a["done"].alias("done"), F.when(a["now"] == "", x).otherwise(F.concat(a["now"], F.lit("\n\n"), x)).alias("now")))
    start = F.struct(none.alias("done"), F.lit("").alias("now"))
    made = F.aggregate(chunks_split(text), start, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    return F.when(size(text) > most, made).otherwise(F.array(_c(text)))


def content_hash(text) -> Column:
    return F.md5(F.lower(F.trim(F.regexp_replace(_c(text), r"[ \t\n\x0B\f\r]+", " "))))


def tokens(text) -> Column:
    """Terms for relevance: lower-case ASCII words of two letters or more without stop words."""
    w = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(w, lambda x: x.rlike("^[a-z]{2,}$") & ~x.isin(*STOP_WORDS))


def unique_paragraphs(text, least: int = 80) -> Column:
    """Long paragraphs that repeat inside one text are kept once, the first."""
    parts = F.split(_c(text), r"\n{2,}")
    key = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    keys = F.transform(parts, key)
    keep = F.filter(parts, lambda x, i: (F.length(F.trim(x)) < least) | (F.array_position(keys, key(x)) == (i + 1).cast("bigint")))
    return F.array_join(keep, "\n\n")


LINK = r"\[([^\]]+)\]\(([^)]+)\)"


def link_targets(markdown) -> Column:
    return F.regexp_extract_all(_c(markdown), F.lit(LINK), 2)


def link_texts(markdown) -> Column:
    return F.regexp_extract_all(_c(markdown), F.lit(LINK), 1)


def references(markdown) -> Column:
    """``⟨n⟩ target — text`` of each distinct link target in order of appearance, with its first text."""
    urls, texts = link_targets(markdown), link_texts(markdown)
    first = lambda u: F.element_at(texts, F.array_position(urls, u).cast("int"))
    return F.transform(F.array_distinct(urls), lambda u, i: F.concat(F.lit("⟨"), (i + 1).cast("string"), F.lit("⟩ "), u, F.lit(" — "), first(u)))


def cited(markdown) -> Column:
    """Links replaced by their text and the number of their target."""
    urls, texts = link_targets(markdown), link_texts(markdown)
    number = lambda i: F.array_position(F.array_distinct(urls), F.get(urls, i)).cast("string")
    parts = F.split(_c(markdown), LINK, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.concat(F.get(texts, i), F.lit("⟨"), number(i), F.lit("⟩")), F.lit("")))), "")


def slug(text, mark: str = "-") -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


#: Currency by the first of these signs that a price holds, in this order.
CURRENCIES = [
    ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₩", "KRW"), ("R$", "BRL"),
    ("A$", "AUD"), ("C$", "CAD"), ("₺", "TRY"), ("zł", "PLN"), ("kr", "SEK"), ("Fr", "CHF"),
]


def price(text) -> Column:
    """The first number of a price, thousands separated by commas; where it holds none, one with a decimal comma."""
    t = F.replace(F.trim(_c(text)), F.lit(" "), F.lit(""))
    plain = F.replace(F.regexp_extract(t, r"[0-9,]+\.?[0-9]*", 0), F.lit(","), F.lit(""))
    other = F.replace(F.replace(F.regexp_extract(t, r"[0-9.]+,[0-9]{2}", 0), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(plain.try_cast("double"), other.try_cast("double"))


def currency(text) -> Column:
    """Code of the currency; a sign that is part of a longer one counts as itself, as it stands first in the list."""
    t, out = _c(text), F.lit(None).cast("string")
    for sign, code in reversed(CURRENCIES):
        out = F.when(t.contains(sign), F.lit(code)).otherwise(out)
    return out


def duration(minutes) -> Column:
    m = _c(minutes).cast("bigint")
    h, r = F.floor(m / 60), m % 60
    return F.when(h == 0, F.concat(r.cast("string"), F.lit(" min"))).when(r == 0, F.concat(h.cast("string"), F.lit(" hr"))).otherwise(
        F.concat(h.cast("string"), F.lit(" hr "), r.cast("string"), F.lit(" min"))
    )


def signed_percent(x) -> Column:
    return F.concat(F.when(_c(x) > 0, "+").otherwise(""), F.format_string("%.2f%%", _c(x).cast("double")))


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | "), F.lit(" |"))
