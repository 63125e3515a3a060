"""Readers of documents and feeds as table functions over (path, content) rows of Spark's ``binaryFile`` source.

Type detection is a built-in expression; contents are read with the standard library in Arrow batches. A file
that can't be read gives a row with its error and no text, never a failed job. PDF isn't read (no library here).
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.dom import parse, to_markdown

#: Types by ending, by a part of the content type, and by the first bytes.
ENDINGS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "xls": "xlsx", "pptx": "pptx", "csv": "csv", "tsv": "csv", "rtf": "rtf", "epub": "epub"}
CONTENT_TYPES = [("pdf", "pdf"), ("wordprocessingml", "docx"), ("spreadsheetml", "xlsx"), ("ms-excel", "xlsx"), ("presentationml", "pptx"), ("csv", "csv"), ("tab-separated", "csv"), ("rtf", "rtf"), ("epub", "epub")]
MAGIC = [("25504446", "pdf"), ("7B5C7274", "rtf"), ("504B0304", "zip"), ("D0CF11E0", "xlsx")]


def document_type(path: Column, content_type: Column, content: Column) -> Column:
    """Ending first, then content type, then first bytes (``zip`` stands for the office formats), else html."""
    ending = F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    out = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), ending))
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    by_type = F.lit(None).cast("string")
    for part, kind in reversed(CONTENT_TYPES):
        by_type = F.when(ct.contains(part), kind).otherwise(by_type)
    head = F.hex(F.substring(content, 1, 4))
    by_bytes = F.lit("html")
    for magic, kind in reversed(MAGIC):
        by_bytes = F.when(head == magic, kind).otherwise(by_bytes)
    return F.coalesce(out, by_type, by_bytes)


def zip_type(data: bytes) -> str:
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    for start, kind in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx"), ("META-INF/container.xml", "epub")):
        if any(n.startswith(start) for n in names):
            return kind
    return "docx"


def _pipe(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    width = len(rows[0])
    head = [c or f"Col {i}" for i, c in enumerate(rows[0], 1)]
    body = [(r + [""] * width)[:width] for r in rows[1:]]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * width, *("| " + " | ".join(r) + " |" for r in body)])


def read_csv(data: bytes) -> tuple[str, str]:
    for enc in ("utf-8-sig", "latin-1"):
        try:
            text = data.decode(enc)
            break
        except UnicodeDecodeError:
            continue
    try:
        dialect = csv.Sniffer().sniff(text[:8192], delimiters=",\t;|")
        rows = list(csv.reader(io.StringIO(text), dialect))
    except csv.Error:
        rows = list(csv.reader(io.StringIO(text)))
    rows = [r for r in rows if r]
    return "\n".join("\t".join(r) for r in rows), _pipe(rows)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name))


def _texts(e, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == tag)


def _attr(e, name: str) -> str:
    """An attribute whatever its namespace."""
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """(kind, target) of a part's relations by their id; targets inside the file from its root."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    out = {}
    for r in _xml(z, rels) if rels in z.namelist() else ():
        target = r.get("Target", "")
        if r.get("TargetMode") != "External":
            target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
        out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
    return out


def _properties(z: zipfile.ZipFile) -> dict[str, str]:
    """What an office file says of itself."""
    if "docProps/core.xml" not in z.namelist():
        return {}
    said = {_tag(x): (x.text or "").strip() for x in _xml(z, "docProps/core.xml")}
    return {k: said.get(v, "") for k, v in (("title", "title"), ("author", "creator"), ("subject", "subject"), ("created", "created"), ("modified", "modified"))}


PICTURE_BYTES = 2 << 20


def _pictures(z: zipfile.ZipFile, relations: dict[str, tuple[str, str]]) -> int:
    """Embedded pictures of at most two megabytes."""
    sizes = {i.filename: i.file_size for i in z.infolist()}
    return sum(1 for kind, target in relations.values() if kind == "image" and 0 < sizes.get(target, 0) <= PICTURE_BYTES)


def read_xlsx(data: bytes) -> tuple[str, str, dict]:
    """Each sheet of the workbook in its order, its part found by its relation; the first row is the header."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [_texts(si) for si in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    relations = _relations(z, "xl/workbook.xml")
    numbered = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    text, md = [], []
    for k, x in enumerate(x for x in _xml(z, "xl/workbook.xml").iter() if _tag(x) == "sheet"):
        own = relations.get(next((v for n, v in x.attrib.items() if n.endswith("}id")), ""), ("", ""))[1]
        sheet = own if own in z.namelist() else numbered[k] if k < len(numbered) else None
        rows = []
        for r in (y for y in _xml(z, sheet).iter() if _tag(y) == "row") if sheet else ():
            cells: list[str] = []
            for c in r:
                ref = re.sub(r"\d", "", c.get("r", ""))
                col = 0
                for ch in ref:
                    col = col * 26 + ord(ch) - 64
                cells += [""] * (col - 1 - len(cells))
                v = next((y.text or "" for y in c if _tag(y) == "v"), "")
                cells.append(shared[int(v)] if c.get("t") == "s" and v else _texts(c) if c.get("t") == "inlineStr" else v)
            rows.append(cells)
        md.append(f"## {x.get('name')}\n\n{_pipe(rows)}")
        text += ["\t".join(r) for r in rows]
    return "\n".join(text), "\n\n".join(md), _properties(z) | {"sheets": str(len(md))}


def read_docx(data: bytes) -> tuple[str, str, dict]:
    """Title and author where the file states them, paragraphs by style with their links, then tables, pictures and notes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    body = next(x for x in _xml(z, "word/document.xml") if _tag(x) == "body")
    relations = _relations(z, "word/document.xml")
    about = _properties(z)
    val = lambda e, tag: next((v for x in e.iter() if _tag(x) == tag for k, v in x.attrib.items() if k.endswith("}val")), None)

    def run(r) -> str:
        t = _texts(r)
        on = {_tag(x) for pr in r if _tag(pr) == "rPr" for x in pr if _attr(x, "val") != "0"}
        mark = "*" * (2 * ("b" in on) + ("i" in on))
        return f"{mark}{t}{mark}" if t.strip() and mark else t

    def runs(p) -> str:
        out = ""
        for x in p:
            if _tag(x) == "r":
                out += run(x)
            elif _tag(x) == "hyperlink":
                t, url = _texts(x), relations.get(_attr(x, "id"), ("", ""))[1]
                out += f"[{t}]({url})" if t and url else t
            elif _tag(x) != "pPr":
                out += "".join(run(r) for r in x.iter() if _tag(r) == "r")
        return out

    text, tables = [], []
    md = [f"# {about.get('title') or 'Document'}", *([f"**Author:** {about['author']}"] if about.get("author") else []), "---"] if about else []
    for p in body:
        if _tag(p) == "tbl":
            rows = [[" ".join(_texts(q) for q in tc.iter() if _tag(q) == "p").strip() for tc in tr if _tag(tc) == "tc"] for tr in p if _tag(tr) == "tr"]
            tables.append(_pipe(rows))
            text += [c for r in rows for c in r if c]
        elif _tag(p) == "p" and _texts(p).strip():
            style = (val(p, "pStyle") or "").replace(" ", "")
            h = re.fullmatch(r"Heading([1-6])", style)
            depth = int(val(p, "ilvl") or 0)
            lead = "#" * int(h[1]) + " " if h else "  " * depth + ("1. " if "Number" in style else "- ") if style.startswith("List") else ""
            md.append(lead + runs(p))
            text.append(_texts(p))
    n = _pictures(z, relations)
    tables += [f"![Image {k}](embedded)" for k in range(1, n + 1)]
    notes = []
    for name in ("word/footnotes.xml", "word/endnotes.xml"):
        if name in z.namelist():
            for x in _xml(z, name):
                i = _attr(x, "id") or "0"
                if i not in ("0", "-1") and _texts(x).strip():
                    notes.append(f"[^{i}]: {_texts(x).strip()}")
    if notes:
        tables.append("## Notes\n\n" + "\n".join(notes))
    return "\n".join(text), "\n\n".join([*md, *tables]), about | {"images": str(n)}


def read_pptx(data: bytes) -> tuple[str, str, dict]:
    """Slides in the order of the presentation: title, paragraphs, tables, pictures, and the notes that belong to the slide."""
    z = zipfile.ZipFile(io.BytesIO(data))
    deck = "ppt/presentation.xml"
    relations = _relations(z, deck)
    order = [relations.get(_attr(x, "id") if not x.get("id") else next((v for k, v in x.attrib.items() if k.endswith("}id")), ""), ("", ""))[1] for x in _xml(z, deck).iter() if _tag(x) == "sldId"] if deck in z.namelist() else []
    slides = [n for n in order if n in z.namelist()] or sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    text, md, noted = [], [], 0
    for k, name in enumerate(slides, 1):
        root, own = _xml(z, name), _relations(z, name)
        in_tables = {id(p) for t in root.iter() if _tag(t) == "tbl" for p in t.iter()}
        lines = [t for p in root.iter() if _tag(p) == "p" and id(p) not in in_tables and (t := _texts(p).strip())]
        shapes = [x for x in root.iter() if _tag(x) == "sp"]
        head = next((x for x in shapes if any(_tag(y) == "ph" and y.get("type") in ("title", "ctrTitle") for y in x.iter())), None)
        title = _texts(head).strip() if head is not None else lines[0] if lines and not shapes else ""
        parts = [f"## Slide {k}: {title}" if title else f"## Slide {k}", *lines]
        for t in (x for x in root.iter() if _tag(x) == "tbl"):
            parts.append(_pipe([[_texts(c).strip() for c in r if _tag(c) == "tc"] for r in t if _tag(r) == "tr"]))
        parts += [f"![Image from slide {k}](embedded)"] * _pictures(z, own)
        text += lines
        note = next((t for kind, t in own.values() if kind == "notesSlide"), f"ppt/notesSlides/notesSlide{k}.xml" if not own else None)
        if note in z.namelist() and (t := " ".join(_texts(p) for p in _xml(z, note).iter() if _tag(p) == "p").strip()):
            parts.append(f"> Note: {t}")
            text.append(f"[Speaker Note] {t}")
            noted += 1
        md.append("\n\n".join(parts))
    return "\n".join(text), "\n\n".join(md), _properties(z) | {"slides": str(len(slides)), "notes": str(noted)}


def read_epub(data: bytes) -> tuple[str, str, dict]:
    """Title, author and chapters in reading order; of what the book says of itself the cover's file too."""
    z = zipfile.ZipFile(io.BytesIO(data))
    opf = next(x.get("full-path") for x in _xml(z, "META-INF/container.xml").iter() if _tag(x) == "rootfile")
    root, base = _xml(z, opf), opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    items = {x.get("id"): (x.get("href"), x.get("media-type", "")) for x in root.iter() if _tag(x) == "item"}
    said = {k: next((x.text.strip() for x in root.iter() if _tag(x) == t and x.text), "") for k, t in (("title", "title"), ("author", "creator"), ("language", "language"), ("publisher", "publisher"), ("date", "date"), ("description", "description"))}
    cover = next((base + href for i, (href, kind) in items.items() if "cover" in (i or "").lower() and kind.startswith("image/") and href), "")
    text, md = [], []
    for ref in (x.get("idref") for x in root.iter() if _tag(x) == "itemref"):
        href, kind = items.get(ref, (None, ""))
        if not href or "html" not in kind or base + href not in z.namelist():
            continue
        tree = parse(z.read(base + href).decode("utf-8", "replace"))
        if t := tree.text():
            text.append(t)
            md.append(f"## Chapter {len(md) + 1}\n\n{to_markdown(tree)}")
    lead = ([f"# {said['title']}"] if said["title"] else []) + ([f"**Author:** {said['author']}"] if said["author"] else [])
    return "\n\n".join(text), "\n\n".join(lead + md), {k: v for k, v in (said | {"cover": cover, "chapters": str(len(md))}).items() if v}


def read_rtf(data: bytes) -> tuple[str, str]:
    s = data.decode("latin-1")
    s = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "{}", s)
    s = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m[1]) % 65536), s)
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), s)
    s = re.sub(r"\\(?:par|line)\b ?", "\n", s).replace("\\tab ", "\t")
    s = re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", s)
    paras = [p.strip() for p in s.split("\n") if p.strip()]
    return "\n".join(paras), "\n\n".join(paras)


READERS = {"csv": read_csv, "xlsx": read_xlsx, "docx": read_docx, "pptx": read_pptx, "epub": read_epub, "rtf": read_rtf}


def documents(df: DataFrame, path: str = "path", content: str = "content", content_type: str | None = None) -> DataFrame:
    """(path, kind, text, markdown, words, error, metadata) of each file."""
    ct = F.col(content_type) if content_type else F.lit(None).cast("string")
    rows = df.select(F.col(path).alias("path"), document_type(F.col(path), ct, F.col(content)).alias("kind"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, k, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    if k == "zip":
                        k = zip_type(c)
                    if k == "html":
                        tree = parse(c.decode("utf-8", "replace"))
                        text, md, about = tree.text(), to_markdown(tree), {}
                    else:
                        text, md, *rest = READERS[k](c)
                        about = rest[0] if rest else {}
                    out.append((p, k, text, md, len(text.split()), None, list(about.items())))
                except Exception as e:  # a broken file is a row, not a failed job
                    out.append((p, k, None, None, 0, f"{type(e).__name__}: {e}"[:200], None))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["path", "kind", "text", "markdown", "words", "error", "metadata"])

    return rows.mapInArrow(run, "path string, kind string, text string, markdown string, words int, error string, metadata map<string,string>")


def sitemap(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(loc, lastmod, priority, changefreq) of every url element; malformed maps give no row."""
    entry = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), 1)).alias("e")
    get = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit("")).alias(tag)
    return df.select(entry).select(get("loc"), get("lastmod"), get("priority"), get("changefreq")).where("loc is not null")


#: Where site maps usually are when robots.txt names none.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml", "/sitemap.xml.gz", "/sitemap/sitemap.xml", "/sitemaps/sitemap.xml"]


def sitemap_candidates(sites: DataFrame, site: str = "site", robots: str = "robots", home: str = "home") -> DataFrame:
    """(site, sitemap): those that a site's robots.txt names, without any the usual paths, and those its home page links."""
    named = F.filter(F.regexp_extract_all(F.coalesce(robots, F.lit("")), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), 1), lambda x: x.startswith("http"))
    usual = F.transform(F.array(*[F.lit(p) for p in SITEMAP_PATHS]), lambda p: F.concat(F.col(site), p))
    tags = F.filter(F.regexp_extract_all(F.coalesce(home, F.lit("")), F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?(?:[^\"'>]*\s)?sitemap\b"))
    linked = F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    linked = F.filter(F.transform(linked, lambda h: F.when(h.rlike("^https?://"), h).when(h.startswith("/"), F.concat(F.col(site), h)).otherwise(F.concat(F.col(site), F.lit("/"), h))), lambda h: h != "")
    return sites.select(F.col(site), F.explode(F.array_distinct(F.concat(F.when(F.size(named) > 0, named).otherwise(usual), linked))).alias("sitemap"))


def sitemap_walk(candidates: DataFrame, fetched: DataFrame, depth: int = 3, children: int = 500) -> DataFrame:
    """(loc, lastmod, priority, changefreq), each address once: the entries of the site maps ``candidates`` (sitemap) in the
    table ``fetched`` (url, xml), and of those that index maps name, ``depth`` levels down, ``children`` of each index."""
    from pyspark.sql import Window

    level, out = candidates.select("sitemap").distinct(), None
    for _ in range(depth + 1):
        got = level.join(fetched, F.col("sitemap") == F.col("url")).select("sitemap", "xml")
        entries = sitemap(got.where(~F.col("xml").rlike(r"(?i)<sitemapindex\b")))
        out = entries if out is None else out.union(entries)
        named = F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<sitemap\b[^>]*>.*?<loc\b[^>]*>\s*(.*?)\s*</loc>"), 1)).alias("n", "child")
        level = got.where(F.col("xml").rlike(r"(?i)<sitemapindex\b")).select(named).where(F.col("n") < children).select(F.col("child").alias("sitemap")).distinct()
    first = Window.partitionBy("loc").orderBy(F.desc_nulls_last("lastmod"))
    return out.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def robots_rules_of(text: str | None, agent: str = "*") -> tuple[list[tuple[bool, str]], float | None]:
    """(rules (allow, prefix), delay) that a robots.txt gives an agent: of its own group, else of the one for all. A delay is
    at most thirty seconds."""
    groups: dict[str, tuple[list, list]] = {}
    agents: list[str] = []
    open_ = False
    for raw in (text or "").splitlines():
        key, colon, value = raw.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), ([], []))
        else:
            open_ = False
            for a in agents:
                if key in ("allow", "disallow") and (value or key == "allow"):
                    groups[a][0].append((key == "allow", value))
                elif key == "crawl-delay":
                    try:
                        groups[a][1].append(min(30.0, float(value)))
                    except ValueError:
                        pass
    rules, delays = groups.get(agent.lower()) or groups.get("*") or ([], [])
    return rules, delays[0] if delays else None


def robots_table(df: DataFrame, host: str = "host", text: str = "robots", agent: str = "*") -> DataFrame:
    """(host, allow, prefix, delay) of each rule; a host without rules or text has no row and may be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, a, p, d) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for rules, d in [robots_rules_of(t, agent)] for a, p in rules]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.string(), pa.float64()))], names=["host", "allow", "prefix", "delay"])

    return df.select(host, text).mapInArrow(run, "host string, allow boolean, prefix string, delay double")


def robots_sitemaps(df: DataFrame, text: str = "robots") -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)).alias("sitemap")).distinct()


def rss(df: DataFrame, xml: str = "xml") -> DataFrame:
    """(title, link, published, source) of every item; dates of RFC 822 as timestamps."""
    item = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), 1)).alias("e")
    get = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))
    when = F.try_to_timestamp(F.regexp_replace(get("pubDate"), r"^\w+, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return df.select(item).select(get("title").alias("title"), get("link").alias("link"), when.alias("published"), get("source").alias("source"))


def robots_allowed(urls: DataFrame, rules: DataFrame, path: Column) -> DataFrame:
    """Pages with whether their host's rules (host, allow boolean, prefix) let them be read: the longest matching
    prefix decides, allow wins a tie, no rule allows. Rules join by host, not by a cross join."""
    x = urls.withColumn("_path", path).join(rules, "host", "left")
    hit = F.when(F.col("prefix").isNotNull() & (F.col("prefix") != "") & F.startswith("_path", "prefix"), F.struct(F.length("prefix").alias("n"), F.col("allow").alias("allow")))
    best = x.groupBy("page_id").agg(F.max(hit).alias("rule"))
    return best.select("page_id", F.coalesce("rule.allow", F.lit(True)).alias("allowed"))
