"""Operators that need the element tree: cleaning, Markdown, tables, selectors, links, metadata, product data.

The tree is built by the standard library's tolerant parser, in Arrow batches on the executors. Deviations from
a full HTML 5 parser: no implied table bodies; a paragraph ends where the next block begins; an unclosed element
ends with its parent. Null HTML gives null (or no rows), malformed HTML what could be read of it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Elements that hold no content of a page.
JUNK = frozenset("script style noscript template svg iframe object embed canvas nav footer header aside form button select input".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "depth")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent
        self.depth = parent.depth + 1 if parent is not None else 0

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, sep: str = " ") -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(n.strip())
            elif n.tag not in ("script", "style", "noscript", "template"):
                stack += reversed(n.children)
        return sep.join(out)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


#: Elements nested deeper than this stand beside what they hold, as in browsers, so that no source is too deep to be read.
DEEPEST = 300


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and tag not in ("td", "th", "tr", "li"):
            self._close_open("p")
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            self._close_sibling(tag)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID and node.depth < DEEPEST:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _close_open(self, tag):
        if self.at.tag == tag:
            self.at = self.at.parent

    def _close_sibling(self, tag):
        stop = {"li": ("ul", "ol"), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}.get(tag, ("dl", "select"))
        same = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
        n = self.at
        while n is not None and n.tag not in stop and n.tag != "#root":
            if n.tag in same:
                self.at = n.parent
                return
            n = n.parent


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# Selectors: tag, .class, #id, [attr], [attr=v], [attr*=v], [attr^=v], [attr$=v], :not(...), descendants, children, lists.
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$~]?=)[\"']?([^\"'\]]*)[\"']?)?\]|:not\(([^)]*)\)")


def _matcher(simple: str) -> Callable[[Node], bool]:
    tests = []
    for tag, cls, id_, attr, op, val, neg in _SIMPLE.findall(simple):
        if tag:
            tests.append(lambda n, t=tag.lower(): t == "*" or n.tag == t)
        elif cls:
            tests.append(lambda n, c=cls: c in n.classes)
        elif id_:
            tests.append(lambda n, i=id_: n.attrs.get("id") == i)
        elif attr:
            how = {"=": lambda a, v: a == v, "*=": lambda a, v: v in a, "^=": lambda a, v: a.startswith(v), "$=": lambda a, v: a.endswith(v), "~=": lambda a, v: v in a.split()}
            tests.append(lambda n, a=attr, o=op, v=val: a in n.attrs and (not o or how[o](n.attrs[a], v)))
        elif neg:
            inner = _matcher(neg)
            tests.append(lambda n, f=inner: not f(n))
    return lambda n: all(t(n) for t in tests)


def select(root: Node, selector: str) -> list[Node]:
    """Elements that match a selector list, in document order."""
    chains = []
    for one in selector.split(","):
        steps = []
        child = False
        for part in re.findall(r">|[^\s>]+(?:\([^)]*\))?", one):
            if part == ">":
                child = True
            else:
                steps.append((child, _matcher(part)))
                child = False
        if steps:
            chains.append(steps)

    def fits(n: Node, steps: list) -> bool:
        if not steps[-1][1](n):
            return False
        if len(steps) == 1:
            return True
        up = n.parent
        while up is not None and up.tag != "#root":
            if fits(up, steps[:-1]):
                return True
            if steps[-1][0]:
                return False
            up = up.parent
        return False

    return [n for n in root.walk() if n.tag != "#root" and any(fits(n, s) for s in chains)]


def hidden(n: Node) -> bool:
    style = n.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in n.attrs or "display:none" in style or "visibility:hidden" in style or (n.attrs.get("aria-hidden") == "true" and len(n.text()) < 30)


def cleaned(root: Node, exclude: tuple[str, ...] = ()) -> Node:
    """Without junk elements, hidden ones, and what ``exclude`` selects."""
    gone = {id(n) for s in exclude for n in select(root, s)}

    def keep(n: Node) -> None:
        n.children = [c for c in n.children if isinstance(c, str) or not (c.tag in JUNK or hidden(c) or id(c) in gone)]
        for c in n.children:
            if not isinstance(c, str):
                keep(c)

    keep(root)
    return root


def main_container(root: Node) -> Node:
    """The element that holds the content: main, article or its usual names with enough text, else the body."""
    for least in (500, 100):
        for s in ("main", "article", "[role=main]", "#content", "#main-content", ".main-content"):
            found = select(root, s)
            if found and sum(len(n.text()) for n in found) > least:
                whole = Node("div")
                whole.children = list(found)
                return whole
    body = select(root, "body")
    return body[0] if body else root


def _inline(n) -> str:
    if isinstance(n, str):
        return re.sub(r"\s+", " ", n)
    if n.tag in ("script", "style", "noscript", "template"):
        return ""
    if n.tag == "br":
        return "  \n"
    if n.tag == "img":
        src = n.attrs.get("src", "")
        return f"![{n.attrs.get('alt', '')}]({src})" if src else ""
    inside = "".join(map(_inline, n.children))
    if n.tag == "a":
        href = n.attrs.get("href", "")
        t = inside.strip()
        title = f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""
        return inside if not t or not href or href == "#" else f"[{t}]({href}{title})"
    if n.tag == "time":
        stamp = n.attrs.get("datetime", "")
        return f"{inside} ({stamp})" if stamp and inside.strip() and stamp != inside.strip() else inside
    if n.tag == "summary":
        return f"**{inside.strip()}**" if inside.strip() else ""
    mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`"}.get(n.tag)
    return f"{mark}{inside.strip()}{mark}" if mark and inside.strip() else inside


def _cells(tr: Node) -> list[str]:
    out: list[str] = []
    for c in tr.children:
        if not isinstance(c, str) and c.tag in ("td", "th"):
            span = c.attrs.get("colspan", "1")
            out += [c.text()] * max(1, min(1000, int(span)) if span.isdigit() else 1)  # the HTML standard's own limit
    return out


def table_rows(table: Node) -> tuple[list[str], list[list[str]]]:
    """Header (of ``th`` cells, doubles numbered, blanks named) and rows with spans written out."""
    trs = [n for n in table.walk() if n.tag == "tr"]
    header: list[str] = []
    rows = []
    for k, tr in enumerate(trs):
        cells = _cells(tr)
        if k == 0 and any(not isinstance(c, str) and c.tag == "th" for c in tr.children):
            seen: dict[str, int] = {}
            for i, h in enumerate(cells, 1):
                h = h or f"Column {i}"
                seen[h] = seen.get(h, 0) + 1
                header.append(h if seen[h] == 1 else f"{h} {seen[h]}")
        elif cells:
            rows.append(cells)
    if not header and rows:
        header = [f"Column {i}" for i in range(1, max(map(len, rows)) + 1)]
    return header, [(r + [""] * len(header))[: len(header)] for r in rows]


def data_table(table: Node) -> bool:
    """Tables of data, not of layout, by their parts and regularity."""
    tags = [n.tag for n in table.walk()]
    widths = {len(_cells(n)) for n in table.walk() if n.tag == "tr"}
    rows = tags.count("tr")
    score = 2 * ("thead" in tags) + ("tbody" in tags) + 2 * ("th" in tags) + 2 * ("caption" in tags) + ("summary" in table.attrs)
    score += 2 * (rows >= 2 and len(widths) <= 2) + (rows >= 3) - 3 * (tags.count("table") > 1) - 3 * (table.attrs.get("role") in ("presentation", "none"))
    return score >= 3


def to_markdown(root: Node) -> str:
    out: list[str] = []

    def block(text: str) -> None:
        if text.strip():
            out.append(text.strip())

    def items(n: Node, depth: int) -> list[str]:
        made, number = [], 0
        for c in n.children:
            if isinstance(c, str) or c.tag != "li":
                continue
            number += 1
            own = "".join(_inline(x) for x in c.children if isinstance(x, str) or x.tag not in ("ul", "ol")).strip()
            made.append("  " * depth + (f"{number}. " if n.tag == "ol" else "- ") + re.sub(r"\s+", " ", own))
            for x in c.children:
                if not isinstance(x, str) and x.tag in ("ul", "ol"):
                    made += items(x, depth + 1)
        return made

    def visit(n: Node) -> None:
        run: list[str] = []

        def flush() -> None:
            block(re.sub(r"[ \t]+", " ", "".join(run)))
            run.clear()

        for c in n.children:
            if isinstance(c, str) or c.tag not in BLOCK:
                if isinstance(c, Node) and any(x.tag in BLOCK for x in c.walk()):
                    flush()
                    visit(c)
                else:
                    run.append(_inline(c))
                continue
            flush()
            if c.tag[0] == "h" and c.tag[1:].isdigit():
                t = re.sub(r"\s+", " ", "".join(map(_inline, c.children))).strip()
                block(f"{'#' * int(c.tag[1])} {t}" if t else "")
            elif c.tag in ("ul", "ol"):
                block("\n".join(items(c, 0)))
            elif c.tag == "pre":
                code = next((x for x in c.walk() if x.tag == "code"), c)
                lang = next((k[9:] for k in code.classes if k.startswith("language-")), "")
                raw = "".join(x if isinstance(x, str) else x.text("") for x in code.children)
                out.append(f"```{lang}\n{raw.strip(chr(10))}\n```")
            elif c.tag == "blockquote":
                block("\n".join("> " + x for x in to_markdown(c).split("\n")))
            elif c.tag == "table":
                head, rows = table_rows(c)
                if head:
                    block("\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(r) + " |" for r in rows)]))
            elif c.tag == "hr":
                block("---")
            elif c.tag == "dt":
                block("**" + "".join(map(_inline, c.children)).strip() + "**")
            elif c.tag == "dd":
                block(": " + "".join(map(_inline, c.children)).strip())
            else:
                visit(c)
        flush()

    visit(root)
    return "\n\n".join(out)


_GAPS, _TAIL, _WIDE = re.compile(r"\n{3,}"), re.compile(r"[ \t]+\n"), re.compile(r"([^\n]) {3,}")


def postprocess(md: str) -> str:
    """Blank runs, trailing and repeated blanks outside code fences; long paragraphs that repeat; empty headings."""
    parts = re.split(r"(```[^\n]*\n.*?```)", md, flags=re.S)
    parts[::2] = [_WIDE.sub(r"\1 ", _TAIL.sub("\n", _GAPS.sub("\n\n", p))) for p in parts[::2]]
    seen: set[str] = set()
    keep = []
    for p in re.split(r"\n{2,}", "".join(parts)):
        key = " ".join(p.lower().split())
        if len(key) < 80 or key not in seen:
            keep.append(p)
        seen.add(key)
    return _GAPS.sub("\n\n", re.sub(r"(?m)^#{1,6}\s*$", "", "\n\n".join(keep))).strip()


def structured_data(root: Node) -> dict:
    ld, og, tw, metas = [], {}, {}, {}
    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            try:
                ld.append(json.loads("".join(c for c in n.children if isinstance(c, str))))
            except ValueError:
                pass
        elif n.tag == "meta" and "content" in n.attrs:
            name = n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("http-equiv")
            if name:
                metas[name] = n.attrs["content"]
                if name.startswith("og:"):
                    og.setdefault(name[3:], []).append(n.attrs["content"])
                elif name.startswith("twitter:"):
                    tw[name[8:]] = n.attrs["content"]
    return {"json_ld": ld, "open_graph": og, "twitter_card": tw, "meta_tags": metas}


def microdata(root: Node) -> list[dict]:
    def value(n: Node):
        if n.tag == "meta":
            return n.attrs.get("content", "")
        if n.tag in ("a", "link"):
            return n.attrs.get("href", "")
        if n.tag == "img":
            return n.attrs.get("src", "")
        if n.tag == "time":
            return n.attrs.get("datetime") or n.text()
        return n.attrs.get("content") or n.text()

    def item(n: Node) -> dict:
        out: dict = {"type": n.attrs.get("itemtype", "").rsplit("/", 1)[-1]}
        stack = [c for c in reversed(n.children) if isinstance(c, Node)]
        while stack:
            c = stack.pop()
            nested = "itemscope" in c.attrs
            if "itemprop" in c.attrs:
                v = item(c) if nested else value(c)
                k = c.attrs["itemprop"]
                out[k] = [*(out[k] if isinstance(out[k], list) else [out[k]]), v] if k in out else v
            if not nested:
                stack += [x for x in reversed(c.children) if isinstance(x, Node)]
        return out

    return [item(n) for n in root.walk() if "itemscope" in n.attrs]


def _first(*xs):
    return next((x for x in xs if x not in (None, "", [], {})), None)


def product(root: Node) -> dict | None:
    """Product data merged from JSON-LD, then microdata, then Open Graph; kept with a name or a price."""
    data = structured_data(root)
    things: list = []
    for x in data["json_ld"]:
        things += x if isinstance(x, list) else x.get("@graph", [x]) if isinstance(x, dict) else []
    ld = next((t for t in things if isinstance(t, dict) and "Product" in str(t.get("@type"))), {})
    md = next((m for m in microdata(root) if m.get("type") == "Product"), {})
    og = {k: v[0] for k, v in data["open_graph"].items()}

    def offer(src: dict) -> dict:
        o = src.get("offers") or {}
        return (o[0] if o else {}) if isinstance(o, list) else o if isinstance(o, dict) else {}

    def price(o: dict):
        low, high = o.get("lowPrice"), o.get("highPrice")
        return o.get("price") if o.get("price") is not None else f"{low}-{high}" if low is not None and high is not None else low

    name_of = lambda b: b.get("name") if isinstance(b, dict) else b
    a, b = offer(ld), offer(md)
    rate = _first(ld.get("aggregateRating"), md.get("aggregateRating")) or {}
    images = _first(ld.get("image"), md.get("image"), og.get("image")) or []
    out = {
        "name": _first(ld.get("name"), md.get("name"), og.get("title")), "description": _first(ld.get("description"), md.get("description"), og.get("description")),
        "sku": _first(ld.get("sku"), ld.get("mpn"), ld.get("gtin13"), md.get("sku")), "brand": _first(name_of(ld.get("brand")), name_of(md.get("brand"))),
        "price": _first(price(a), price(b), data["meta_tags"].get("product:price:amount")),
        "currency": _first(a.get("priceCurrency"), b.get("priceCurrency"), data["meta_tags"].get("product:price:currency")),
        "availability": str(_first(a.get("availability"), b.get("availability")) or "").rsplit("/", 1)[-1] or None,
        "images": images if isinstance(images, list) else [images], "rating": rate.get("ratingValue") if isinstance(rate, dict) else None,
        "rating_count": _first(rate.get("reviewCount"), rate.get("ratingCount")) if isinstance(rate, dict) else None,
    }
    out = {k: v if isinstance(v, list) or v is None else str(v) for k, v in out.items()}
    signals = bool(ld or md or og.get("type") == "product" or data["meta_tags"].get("product:price:amount"))
    return out if signals and (out["name"] or out["price"]) else None


PRODUCT = "struct<name:string,description:string,sku:string,brand:string,price:string,currency:string,availability:string,images:array<string>,rating:string,rating_count:string>"


def srcset(value: str) -> list[dict]:
    out = []
    for part in value.split(","):
        bits = part.split()
        if bits:
            out.append({"url": bits[0], "descriptor": bits[1] if len(bits) > 1 else None})
    return out


def apply(df: DataFrame, id_col: str, html_col: str, name: str, kind: str, fn: Callable[[Node], object], arrow: pa.DataType) -> DataFrame:
    """(id, name): ``fn`` of each row's tree; null HTML gives null."""
    key = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if h is None else fn(parse(h)) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, arrow)], names=[id_col, name])

    return df.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {key}, `{name}` {kind}")


def markdown(df: DataFrame, id_col: str, html_col: str, main_only: bool = True, exclude: tuple[str, ...] = ()) -> DataFrame:
    def made(root: Node) -> str:
        at = main_container(root) if main_only else root
        return postprocess(to_markdown(cleaned(at, exclude)))

    return apply(df, id_col, html_col, "markdown", "string", made, pa.string())


TABLE = "array<struct<headers:array<string>,rows:array<array<string>>,caption:string>>"
TABLE_ARROW = pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("caption", pa.string())]))


def tables(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    def found(root: Node) -> list[dict]:
        out = []
        for t in root.walk():
            if t.tag == "table" and data_table(t):
                head, rows = table_rows(t)
                cap = next((n.text() for n in t.walk() if n.tag == "caption"), None)
                out.append({"headers": head, "rows": rows, "caption": cap})
        return out

    return apply(df, id_col, html_col, "tables", TABLE, found, TABLE_ARROW)


def selected(df: DataFrame, id_col: str, html_col: str, selector: str, what: str = "text") -> DataFrame:
    """(id, found array<string>): text or an attribute of the elements that a selector finds; blanks are left out."""

    def found(root: Node) -> list[str]:
        v = [n.text() if what == "text" else n.attrs.get(what, "") for n in select(root, selector)]
        return [x for x in v if x.strip()]

    return apply(df, id_col, html_col, "found", "array<string>", found, pa.list_(pa.string()))


def products(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    fields = [(k, pa.list_(pa.string()) if k == "images" else pa.string()) for k in "name description sku brand price currency availability images rating rating_count".split()]
    return apply(df, id_col, html_col, "product", PRODUCT, product, pa.struct(fields))


def images(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    def found(root: Node) -> list[dict]:
        return [
            {"src": n.attrs.get("src") or n.attrs.get("data-src", ""), "alt": n.attrs.get("alt", ""), "srcset": srcset(n.attrs.get("srcset", ""))}
            for n in root.walk()
            if n.tag == "img" or (n.tag == "source" and "srcset" in n.attrs)
        ]

    arrow = pa.list_(pa.struct([("src", pa.string()), ("alt", pa.string()), ("srcset", pa.list_(pa.struct([("url", pa.string()), ("descriptor", pa.string())])))]))
    return apply(df, id_col, html_col, "images", "array<struct<src:string,alt:string,srcset:array<struct<url:string,descriptor:string>>>>", found, arrow)


def pruned_blocks(df: DataFrame, id_col: str, html_col: str, least: float = 0.48) -> DataFrame:
    """(id, blocks): text blocks by density of text, share of links, element and length, those of a high score."""
    from weftline.operators.cleaning import joined, pruning_score, text_blocks

    def found(root: Node) -> list[dict]:
        scored = [(pos, n, pruning_score(n)) for pos, n in enumerate(text_blocks(root, 2))]
        return [{"pos": pos, "tag": n.tag, "text": joined(n), "score": round(v, 4)} for pos, n, v in scored if v >= least]

    arrow = pa.list_(pa.struct([("pos", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("score", pa.float64())]))
    return apply(df, id_col, html_col, "blocks", "array<struct<pos:int,tag:string,text:string,score:double>>", found, arrow)
