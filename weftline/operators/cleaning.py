"""Cleaning of element trees, links, and the extraction of a whole page in one pass.

Two cleanings: a light one that takes away only what never is content, and the main content of a page, by documentation
framework, by its container, or as the body without its frame. Both work on the tree of ``operators.dom``; their result
goes to HTML or Markdown. Null HTML gives null.
"""

from __future__ import annotations

import hashlib
import html as escaping
import json
import math
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.operators.dom import VOID, Node, data_table, parse, postprocess, product, select, srcset, structured_data, table_rows, to_markdown

#: Elements that never are content, for the main content and for the light cleaning.
JUNK = frozenset("script style iframe svg path meta link video audio canvas object embed source track dialog template select option datalist".split())
LIGHT_JUNK = frozenset("script style svg path meta link canvas object embed source track template datalist iframe dialog select option".split())
#: Selectors of notices, dialogs, players and advertisements.
HARD = [
    ".cookie-banner", ".cookie-popup", "#cookie-consent", ".gdpr-banner", ".cookie-notice", "#cookie-notice", ".consent-banner",
    "[class*='cookie-consent']", "[class*='cookie-banner']", "[class*='cookie-notice']", "[class*='consent-']",
    "[role='dialog']", "[role='alertdialog']", ".modal", ".popup", ".overlay-content", "[class*='-modal']", "[class*='modal-']",
    ".vjs-control-bar", ".vjs-menu", ".vjs-text-track-settings", ".vjs-modal-dialog",
    "[class*='caption-window']", "[class*='caption-settings']", "[class*='player-controls']",
    ".skip-link", ".skip-nav", ".sr-only", ".visually-hidden", ".screen-reader-only", "[class*='skip-to']",
    ".sidebar-ad", "[class*='ad-slot']", "[class*='advertisement']", "[class*='chat-widget']", "[class*='live-chat']", "#hubspot-messages-iframe-container",
]
#: Selectors of menus and prompts around the content.
SOFT = [
    "nav", "[role='navigation']", ".share-buttons", ".social-share", "[class*='social-links']", "[class*='share-bar']", "[class*='share-buttons']",
    "[role='search']", ".announcement-bar", ".promo-bar", ".top-banner", ".alert-bar", "[class*='newsletter']", "[class*='subscribe-form']",
    "[class*='email-signup']", ".back-to-top", "#back-to-top", "[class*='scroll-to-top']", ".breadcrumb", ".breadcrumbs", "[class*='breadcrumb']",
    ".pagination", ".pager", "[class*='pagination']",
]
#: Selectors of what is kept in any case, with what it stands in.
KEPT = ["main", "article", "[role='main']", ".content", "#content", ".post", ".entry", ".product", ".product-detail"]
MAIN_IDS = ("content", "main-content")
MAIN_CLASSES = frozenset("content main-content post entry product product-detail".split())
CONTAINERS = ["main", "article", "[role='main']", "#content", "#main-content", ".main-content"]
#: By which selectors the frameworks of documentation sites are known, tried in this order.
FRAMEWORK_MARKS = {
    "gitbook": ["[class*='gitbook']", ".gitbook-root", ".book-summary"],
    "honkit": [".book.with-summary", ".book-summary", ".book-header .btn-group"],
    "docusaurus": ["#__docusaurus", "[class*='docusaurus']"],
    "mkdocs": [".md-sidebar", ".md-content", "[data-md-component='sidebar']"],
    "readthedocs": [".wy-nav-side", ".rst-content"],
    "sphinx": [".sphinxsidebar", ".sphinxsidebarwrapper"],
    "vuepress": [".theme-default-content", ".theme-container"],
    "vitepress": [".VPSidebar", ".VPDoc", "#VPContent"],
    "nextra": ["[class*='nextra']", ".nextra-sidebar-container"],
    "hugo": [".book-menu", ".book-page"],
    "mdbook": [".sidebar-scrollbox", "#sidebar"],
    "starlight": ["[data-has-sidebar]"],
    "mintlify": ["[class*='mintlify']"],
}
GENERATORS = "sphinx mkdocs hugo docusaurus vuepress vitepress nextra honkit mdbook antora starlight astro mintlify".split()
#: Where those frameworks have their content, and what they have around it.
FRAMEWORK_PARTS = {
    "gitbook": ([".gitbook-root main", ".page-inner .markdown-section", ".page-inner section", ".page-wrapper .page-inner"], [".gitbook-root nav", ".gitbook-root aside", ".book-summary", ".book-header", ".page-footer"]),
    "honkit": ([".book-body .page-inner", ".book-body .markdown-section", ".body-inner .page-inner"], [".book-summary", ".book-header", ".book-footer", ".page-footer", ".navigation"]),
    "docusaurus": ([".theme-doc-markdown", "article[class*='docItemCol']", ".docMainContainer article", "main article"], [".theme-doc-sidebar-container", ".theme-doc-footer", ".pagination-nav", ".docSidebarContainer", "[class*='tableOfContents']"]),
    "mkdocs": ([".md-content article", ".md-content", "[data-md-component='content'] article"], [".md-sidebar", ".md-header", ".md-footer", ".md-tabs", "[data-md-component='sidebar']"]),
    "readthedocs": ([".rst-content", ".wy-nav-content .section", ".document .section"], [".wy-nav-side", ".wy-breadcrumbs", ".wy-nav-top", ".rst-footer-buttons", ".footer"]),
    "sphinx": ([".body", ".document .body", ".documentwrapper .body"], [".sphinxsidebar", ".related", ".footer", ".clearer"]),
    "vuepress": ([".theme-default-content", ".page .content__default", ".page main"], [".sidebar", ".navbar", ".page-edit", ".page-nav"]),
    "vitepress": ([".VPDoc .vp-doc", ".VPContent main", ".vp-doc"], [".VPSidebar", ".VPNav", ".VPFooter", ".VPDocFooter", "[class*='aside']"]),
    "nextra": (["article.nextra-content", "main article", ".nextra-body main article"], [".nextra-sidebar-container", "nav.nextra-sidebar", ".nextra-toc"]),
    "hugo": ([".book-page article", "main article", ".prose", ".markdown"], [".book-menu", ".book-footer", "#TableOfContents"]),
    "mdbook": (["#content main", "#content .content", "main"], ["#sidebar", ".sidebar-scrollbox", "#menu-bar"]),
    "starlight": (["main article", "[data-pagefind-body]", "main [data-has-sidebar] article"], ["aside nav", "header", ".pagination-links"]),
    "mintlify": (["main article", "article.prose"], ["nav", "aside", "footer"]),
}
#: Hosts of social networks, and ends of the hosts that serve sites' own pictures.
SOCIAL = (
    "facebook.com www.facebook.com twitter.com www.twitter.com x.com www.x.com linkedin.com www.linkedin.com instagram.com www.instagram.com "
    "pinterest.com www.pinterest.com tiktok.com www.tiktok.com snapchat.com www.snapchat.com reddit.com www.reddit.com youtube.com www.youtube.com "
    "whatsapp.com www.whatsapp.com t.me discord.gg discord.com"
).split()
PICTURE_HOSTS = (
    "cloudfront.net amazonaws.com akamaihd.net akamaized.net fastly.net cloudinary.com imgix.net shopify.com squarespace-cdn.com wp.com "
    "githubusercontent.com googleusercontent.com ggpht.com twimg.com fbcdn.net pinimg.com media-amazon.com ssl-images-amazon.com scene7.com unsplash.com pexels.com"
).split()
#: Boxes that go if they hold next to nothing, and what saves them.
BOXES = frozenset("div section aside figure figcaption details summary".split())
WORTH = frozenset("img pre code table video audio picture h1 h2 h3 h4 h5 h6".split())
#: Elements whose texts are judged as blocks, those inside which nothing is, and the blocks' weights.
BLOCKS = frozenset("p div section article main li td h1 h2 h3 h4 h5 h6 blockquote pre".split())
NO_BLOCKS = frozenset("nav footer header aside form script style noscript".split())
PRUNING_WEIGHTS = {"article": 1.0, "main": 1.0, "section": 0.8, "p": 0.7, "div": 0.5, "li": 0.6, "td": 0.4}
NOWHERE = ("#", "javascript:", "mailto:", "tel:", "data:")


def joined(n: Node) -> str:
    """The stripped texts of an element, one right after the other."""
    return n.text("")


def drop(nodes: list[Node]) -> None:
    """Take elements out of their tree; those that went with another one before are no matter."""
    gone = {id(n) for n in nodes}
    for up in {id(n.parent): n.parent for n in nodes if n.parent is not None}.values():
        up.children = [c for c in up.children if isinstance(c, str) or id(c) not in gone]


def ancestors(n: Node) -> Iterator[Node]:
    while n.parent is not None and n.parent.tag != "#root":
        n = n.parent
        yield n


def in_main(n: Node) -> bool:
    """Whether an element stands in a container of main content."""
    return any(a.tag in ("main", "article") or a.attrs.get("role") == "main" or a.attrs.get("id") in MAIN_IDS or not MAIN_CLASSES.isdisjoint(a.classes) for a in ancestors(n))


def invisible(n: Node) -> bool:
    """Hidden by its style or attribute, or decoration with hardly any text."""
    style = n.attrs.get("style", "").replace(" ", "")
    return "display:none" in style or "visibility:hidden" in style or "hidden" in n.attrs or (n.attrs.get("aria-hidden") == "true" and len(joined(n)) < 30)


def _find(root: Node, selectors: list[str]) -> list[Node]:
    return select(root, ", ".join(selectors))


def light(root: Node, base: str = "") -> Node:
    """Take away what never is content: junk elements, invisible ones, notices, boxes without words, tracking pixels of
    other hosts (their alternative text stays); links to social networks become their text."""
    drop([n for n in root.walk() if n.tag in LIGHT_JUNK])
    drop([n for n in root.walk() if invisible(n)])
    drop(_find(root, HARD))
    drop([n for n in root.walk() if n.tag in BOXES and not any(x is not n and x.tag in BOXES or x.tag in WORTH for x in n.walk()) and len(joined(n).split()) < 2])
    own = ".".join(urlsplit(base).netloc.split(".")[-2:])
    for n in list(root.walk()):
        kids = []
        for c in n.children:
            if not isinstance(c, str) and c.tag == "img" and base and {c.attrs.get("width"), c.attrs.get("height")} <= {"0", "1"}:
                src = c.attrs.get("src", "").strip()
                host = urlsplit(urljoin(base, src)).netloc
                if src and not src.startswith("data:") and host and not host.endswith((own, *PICTURE_HOSTS)):
                    kids += [c.attrs["alt"].strip()] if c.attrs.get("alt", "").strip() else []
                    continue
            elif not isinstance(c, str) and c.tag == "a" and urlsplit(c.attrs.get("href", "").strip()).netloc.lower() in SOCIAL:
                kids.append(c.text(" ") if any(not isinstance(x, str) for x in c.children) else "".join(c.children))
                continue
            kids.append(c)
        n.children = kids
    return root


def framework(root: Node) -> str | None:
    """The documentation framework that made a page."""
    for name, marks in FRAMEWORK_MARKS.items():
        if _find(root, marks):
            return name
    made = next((n.attrs.get("content", "").lower() for n in select(root, "meta[name='generator']")), "")
    return next((f for f in GENERATORS if f in made), None)


def strip_frame(root: Node) -> Node:
    """Take away junk, menus and prompts outside the main content, invisible elements and short forms."""
    drop([n for n in root.walk() if n.tag in JUNK])
    safe: set[int] = set()
    for n in _find(root, KEPT):
        safe |= {id(n), *(id(a) for a in ancestors(n))}
    drop([n for n in _find(root, HARD + SOFT) if id(n) not in safe and not in_main(n)])
    drop([n for n in root.walk() if invisible(n)])
    drop([n for n in root.walk() if n.tag == "form" and len(joined(n)) < 1000])
    return root


def container(root: Node) -> Node | None:
    """The element that holds the main content of a stripped page."""
    name = framework(root)
    if name in FRAMEWORK_PARTS:
        content, around = FRAMEWORK_PARTS[name]
        drop(_find(root, around))
        for s in content:
            first = next(iter(select(root, s)), None)
            if first is not None and len(joined(first)) > 100:
                return first
    for least, selectors in ((500, CONTAINERS), (100, CONTAINERS[:3])):
        for s in selectors:
            first = next(iter(select(root, s)), None)
            if first is not None and len(joined(first)) > least:
                return first
    return None


def main_content(root: Node) -> Node:
    """The main content: a container's, else the body without its own header, footer and short asides."""
    root = strip_frame(root)
    found = container(root)
    if found is not None:
        return found
    body = next(iter(select(root, "body")), None)
    if body is None:
        return root
    body.children = [c for c in body.children if isinstance(c, str) or not (c.tag in ("header", "footer") or (c.tag == "aside" and len(joined(c)) < 500))]
    return body


def filtered(root: Node, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Node:
    """Without what ``exclude`` selects; of the rest what ``include`` selects, selector by selector, all if that is nothing."""
    for s in exclude:
        drop(select(root, s))
    parts = [n for s in include for n in select(root, s)]
    if parts:
        root = Node("body")
        root.children = parts
    return root


def absolute(root: Node, base: str) -> Node:
    """Addresses made absolute, but those that lead nowhere."""
    for n in root.walk() if base else ():
        for k, skip in (("href", NOWHERE), ("src", ("data:", "javascript:"))):
            v = n.attrs.get(k, "").strip()
            if v and not v.startswith(skip):
                n.attrs[k] = urljoin(base, v)
    return root


def to_html(n: Node) -> str:
    """The tree as HTML."""
    out: list[str] = []
    stack: list = [n]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(escaping.escape(x, quote=False))
        else:
            if x.tag != "#root":
                out.append("<" + x.tag + "".join(f' {k}="{escaping.escape(v)}"' for k, v in x.attrs.items()) + ">")
                if x.tag not in VOID:
                    stack.append((f"</{x.tag}>",))
            stack += reversed(x.children)
    return "".join(out)


def _without_fragment(url: str) -> str:
    """Fragments go, but for those that are routes of an application."""
    at = url.find("#")
    return url if at < 0 or url[at + 1 : at + 2] == "/" or url[at + 1 : at + 3] == "!/" else url[:at]


def all_links(root: Node, base: str) -> list[str]:
    """Where a page leads: anchors, next, previous and canonical links, forms, and data attributes; sorted, each once."""
    found: set[str] = set()
    for n in root.walk():
        a = n.attrs
        if n.tag == "a":
            found.add(a.get("href", ""))
        elif n.tag == "link" and any(r in a.get("rel", "") for r in ("next", "prev", "canonical")):
            found.add(a.get("href", ""))
        elif n.tag == "form":
            found.add(a.get("action", ""))
        found |= {a.get("data-href", ""), a.get("data-url", "")}
    urls = {x.strip() for x in found}
    return sorted(_without_fragment(urljoin(base, x)) for x in urls if x and not x.startswith(NOWHERE[1:]))


def link_details(root: Node, base: str) -> list[dict]:
    """Each anchor with its text, title, marks and whether it stays on the host, in document order."""
    out = []
    host = urlsplit(base).netloc
    for n in root.walk():
        href = n.attrs.get("href", "").strip()
        if n.tag != "a" or "href" not in n.attrs or href.startswith(NOWHERE[:4]):
            continue
        url = urljoin(base, href)
        out.append({
            "url": url.split("#")[0], "text": joined(n) or None, "title": n.attrs.get("title") or None, "nofollow": "nofollow" in n.attrs.get("rel", "").split(),
            "new_tab": n.attrs.get("target") == "_blank", "internal": urlsplit(url).netloc == host,
        })
    return out


def map_links(root: Node, base: str, subdomains: bool = True) -> list[dict]:
    """Links for a site map: on the host or under its last two labels, with text and what stands around it."""
    out = []
    host = urlsplit(base).netloc
    last = lambda h: h.split(".")[-2:]
    for n in root.walk():
        href = n.attrs.get("href", "").strip()
        if n.tag != "a" or "href" not in n.attrs or href.startswith(NOWHERE[:4]):
            continue
        url = urljoin(base, href)
        at = urlsplit(url)
        if at.scheme not in ("http", "https"):
            continue
        near = at.netloc == host if not subdomains else "." not in host or "." not in at.netloc or last(at.netloc) == last(host)
        if near:
            title = joined(n) or None
            around = joined(n.parent) if n.parent is not None else ""
            out.append({"url": _without_fragment(url), "title": title, "description": around if around and around != title and len(around) < 200 else None})
    return out


def page_query(root: Node) -> str:
    """What a page says it is about: title, first headline and description."""
    parts = [joined(n) for s in ("title", "h1") for n in select(root, s)[:1]]
    parts += [n.attrs.get("content", "") for n in select(root, "meta[name='description']")[:1]]
    return " ".join(parts)


def text_blocks(root: Node, least: int = 5) -> list[Node]:
    """Elements whose text is judged: of ``least`` words or more, outside menus and the like. Containers come with
    their parts."""
    return [n for n in root.walk() if n.tag in BLOCKS and not any(a.tag in NO_BLOCKS for a in ancestors(n)) and len(joined(n).split()) >= least]


def pruning_score(n: Node) -> float:
    """How much an element is text and not markup or links, with its weight and length."""
    text = joined(n)
    link = sum(len(a.text("")) for a in n.walk() if a.tag == "a")
    size = max(1, len(text))
    return 0.4 * len(text) / max(1, len(to_html(n))) + 0.2 * (1 - link / size) + 0.2 * PRUNING_WEIGHTS.get(n.tag, 0.5) + 0.2 * min(1.0, math.log(size) / 10)


def fit_blocks(root: Node, least: float = 0.48) -> list[Node]:
    """Blocks of a high score; the page itself where there are none."""
    kept = [n for n in text_blocks(root, 2) if pruning_score(n) >= least]
    return kept or [root]


def fit_markdown(root: Node) -> str:
    whole = Node("div")
    whole.children = list(fit_blocks(root))
    return postprocess(to_markdown(whole))


def light_markdown(source: str, base: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), main_only: bool = False) -> tuple[str, str]:
    """(HTML, Markdown) of a cleaned page."""
    root = parse(source)
    root = absolute(main_content(root) if main_only else light(root, base), base)
    root = filtered(root, include, exclude)
    return to_html(root), postprocess(to_markdown(root))


def xpath(root: Node, path: str) -> list[str]:
    """Texts or attribute values that an XPath finds: steps by ``/`` and ``//``, names or ``*``, conditions on attributes,
    ``contains``, positions, and ``text()`` or ``@name`` at the end. Stripped, blanks left out; a path that isn't understood finds
    nothing."""
    steps = re.findall(r"(//?)([^/\[]+)((?:\[[^\]]*\])*)", path)
    if not steps or "".join(a + b + c for a, b, c in steps) != path:
        return []
    at, last = [root], None
    for k, (axis, name, tests) in enumerate(steps):
        if name == "text()" or name[0] == "@":
            if k != len(steps) - 1:
                return []
            last = name
            if axis == "//":
                at = [x for n in at for x in n.walk()]
            break
        found: list[Node] = []
        for n in at:
            pool = [x for x in n.walk() if x is not n] if axis == "//" else [c for c in n.children if isinstance(c, Node)]
            pool = [x for x in pool if name in ("*", x.tag)]
            for t in re.findall(r"\[([^\]]*)\]", tests):
                if t.isdigit():
                    order: dict[int, int] = {}
                    kept = []
                    for x in pool:  # positions count among the children of one parent
                        order[id(x.parent)] = order.get(id(x.parent), 0) + 1
                        if order[id(x.parent)] == int(t):
                            kept.append(x)
                    pool = kept
                elif m := re.fullmatch(r"@([\w-]+)(?:\s*=\s*[\"']([^\"']*)[\"'])?", t):
                    pool = [x for x in pool if m[1] in x.attrs and (m[2] is None or x.attrs[m[1]] == m[2])]
                elif m := re.fullmatch(r"contains\(\s*@([\w-]+)\s*,\s*[\"']([^\"']*)[\"']\s*\)", t):
                    pool = [x for x in pool if m[2] in x.attrs.get(m[1], "")]
                else:
                    return []
            found += pool
        at = list({id(x): x for x in found}.values())
    if last is None:
        out = [x.text("") for x in at]
    elif last == "text()":
        out = [c for x in at for c in x.children if isinstance(c, str)]
    else:
        out = [x.attrs[last[1:]] for x in at if last[1:] in x.attrs]
    return [x.strip() for x in out if x.strip()]


def named(root: Node, selectors: dict[str, str]) -> dict[str, list[str]]:
    """What each named selector finds: CSS, or XPath where it begins with a slash; ``@name`` after a CSS selector takes an
    attribute."""
    out = {}
    for name, s in selectors.items():
        if s.startswith("/"):
            out[name] = xpath(root, s)
        else:
            css, _, attr = s.partition("@")
            out[name] = [v for n in select(root, css) for v in [n.attrs.get(attr, "") if attr else joined(n)] if v.strip()]
    return out


def metadata(root: Node, source: str) -> dict:
    """Title, description, language, picture, canonical address, icon, robots, and sizes of a page."""
    one = lambda s, a: next((n.attrs[a] for n in select(root, s) if n.attrs.get(a)), None)
    titles = [joined(n) for n in select(root, "title")]
    words = len(root.text(" ").split())
    return {
        "title": (titles or [None])[0] or one("meta[property='og:title']", "content"),
        "description": one("meta[name='description']", "content") or one("meta[property='og:description']", "content"),
        "language": one("html", "lang"), "og_image": one("meta[property='og:image']", "content"), "canonical_url": one("link[rel='canonical']", "href"),
        "favicon": one("link[rel~='icon']", "href"), "robots": one("meta[name='robots']", "content"), "word_count": words,
        "reading_time_seconds": -(-words // 200) * 60, "content_length": len(source),
    }


LINK_T = pa.struct([("url", pa.string()), ("text", pa.string()), ("title", pa.string()), ("nofollow", pa.bool_()), ("new_tab", pa.bool_()), ("internal", pa.bool_())])
MAP_T = pa.struct([("url", pa.string()), ("title", pa.string()), ("description", pa.string())])
META_T = pa.struct(
    [(k, pa.string()) for k in "title description language og_image canonical_url favicon robots".split()]
    + [("word_count", pa.int32()), ("reading_time_seconds", pa.int32()), ("content_length", pa.int32())]
)
HEAD_T = pa.struct([("level", pa.int32()), ("text", pa.string()), ("id", pa.string())])
IMAGE_T = pa.struct([(k, pa.string()) for k in "src alt width height loading".split()] + [("srcset", pa.list_(pa.struct([("url", pa.string()), ("descriptor", pa.string())])))])
TABLE_T = pa.struct([("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])
PAGE_T = {
    "markdown": pa.string(), "html": pa.string(), "fit_markdown": pa.string(), "content_hash": pa.string(), "links": pa.list_(pa.string()), "links_detail": pa.list_(LINK_T),
    "headings": pa.list_(HEAD_T), "images": pa.list_(IMAGE_T), "tables": pa.list_(TABLE_T), "structured_data": pa.string(), "product_data": pa.string(), "metadata": META_T,
}


def _page(source: str, base: str, formats: frozenset[str]) -> dict:
    """The parts of a page that are asked for; the tree is built again only where cleaning would change it."""
    out: dict = {}
    tree = parse(source) if formats - {"markdown", "html", "content_hash"} else None
    if "metadata" in formats:
        out["metadata"] = metadata(tree, source)
    if "links" in formats:
        out["links"] = all_links(tree, base)
    if "links_detail" in formats:
        out["links_detail"] = link_details(tree, base)
    if "headings" in formats:
        out["headings"] = [{"level": int(n.tag[1]), "text": joined(n), "id": n.attrs.get("id")} for n in tree.walk() if re.fullmatch("h[1-6]", n.tag) and joined(n)]
    if "images" in formats:
        out["images"] = [
            {"src": urljoin(base, src), **{k: n.attrs.get(k) for k in ("alt", "width", "height", "loading")}, "srcset": srcset(n.attrs.get("srcset", ""))}
            for n in tree.walk() if n.tag == "img" for src in [n.attrs.get("src") or n.attrs.get("data-src", "")] if src
        ]
    if "tables" in formats:
        out["tables"] = [dict(zip(("headers", "rows"), table_rows(t))) for t in tree.walk() if t.tag == "table" and data_table(t)]
    if "structured_data" in formats:
        out["structured_data"] = json.dumps(structured_data(tree), ensure_ascii=False, sort_keys=True)
    if "product_data" in formats:
        made = product(tree)
        out["product_data"] = json.dumps(made, ensure_ascii=False) if made else None
    if "fit_markdown" in formats:
        out["fit_markdown"] = fit_markdown(tree)
    if formats & {"markdown", "html", "content_hash"}:
        out["html"], md = light_markdown(source, base)
        out["markdown"] = md
        out["content_hash"] = hashlib.md5(" ".join(md.split()).lower().encode()).hexdigest()
    return {k: v for k, v in out.items() if k in formats}


def pages(df: DataFrame, id_col: str, url_col: str, html_col: str, formats: tuple[str, ...]) -> DataFrame:
    """(id, one column for each format): one pass over each page's source."""
    want = frozenset(formats)
    kinds = {k: PAGE_T[k] for k in formats}
    key = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if h is None else _page(h, u or "", want) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m and m[k] for m in made], t) for k, t in kinds.items())], names=[id_col, *kinds])

    from pyspark.sql.pandas.types import from_arrow_type

    shape = ", ".join(f"`{k}` {from_arrow_type(t).simpleString()}" for k, t in kinds.items())
    return df.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {key}, {shape}")


def per_page(df: DataFrame, id_col: str, url_col: str, html_col: str, name: str, fn, kind: pa.DataType) -> DataFrame:
    """(id, name): ``fn(tree, url)`` of each page with source."""
    from pyspark.sql.pandas.types import from_arrow_type

    key = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if h is None else fn(parse(h), u or "") for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, kind)], names=[id_col, name])

    return df.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {key}, `{name}` {from_arrow_type(kind).simpleString()}")
