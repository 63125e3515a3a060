"""Problem 3: the main body of a page, by inference in a tree-structured graphical model.

Where a row has HTML its DOM is the tree: block elements are nodes, the first child hangs at its parent and a younger
sibling at the elder, so that the order of the page counts too, and every line of the Markdown hangs below the element
that holds its text (a line of several cells or links below their common element, a line of none below its predecessor's). Where a row has no HTML the Markdown makes the tree: blocks (runs of
non-blank lines) hang one below the other, each at its first line, and the other lines of a block hang at that first
line. A line is one of five states: before the main body, its headline, main body, furniture inside it, after it; an
element may also be mixed. Node potentials come from hashed features: of a line its words, shape, links, and whether the
host repeats it on pages of other headlines; of an element its tag, names, size, link density and place. Messages pass
upward to the root and downward again (sum-product), which gives each line its probability of being main body.

Training takes labelled pages: pages whose HTML marks its parts by sectioning elements (main, article against header,
nav, aside, footer) and boxes named as furniture. Their lines get the label of the element that holds the same text,
elements the label that all their lines share, else mixed; node potentials are fitted by stochastic gradient descent, edge
potentials by counting. Each page trains elements twice, once without sectioning tags and names, so that pages that have
none are read by structure. At most ``sample`` pages, the lowest by hash of their id, are used for fitting; every page is
tagged, and every line is read whole.

Defined results: null text gives no row; blank lines are neither (probability null) and never found; empty
text gives an empty list; null, empty or broken HTML falls back to the lines' own tree; a page with no labelled pages in
its table is tagged by the shape features' prior weights; ties (a probability of exactly one half) count as main body;
repeated rows are tagged alike.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.hosts import host
from weftline.session import broadcastable, cut, salted

BITS = 15
PRE, BODY, INNER, POST, TITLE = range(STATES := 5)
MIXED = STATES  # of elements only
#: Emission model of the furniture states: this share of each is that of furniture in general, as a line of a kind
#: seen before the body in training may stand behind it elsewhere.
SHARED = 0.3
LINK = re.compile(r"!?\[([^\]]*)\]\(([^)]*)\)")
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
LIST = re.compile(r"(?:[-+*•]|\d{1,3}[.)])\s+")
NUMBER = re.compile(r"\d")
LONG = 260
CACHE = 100_000


LETTERS = re.compile(r"[\W\d_]+")
_NO_LETTERS = bytes(k for k in range(128) if not 97 <= k <= 122)


def letters(text: str) -> bytes:
    """A text without the ASCII characters that aren't letters, lower-cased: what is compared of two texts."""
    return text.lower().encode("utf-8", "replace").translate(None, _NO_LETTERS)


def key_of(text: str) -> int:
    """Hash of a line's letters, as Spark's ``xxhash64`` gives it."""
    h = xxhash.xxh64_intdigest(letters(text) if text.isascii() else LETTERS.sub("", text.lower()).encode("utf-8", "replace"), seed=42)
    return h - (1 << 64) if h >> 63 else h


class _Bucket(dict):
    """Feature numbers of names, kept as they occur again and again."""

    def __missing__(self, name: str) -> int:
        if len(self) > 4 * CACHE:
            self.clear()
        v = self[name] = zlib.crc32(name.encode("utf-8", "replace")) & ((1 << BITS) - 1)
        return v


_buckets = _Bucket()


def _bucket(n: int) -> int:
    return n if n < 4 else 4 + min(5, (n - 4).bit_length())


def features(line: str, words_too: bool = True) -> list[int]:
    """Hashed feature numbers of a line, code and position left out."""
    s = line.strip()
    out: list[str] = []
    bare = s.strip("*_~ ")
    out.append("bold" if bare != s and s[:2] in ("**", "__") else "plain")
    if bare[:1] == "#":
        out.append(f"h{len(bare) - len(bare.lstrip('#'))}")
        bare = bare.lstrip("# ")
    elif bare[:1] == ">":
        out.append("quote")
        bare = bare.lstrip("> ")
    elif bare[:1] == "|":
        out.append("row")
    elif bare[:1] in "=-" and not bare.strip("=- "):
        out.append("rule")
    m = LIST.match(bare)
    if m:
        out.append("item")
        bare = bare[m.end() :]
    links = LINK.findall(bare) if "](" in bare else ()
    text = LINK.sub(r"\1", bare) if links else bare
    if links:
        inside = sum(len(t) for t, _ in links)
        out.append(f"links{_bucket(len(links))}")
        out.append(f"linked{4 * inside // max(1, len(text))}")
        for target in {t for _, t in links}:
            out.append("to:" + ("anchor" if target[:1] == "#" else "path" if target[:1] == "/" else "full"))
            out.append(f"to:{target.count('/')}" + ("0" if target[-1:].isdigit() else "a"))
        out = list(dict.fromkeys(out))
    size = len(text)
    end = text[-1:]
    out.append("end" + (end if not end.isalnum() else "9" if end.isdigit() else "a"))
    if "\t" in text or "   " in text:
        out.append("columns")
    if size > LONG:
        out.append("long")
        if not words_too:
            return list(map(_buckets.__getitem__, out))
        words = text.lower().split()
        out += {w.rstrip(".,;:!?") for w in words}
        words = [TOKEN.search(w)[0] if TOKEN.search(w) else w for w in words[:2]]  # a short line's tokens
        out += [words[0], words[0] + " " + words[1] if len(words) > 1 else ""]
    else:
        words = TOKEN.findall(text.lower())
        out.append(f"n{_bucket(len(words))}")
        if text.isupper():
            out.append("upper")
        for c in "·|/>,@©":
            k = text.count(c)
            if k:
                out.append(f"{c}{min(k, 4)}")
        if NUMBER.search(text):
            out.append("digit")
        if not words_too:
            return list(map(_buckets.__getitem__, out))
        words = ["0" if w.isdigit() else w for w in words]
        out += words
        out += [a + " " + b for a, b in zip(words, words[1:])]
    if words:
        out.append("<" + words[0])
        out.append(words[-1] + ">")
    return list(map(_buckets.__getitem__, out))


class Page:
    """Non-blank lines of a Markdown text with block structure, and where there is HTML the element of each line."""

    __slots__ = ("lines", "numbers", "head", "code", "total", "tree", "node")

    def __init__(self, text: str, source: str | None = None):
        self.lines: list[str] = []
        self.numbers: list[int] = []
        self.head: list[bool] = []
        self.code: list[bool] = []
        new, fenced = True, False
        all_lines = text.split("\n")
        self.total = len(all_lines)
        for k, line in enumerate(all_lines, 1):
            if not line or line.isspace():
                new = True
                continue
            fence = line.lstrip(" >")[:3] in ("```", "~~~")
            self.lines.append(line)
            self.numbers.append(k)
            self.head.append(new)
            self.code.append(fence or fenced)
            fenced ^= fence
            new = False
        if fenced:  # an open fence is no code block
            self.code = [False] * len(self.code)
        self.tree = self.node = None
        if source and self.lines:
            tree = Tree(source)
            if tree.chunks:
                self.tree, self.node = tree, tree.place(self.lines)


BLOCKS = "body|p|li|h[1-6]|tr|div|ul|ol|dl|dt|dd|table|header|footer|nav|aside|main|article|section|blockquote|pre|form|figure|details"
#: Cuts an HTML text into texts and, between them, (end mark, block tag, attributes); comments, scripts, styles and line breaks cut too.
BLOCK = re.compile(rf"<(?:(/?)({BLOCKS})(?![a-zA-Z0-9])([^>]*)|br\b[^>]*|!--.*?--|(?:script\b.*?</script|style\b.*?</style)[^>]*)>", re.S | re.I)
INLINE = re.compile(r"<[a-zA-Z/!][^>]*>")
ANCHOR = re.compile(r"<a\b[^>]*>(.*?)(?:</a|$)", re.S | re.I)
SECTIONING = frozenset("main article header footer nav aside section".split())
FURNITURE = frozenset("header footer nav aside".split())
CLOSED_BY_NEXT = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "p"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
NAME = re.compile(r"\b(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
#: Parts of class and id names by which pages commonly mark what isn't their content.
FURNITURE_NAMES = frozenset(
    "ad ads advert banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer gdpr header masthead menu nav newsletter "
    "pager pagination popup promo related share sharing sidebar skyscraper social sponsor sponsored subscribe toolbar".split()
)
SEPARATOR = re.compile(r"[·>/|•,]|\]\([^)]*\)|  +|\t")


def names_of(attributes: str) -> list[str]:
    """Parts of an element's class, id and role."""
    return [x for m in NAME.findall(attributes) for x in re.split(r"[^a-z0-9]+", m.lower()) if x] if "=" in attributes else []


class Tree:
    """Block elements of an HTML text. ``chunks`` are (element, letters) of the texts between block tags; ``marks``
    says of each element whether it stands in the main part (None where nothing says so)."""

    __slots__ = ("parent", "tag", "names", "depth", "size", "linked", "kids", "first", "last", "chunks", "heading")

    def __init__(self, source: str):
        self.parent, self.tag, self.names, self.depth = [-1], ["body"], [[]], [0]
        self.size, self.linked, self.kids = [0], [0], [0]
        self.chunks: list[tuple[int, bytes]] = []
        self.first, self.last = [0], [0]  # chunks before the element, and before its end
        self.heading: int | None = None  # chunks before the first h1
        stack = [0]
        tag, size, linked, chunks = self.tag, self.size, self.linked, self.chunks
        parts = BLOCK.split(source[max(0, source.find("<body")) :])
        for k in range(0, len(parts), 4):
            text = parts[k]
            if text and not text.isspace():
                n = stack[-1]
                if "<" in text:
                    if "<a" in text or "<A" in text:
                        linked[n] += sum(len(INLINE.sub("", x)) for x in ANCHOR.findall(text))
                    text = INLINE.sub("", text)
                if "&" in text:
                    text = html_lib.unescape(text)
                for x in text.split("\n") if tag[n] == "pre" else (text,):
                    key = letters(x)
                    if key:
                        chunks.append((n, key))
                size[n] += len(text)
            if k + 1 == len(parts) or not parts[k + 2]:
                continue
            name = parts[k + 2].lower()
            if name == "body":
                continue
            if parts[k + 1]:
                for j in range(len(stack) - 1, 0, -1):
                    if tag[stack[j]] == name:
                        for n in stack[j:]:
                            self.last[n] = len(chunks)
                        del stack[j:]
                        break
            else:
                closed = CLOSED_BY_NEXT.get(name)
                while closed and len(stack) > 1 and tag[stack[-1]] in closed:
                    self.last[stack.pop()] = len(chunks)
                up, n = stack[-1], len(tag)
                self.parent.append(up)
                tag.append(name)
                self.names.append(names_of(parts[k + 3]))
                self.depth.append(self.depth[up] + 1)
                size.append(0)
                linked.append(0)
                self.kids.append(0)
                self.kids[up] += 1
                self.first.append(len(chunks))
                self.last.append(len(chunks))
                stack.append(n)
                if name == "h1" and self.heading is None:
                    self.heading = len(chunks)
        for n in stack:
            self.last[n] = len(self.chunks)
        for n in range(len(self.tag) - 1, 0, -1):
            up = self.parent[n]
            self.size[up] += self.size[n]
            self.linked[up] += self.linked[n]
            if self.kids[n] and self.tag[n] == "tr":  # a table that lays out blocks isn't one of data
                while self.tag[n] in ("tr", "table"):
                    self.tag[n], n = "div", self.parent[n]

    def place(self, lines: list[str]) -> list[int]:
        """The element of each line: the one with the same text, else the common one of its parts, else the last line's."""
        at: dict[bytes, list[int]] = {}
        for k, (_, key) in enumerate(self.chunks):
            at.setdefault(key, []).append(k)

        def find(key: bytes) -> int | None:
            """The chunk of the text: the next one in the order of the page, else an earlier one."""
            hits = at.get(key)
            if hits is None:
                return None
            return hits[min(bisect_left(hits, cursor), len(hits) - 1)]

        out, node, cursor = [], 0, 0
        for line in lines:
            key = letters(LINK.sub(r"\1", line) if "](" in line else line)
            if key:
                k = find(key)
                if k is not None:
                    node, cursor = self.chunks[k][0], k + 1
                else:
                    parts = [k for k in (find(letters(y)) for y in SEPARATOR.split(line)) if k is not None]
                    if parts:
                        node, cursor = self.common(self.chunks[parts[0]][0], self.chunks[parts[-1]][0]), parts[-1] + 1
            out.append(node)
        return out

    def common(self, a: int, b: int) -> int:
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
        return a

    def look(self, n: int, plain: bool) -> tuple:
        """What the features of an element are made of. ``plain`` is the form for pages without sectioning elements:
        neither these nor names count, and nothing is taken over from the form for pages with them."""
        tag = self.tag[n]
        head = ("div" if tag in SECTIONING else tag, "") if plain else (tag, self.tag[self.parent[n]] if n else "", *self.names[n])
        if not self.kids[n]:  # of an element without others inside, its lines say it
            return plain, head, ()
        place = 0 if self.heading is None else 1 if self.last[n] <= self.heading else 2 if self.first[n] > self.heading else 3
        size, texts = self.size[n], max(1, self.last[n] - self.first[n])
        return plain, head, (place, _bucket(self.kids[n]), min(12, size.bit_length()), 4 * self.linked[n] // max(1, size), min(9, (size // texts).bit_length()), min(6, texts.bit_length()))

    def marks(self) -> list[bool | None]:
        """Whether each element is in the main part, by the nearest element that says so."""
        out: list[bool | None] = []
        for n, tag in enumerate(self.tag):
            own = False if tag in FURNITURE or not FURNITURE_NAMES.isdisjoint(self.names[n]) else True if tag in ("main", "article") else None
            out.append(own if own is not None or not n else out[self.parent[n]])
        return out


class Scores:
    """Sums of weights of things seen before, kept in one matrix."""

    def __init__(self, weights: np.ndarray | None, features_of) -> None:
        self.w, self.features_of = weights, features_of
        self.at: dict = {}
        self.rows = np.empty((0, 0 if weights is None else weights.shape[1]), np.float32)

    def of(self, things: list) -> np.ndarray:
        at = self.at
        new = [x for x in dict.fromkeys(things) if x not in at]
        if len(at) + len(new) > CACHE:
            at.clear()
            self.rows = self.rows[:0]
            new = list(dict.fromkeys(things))
        if new:
            lists = [self.features_of(x) for x in new]
            flat = np.fromiter(chain.from_iterable(lists), np.int64)
            starts = np.cumsum([0, *map(len, lists[:-1])])
            at.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, np.add.reduceat(self.w[flat], starts, axis=0)])
        return self.rows[[at[x] for x in things]]


def emissions(z: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log likelihoods of nodes by state, from log class probabilities and priors."""
    like = np.exp(np.maximum(z, FLOOR) - prior)
    kinds = [PRE, INNER, POST]
    p = np.exp(prior[kinds])
    like[:, kinds] = (1 - SHARED) * like[:, kinds] + SHARED * (like[:, kinds] @ (p / p.sum()))[:, None]
    return np.log(like)


def element_features(look: tuple) -> list[int]:
    """Hashed feature numbers of an element."""
    plain, (tag, up, *names), box = look
    out = ["t:" + tag, "u:" + up, *("c:" + x for x in names)]
    if box:
        out += [f"{a}:{x}" for a, x in zip("hkslmn", box)] + [f"hm:{box[0]} {box[4]}"]
    return [_buckets[("p" if plain else "e") + x] for x in out]


class Model:
    """Potentials: of lines (``w``, ``prior``), of elements (``v``, ``v_prior``), of edges between blocks and inside
    them, between elements (``edges``: first children, next siblings without and with elements inside) and from element to
    line (``leaf``), and of the first and last node."""

    def __init__(self, w, prior, start, between, within, stop, v=None, v_prior=None, root=None, edges=None, leaf=None):
        self.w, self.prior, self.start, self.between, self.within, self.stop = w, prior, start, between, within, stop
        self.v, self.v_prior, self.root, self.edges, self.leaf = v, v_prior, root, edges, leaf
        self.lines, self.looks = Scores(w, features), Scores(v, element_features)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("lines", "looks")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.lines, self.looks = Scores(self.w, features), Scores(self.v, element_features)

    def logits(self, pages: list[Page], repeated: list[frozenset]) -> np.ndarray:
        """Node potentials of lines: log of the class probabilities over the class priors."""
        out = self.lines.of([line for p in pages for line in p.lines])
        at: list[int] = []
        which: list[int] = []
        k = 0
        for page, rep in zip(pages, repeated):
            for n, x in extras(page, rep):
                at.append(k + n)
                which.append(x)
            k += len(page.lines)
        np.add.at(out, at, self.w[which])
        out -= out.max(axis=1, keepdims=True)
        out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
        return emissions(out, self.prior)

    def marginals(self, pages: list[Page], repeated: list[frozenset]) -> list[np.ndarray]:
        """For each page the probabilities (lines, states), by one upward and one downward pass over all trees."""
        sizes = [len(p.lines) for p in pages]
        if not sum(sizes):
            return [np.zeros((0, STATES)) for _ in pages]
        e = np.split(np.exp(self.logits(pages, repeated)), np.cumsum(sizes)[:-1])
        out: list[np.ndarray] = [np.zeros((0, STATES))] * len(pages)
        for infer, mine in ((self._elements, [k for k, p in enumerate(pages) if sizes[k] and p.tree and self.v is not None]), (self._blocks, [k for k, p in enumerate(pages) if sizes[k] and not (p.tree and self.v is not None)])):
            if mine:
                got = infer([pages[k] for k in mine], np.concatenate([e[k] for k in mine]))
                for k, x in zip(mine, np.split(got, np.cumsum([sizes[k] for k in mine])[:-1])):
                    out[k] = x
        return out

    def _along(self, b: np.ndarray, which: np.ndarray, up: bool) -> np.ndarray:
        """Messages along the edges of elements, each by its own table."""
        out = np.empty_like(b)
        for k, table in enumerate(self.edges):
            at = which == k
            out[at] = b[at] @ (table.T if up else table)
        return out

    def _elements(self, pages: list[Page], e: np.ndarray) -> np.ndarray:
        """Marginals of lines that hang in the trees of their elements; elements without lines below are left out."""
        rows: list[tuple] = []
        parent: list[int] = []
        sibling: list[int] = []  # which table: of first children, of next siblings without and with elements inside
        depth: list[int] = []
        of_line: list[int] = []
        for p in pages:
            number: dict[int, int] = {}
            younger: dict[int, int] = {}
            keep = set()
            plain = SECTIONING.isdisjoint(p.tree.tag)
            for n in set(p.node):
                while n >= 0 and n not in keep:
                    keep.add(n)
                    n = p.tree.parent[n]
            for n in sorted(keep):  # parents come before their children
                number[n] = k = len(rows)
                rows.append(p.tree.look(n, plain))
                up = number[p.tree.parent[n]] if n else -1
                parent.append(younger.get(up, up))
                sibling.append((1 + (p.tree.kids[n] > 0)) if up in younger else 0)
                depth.append(depth[parent[-1]] + 1 if n else 0)
                younger[up] = k
            of_line += [number[n] for n in p.node]
        z = self.looks.of(rows)
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        own = emissions(z, self.v_prior)
        parent_, depth_, of, beside = np.array(parent), np.array(depth), np.array(of_line), np.array(sibling)
        up_line = e @ self.leaf.T
        up_line /= up_line.max(axis=1, keepdims=True)
        acc = own.astype(np.float64)
        np.add.at(acc, of, np.log(up_line))
        levels = [np.flatnonzero(depth_ == d) for d in range(depth_.max() + 1)]
        up = np.ones_like(acc)
        for at in levels[:0:-1]:
            b = np.exp(acc[at] - acc[at].max(axis=1, keepdims=True))
            m = self._along(b, beside[at], True)
            up[at] = m / m.max(axis=1, keepdims=True)
            np.add.at(acc, parent_[at], np.log(np.maximum(up[at], 1e-30)))
        belief = np.exp(acc - acc.max(axis=1, keepdims=True))
        belief[levels[0]] *= self.root
        belief[levels[0]] /= belief[levels[0]].sum(axis=1, keepdims=True)
        for at in levels[1:]:
            rest = belief[parent_[at]] / np.maximum(up[at], 1e-30)
            b = belief[at] * self._along(rest, beside[at], False)
            belief[at] = b / b.sum(axis=1, keepdims=True)
        out = e * ((belief[of] / np.maximum(up_line, 1e-30)) @ self.leaf)
        return out / out.sum(axis=1, keepdims=True)

    def _blocks(self, pages: list[Page], e: np.ndarray) -> np.ndarray:
        """Marginals of lines whose blocks hang one below the other."""
        sizes = [len(p.lines) for p in pages]
        head = np.concatenate([np.array(p.head, bool) for p in pages])
        block = np.cumsum(head) - 1
        heads = np.flatnonzero(head)
        page_of = np.repeat(np.arange(len(pages)), sizes)
        # Upward inside blocks: the message of each inner line to its block's first line.
        up = e @ self.within.T
        up /= up.max(axis=1, keepdims=True)
        inner = np.flatnonzero(~head)
        gather = np.zeros((len(heads), STATES))
        np.add.at(gather, block[inner], np.log(up[inner]))
        gather -= gather.max(axis=1, keepdims=True)
        local = e[heads] * np.exp(np.maximum(gather, -60))
        local /= local.max(axis=1, keepdims=True)
        # Between blocks: page by page the same step at once.
        counts = np.bincount(page_of[heads], minlength=len(pages))
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        steps = counts.max()
        beta = np.ones((len(heads), STATES))
        for t in range(steps - 1, -1, -1):
            at = first[counts > t] + t
            last = counts[counts > t] == t + 1
            beta[at[last]] = self.stop
            on = at[~last]
            b = (local[on + 1] * beta[on + 1]) @ self.between.T
            beta[on] = b / b.max(axis=1, keepdims=True)
        alpha = np.ones((len(heads), STATES))
        for t in range(steps):
            at = first[counts > t] + t
            a = np.tile(self.start, (len(at), 1)) if t == 0 else (alpha[at - 1] * local[at - 1]) @ self.between
            alpha[at] = a / a.max(axis=1, keepdims=True)
        belief = alpha * local * beta
        belief /= belief.sum(axis=1, keepdims=True)
        out = np.empty((len(e), STATES))
        out[heads] = belief
        rest = belief[block[inner]] / np.maximum(up[inner], 1e-12)
        down = e[inner] * (rest @ self.within)
        out[inner] = down / down.sum(axis=1, keepdims=True)
        return out


#: Least log of a node's class probability, so that one node can't outvote its whole page.
FLOOR = -6.0
#: Features beside the line's own: repeated by the host, in code, first line of the page, first heading.
EXTRA = {"rep": (1 << BITS), "code": (1 << BITS) + 1, "first": (1 << BITS) + 2, "title": (1 << BITS) + 3}
SIZE = (1 << BITS) + 4


def extras(page: Page, rep: frozenset) -> list[tuple[int, int]]:
    """(line, feature) of the features beside the lines' own."""
    lines = page.lines
    out = [(0, EXTRA["first"])] if lines else []
    out += [(n, EXTRA["code"]) for n, v in enumerate(page.code) if v]
    title = next((n for n, x in enumerate(lines) if x[:2] == "# " or (x[:3] == "===" and n)), None)
    if title is not None:
        out.append((title - (lines[title][:3] == "==="), EXTRA["title"]))
    if rep:
        out += [(n, EXTRA["rep"]) for n, x in enumerate(lines) if len(x) > 20 and "](" not in x and key_of(x) in rep]
    return out


def label(page: Page, source: str) -> np.ndarray | None:
    """States of a page's lines by its HTML; -1 where the line is in neither part. None if there's no main part."""
    tree = page.tree or Tree(source)
    marks = tree.marks()
    body = {key for n, key in tree.chunks if marks[n]}
    other = {key for n, key in tree.chunks if marks[n] is False}
    if not body:
        return None
    y = np.full(len(page.lines), -1)
    for k, line in enumerate(page.lines):
        links = LINK.findall(line) if "](" in line else ()
        key = letters(LINK.sub(r"\1", line))
        if not key:
            y[k] = y[k - 1] if k and line.strip()[:1] in "=-|`" else -1
            if line.strip()[:2] == "|-":
                y[k] = BODY
        elif key in body:
            y[k] = BODY
        elif key in other or (links and all(letters(t) in other for t, _ in links)):
            y[k] = POST
        elif line.lstrip()[:1] == "|" and all(letters(c) in body for c in line.split("|") if letters(c)):
            y[k] = BODY
        elif page.code[k]:
            y[k] = BODY
        else:
            words = [letters(x) for x in re.split(r"[·>/|]|  +", LINK.sub(r"\1", line))]
            if len(words) > 1 and all(x in other or x in body for x in words if x):
                y[k] = POST
    main = np.flatnonzero(y == BODY)
    if not len(main):
        return None
    at = np.arange(len(y))
    y = np.where((y == POST) & (at < main[0]), PRE, y)
    y = np.where((y == POST) & (at > main[0]) & (at < main[-1]), INNER, y)
    first = page.lines[main[0]]
    under = main[0] + 1 < len(y) and page.lines[main[0] + 1][:3] == "==="
    if first[:2] == "# " or under:
        y[main[0] : main[0] + 1 + under] = TITLE
    return y


def element_labels(page: Page, y: np.ndarray) -> dict[int, int]:
    """States of the elements with labelled lines: the one of all their lines, else mixed."""
    seen: dict[int, set[int]] = {}
    for n, v in zip(page.node, y.tolist()):
        while v >= 0 and n >= 0:
            seen.setdefault(n, set()).add(v)
            n = page.tree.parent[n]
    out = {}
    for n, s in seen.items():
        if len(s) > 1 and TITLE in s:
            s = (s - {TITLE}) | {BODY}
        out[n] = next(iter(s)) if len(s) == 1 else MIXED
    return out


def _softmax(rows: list[list[int]], labels: list[int], size: int, classes: int, epochs: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Weights (size, classes) by stochastic gradient descent over rows of feature numbers."""
    w = np.zeros((size + 1, classes))
    n_features = np.array([len(r) for r in rows])
    flat_all = np.fromiter((x for r in rows for x in r), np.int64)
    at_all = np.concatenate([[0], np.cumsum(n_features)])
    y = np.array(labels)
    rng = np.random.default_rng(seed)
    g2 = np.full((size + 1, 1), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 128):
            i = order[at : at + 128]
            n = n_features[i]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            flat = flat_all[np.repeat(at_all[i] - starts, n) + np.arange(n.sum())]
            z = np.add.reduceat(w[flat], starts, axis=0)
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            cells, inv = np.unique(flat, return_inverse=True)
            grad = np.zeros((len(cells), classes))
            np.add.at(grad, inv, np.repeat(p, n, axis=0))
            g2[cells, 0] += (grad**2).mean(axis=1)
            w[cells] -= rate * grad / np.sqrt(g2[cells]) + decay * w[cells]
    return w[:size].astype(np.float32)


def _prior(labels: list[int], classes: int) -> np.ndarray:
    prior = np.log(np.bincount(labels, minlength=classes) + 1.0)
    return prior - np.log(np.exp(prior).sum())


def fit(examples: Iterable[tuple[Page, np.ndarray, frozenset]], epochs: int = 6, rate: float = 0.4, decay: float = 2e-6, seed: int = 7) -> Model:
    """Potentials from labelled pages."""
    rows: list[list[int]] = []
    labels: list[int] = []
    v_rows: list[list[int]] = []
    v_labels: list[int] = []
    start, stop, root = np.ones(STATES), np.ones(STATES), np.ones(STATES + 1)
    between, within = np.ones((STATES, STATES)) * 0.3, np.ones((STATES, STATES)) * 0.1 + np.eye(STATES) * 3
    tree_edges, leaf = np.ones((3, STATES + 1, STATES + 1)) * 0.3, np.ones((STATES + 1, STATES)) * 0.3
    for page, y, rep in examples:
        last = -1
        known = [int(v) for v in y if v >= 0]
        if not known:
            continue
        start[known[0]] += 1
        stop[known[-1]] += 1
        more: dict[int, list[int]] = {}
        for n, x in extras(page, rep):
            more.setdefault(n, []).append(x)
        for n, line in enumerate(page.lines):
            if page.head[n]:
                if y[n] >= 0 and last >= 0:
                    between[last, y[n]] += 1
                last = int(y[n])
            elif y[n] >= 0 and last >= 0:
                within[last, y[n]] += 1
            if y[n] >= 0:
                rows.append(features(line) + more.get(n, []))
                labels.append(int(y[n]))
                if len(line) > 20:  # once more without its words: what it looks like and the host's repeating it must tell too
                    rows.append(features(line, False) + more.get(n, []))
                    labels.append(int(y[n]))
        if page.tree:
            states = element_labels(page, y)
            younger: dict[int, int] = {}
            for n, v in sorted(states.items()):
                for plain in (False, True):
                    v_rows.append(element_features(page.tree.look(n, plain)))
                    v_labels.append(v)
                up = page.tree.parent[n]
                if up in younger:
                    tree_edges[1 + (page.tree.kids[n] > 0), younger[up], v] += 1
                elif n:
                    tree_edges[0, states[up], v] += 1
                else:
                    root[v] += 1
                younger[up] = v
            for n, v in zip(page.node, y.tolist()):
                if v >= 0:
                    leaf[states[n], v] += 1
    norm = lambda t: t / t.sum(axis=-1, keepdims=True)
    edges = (norm(start), norm(between), norm(within), norm(stop))
    if not rows:  # no labelled page: what is long or ends as a sentence is main body
        w = np.zeros((SIZE, STATES), np.float32)
        for name, v in (("long", 3.0), ("end.", 1.0), ("h1", 3.0), ("row", 2.0)):
            w[_buckets[name], BODY] = v
        for name, v in (("to:path", 3.0), ("linked4", 2.0)):
            w[_buckets[name], POST] = v
        return Model(w, np.log(np.ones(STATES) / STATES), *edges)
    w = _softmax(rows, labels, SIZE, STATES, epochs, rate, decay, seed)
    if not v_rows:
        return Model(w, _prior(labels, STATES), *edges)
    v = _softmax(v_rows, v_labels, 1 << BITS, STATES + 1, max(2, epochs // 2), rate, decay, seed)
    return Model(w, _prior(labels, STATES), *edges, v, _prior(v_labels, STATES + 1), norm(root), norm(tree_edges), norm(leaf))


def headline_key() -> F.Column:
    """Hash of the first line that is a level-one heading or is underlined by ``===``, else of nothing."""
    return F.xxhash64(F.regexp_extract("text", r"(?m)(?:^# +(.*)$)|(?:^(.+)\n===)", 0))


def notices(rows: DataFrame, least: int = 3, share: float = 0.03) -> DataFrame:
    """(host, notices array<bigint>): hashed letters of the single lines without links that a host's pages repeat under
    at least ``least`` headlines and ``share`` of its headlines; so a host has at most lines per page / share of them.
    Only hashes are shuffled, with map-side combining."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: (F.length(x) > 20) & ~x.contains("]("))
    letters_ = F.filter(F.transform(lines, lambda x: F.regexp_replace(F.lower(x), r"\P{L}+", "")), lambda x: x != "")
    base = rows.select("host", headline_key().alias("headline"), F.array_distinct(F.transform(letters_, lambda x: F.xxhash64(x))).alias("keys"))
    total = base.groupBy("host").agg(F.approx_count_distinct("headline", 0.02).alias("headlines"))
    few = base.select("host", "headline", F.explode("keys").alias("h")).distinct()
    n = few.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = salted(n, total, "host", "h", "inner").where(F.col("n") >= share * F.col("headlines"))
    return kept.groupBy("host").agg(F.collect_list("h").alias("notices"))


def prepared(df: DataFrame, id_col: str, url_col: str, text_col: str, *extra: str, html_col: str | None = None) -> DataFrame:
    """(id, host, text, html, extra columns) of the rows with text; html is null where there is none."""
    source = F.col(html_col) if html_col else F.lit(None).cast("string")
    return df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(host(url_col), F.lit("")).alias("host"), F.col(text_col).alias("text"), source.alias("html"), *extra
    )


def with_notices(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with their host's notices; broadcast below a checked number of bytes, else salted."""
    if broadcastable(found, F.length("host") + 8 * F.size("notices")):
        return rows.join(F.broadcast(found), "host", "left")
    return salted(rows, found, "host", "id", "left")


def train(pages: DataFrame, found: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "markdown", html_col: str = "html", sample: int = 1500) -> Model:
    """Fit on at most ``sample`` labelled pages."""
    marked = pages.where(F.col(html_col).contains("<main") & F.col(html_col).contains("</main") & F.col(text_col).isNotNull())
    marked = marked.select(F.col(id_col).alias("id"), F.coalesce(host(url_col), F.lit("")).alias("host"), F.col(text_col).alias("text"), F.col(html_col).alias("html"))
    picked = with_notices(marked.orderBy(F.xxhash64("id"), "id").limit(sample), found)
    examples = []
    for r in picked.collect():
        page = Page(r["text"], r["html"])
        y = label(page, r["html"])
        if y is not None:
            examples.append((page, y, frozenset(r["notices"] or ())))
    return fit(examples)


def _running(page_text: str, p: list[float | None]) -> str:
    """Main body without its headings."""
    lines = page_text.split("\n")
    return "\n".join(
        x for k, (x, v) in enumerate(zip(lines, p))
        if (v is None or v >= 0.5) and x[:1] != "#" and not (k + 1 < len(lines) and lines[k + 1][:3] == "===")
    )


def tag(rows: DataFrame, model: Model, extra: str = "", body: bool = False) -> DataFrame:
    """(id, p array<float>, text, the columns named in ``extra``, and with ``body`` the main body without its
    headings): the probability of each line of ``text`` to be main body, null for blank lines. ``rows`` has id,
    text, html, notices."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in extra.split(",") if c]
    schema = "id bigint, p array<float>, text string" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", body string" * body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, len(b), 256):
                x = b.slice(at, 256)
                texts = x.column(1).to_pylist()
                pages = [Page(t, h) for t, h in zip(texts, x.column(2).to_pylist())]
                reps = [frozenset(n or ()) for n in x.column(3).to_pylist()]
                out = []
                for page, prob in zip(pages, m.marginals(pages, reps)):
                    p: list[float | None] = [None] * page.total
                    for n, v in zip(page.numbers, (prob[:, BODY] + prob[:, TITLE]).tolist()):
                        p[n - 1] = v
                    out.append(p)
                cols = [x.column(0), pa.array(out, pa.list_(pa.float32())), x.column(1), *(x.column(4 + k) for k in range(len(keep)))]
                if body:
                    cols.append(pa.array([_running(t, p) for t, p in zip(texts, out)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "p", "text", *keep, *["body"] * body])

    return rows.select("id", "text", "html", "notices", *keep).mapInArrow(run, schema)


def furniture(tagged: DataFrame, *extra: str) -> DataFrame:
    """(id, extra columns, line_no): the non-blank lines that aren't main body."""
    lines = F.filter(F.transform("p", lambda v, k: F.when(v < 0.5, (k + 1).cast("bigint"))), lambda v: v.isNotNull())
    return tagged.select("id", *extra, F.explode(lines).alias("line_no"))


def body_text() -> F.Column:
    """The main body of a tagged row: its other lines left out, blank ones kept."""
    return F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: F.coalesce(F.get("p", k), F.lit(1.0)) >= 0.5), "\n")


def tagged_tables(tables: list[tuple[str, DataFrame, str, str, str, str | None]], pages: DataFrame) -> tuple[DataFrame, Model]:
    """Tag several tables with shared host statistics and one model. ``tables``: (name, df, id, url, text, html)."""
    rows = None
    for name, df, i, u, t, h in tables:
        one = prepared(df, i, u, t, html_col=h).withColumn("tbl", F.lit(name))
        rows = one if rows is None else rows.union(one)
    found = cut(notices(rows))
    model = train(pages, found)
    return tag(with_notices(rows, found), model, "tbl,host"), model
