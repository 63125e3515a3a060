"""Problem 2: template residue, filler and error-page text.

Labelled exemplars of residue (a table of kind, language, text) are held in an inverted index of their words and word
pairs. Passage windows are the sentences of the main body's running text, short ones with their predecessor, and the
headline. A window retrieves, through the postings of its terms, the groups of exemplars (one kind in one language) that share
them; its containment is the TF-IDF weight of its terms that one group holds, as a part of its whole weight. A window of
high containment is residue, and a page of whose words at least ``cover`` lie in residue windows is excluded. The page's title
and status code are read too: where the title is itself residue, or the status says error, less containment is
enough; neither decides alone.

Placeholders are terms of the index as well: a span between the delimiters of a template language becomes the term of its
form (delimiters and the shape of what is inside), exemplars hold the forms, and a span in running text or a headline,
outside code, whose form is held is residue. A whole sentence between brackets is judged by its words.

Inverse document frequencies come from the exemplars; a term that no exemplar holds weighs as the rarest one, so site names
and article text lower the containment. Filler of pseudo-Latin words counts in any order.

Defined results: null text gives no row; empty text isn't residue; null title and status say nothing; of equally contained
kinds the first in the alphabet is named; repeated rows give repeated rows; lists, tables and junk aren't residue unless
exemplars hold them.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.language import LATIN
from weftline.llm.residue_exemplars import EXEMPLARS

#: Spans between delimiters that may be placeholders.
SPAN = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|(?<![\w$#{%])\{[^{}\n]{1,60}\}"
    r"|(?<![\w%])%[A-Za-z_]{3,40}%(?![\w%])|(?<![\w@])@@[A-Za-z_]{2,40}@@|(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)|\[[^\]\[\n]{2,90}\](?!\()"
)
INSIDE = re.compile(r"[A-Za-z_][\w.]*")
INSTRUCTION = re.compile(r"(?i)(?:insert|add|enter|put|type|your|replace|choose)\b")
TERM = re.compile(r"[^\W\d_]+|\d+")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»’)\]]*\s+")
TICKS = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)")
MARK = re.compile(r"^\s*(?:#{1,6}\s+|>\s*|[-+*•]\s+|\d{1,3}[.)]\s+)*")
TITLE_CUT = re.compile(r"\s+[-–—|·:•]\s+")
SHORT = 3
CACHE = 100_000


def form(span: str) -> str | None:
    """The term of a placeholder's form: its delimiters and the shape of what is inside; None for no such form."""
    m = re.match(r"\W+|__", span)
    left = m[0].strip() if m else ""
    inner = span[len(m[0]) :].strip() if m else span
    inner = re.sub(r"(?:\W+|__)$", "", inner)
    if left[:1] == "[":
        if INSTRUCTION.match(inner):
            return "[ask"
        return "[UPPER" if inner and all(w.isupper() for w in re.findall(r"[^\W\d_]+", inner)) and re.fullmatch(r"[A-Z][A-Z_]*(?: [A-Z_]+)*", inner) else None
    words = re.split(r"[\s|]+", inner)
    if not all(INSIDE.fullmatch(w) for w in words if w) or not inner:
        return None
    many = len(words) > 1 and left not in ("{{", "{%", "<%", "<%=")
    return None if many else left.rstrip("-=").rstrip() + "name"


def terms(text: str) -> list[str]:
    """Words, numbers as one word, and pairs of successive words."""
    w = ["0" if x.isdigit() else x for x in TERM.findall(text.lower())]
    return w + [a + " " + b for a, b in zip(w, w[1:])]


class ResidueIndex:
    """Inverted index: the groups (kind, language) of exemplars in which each term occurs, with its weight."""

    def __init__(self, exemplars: Iterable[tuple[str, str, str]] = EXEMPLARS):
        rows = [(k, lang or "", t) for k, lang, t in exemplars if k and t]
        self.forms = {f for k, _, t in rows if k == "placeholder" for f in [form(t)] if f}
        held: dict[tuple[str, str], set[str]] = defaultdict(set)
        df: Counter = Counter()
        n = 0
        for kind, lang, text in rows:
            if kind != "placeholder":
                for part in SENTENCE.split(text):
                    found = set(terms(part))
                    held[kind, lang] |= found
                    df.update(found)
                    n += 1
        held["filler", "la"] = set(LATIN)
        df.update(LATIN)
        self.groups = sorted(held)
        self.any_order = self.groups.index(("filler", "la"))
        self.top = math.log(1 + max(1, n))
        self.idf = {t: math.log(1 + n / k) for t, k in df.items()}
        self.words: dict[str, tuple[float, list[int]]] = {t: (self.idf[t], []) for t in df if " " not in t}
        self.pairs: dict[tuple[str, str], tuple[float, list[int]]] = {tuple(t.split(" ")): (self.idf[t], []) for t in df if " " in t}
        for g, key in enumerate(self.groups):
            for t in held[key]:
                (self.pairs[tuple(t.split(" "))] if " " in t else self.words[t])[1].append(g)
        self.cache: dict[str, tuple[float, str | None, int]] = {}

    def containment(self, text: str) -> tuple[float, str | None, int]:
        """Best containment of a window in a group of exemplars, its kind, and the window's words. In pseudo-Latin words any
        order counts, so only the window's single words are weighed there; a number alone says nothing."""
        hit = self.cache.get(text)
        if hit is not None:
            return hit
        got = [0.0] * len(self.groups)
        whole = single = 0.0
        words, pairs, top = self.words, self.pairs, self.top
        last, known = None, False
        found = TERM.findall(text.lower())
        for t in found:
            t = "0" if t.isdigit() else t
            e = words.get(t)
            w = e[0] if e else top
            if t != "0":
                whole += w
                single += w
                if e:
                    for k in e[1]:
                        got[k] += w
            if last is not None:  # numbers in a row are data
                pair = pairs.get((last, t)) if e and known else None
                whole += pair[0] if pair else top
                if pair:
                    for k in pair[1]:
                        got[k] += pair[0]
            last, known = t, e is not None
        if whole:
            got = [v / ((single or 1.0) if k == self.any_order else whole) for k, v in enumerate(got)]
        best = max(range(len(got)), key=lambda k: (got[k], -k))
        out = (got[best], self.groups[best][0] if got[best] else None, len(found))
        if len(self.cache) > CACHE:
            self.cache.clear()
        self.cache[text] = out
        return out

    def placeholders(self, text: str, contain: float) -> int:
        """Spans of ``text`` whose form an exemplar holds, or that are a bracketed sentence of residue."""
        n = 0
        for span in SPAN.findall(text) if "{" in text or "[" in text or "%" in text or "@@" in text or "__" in text else ():
            f = form(span)
            if f is not None:
                n += f in self.forms
            elif span[0] == "[" and span[-2] in ".!…" and len(span) > 13:
                n += self.containment(span[1:-1])[0] >= contain
        return n


def windows(text: str, p: list[float | None]) -> tuple[list[tuple[bool, str]], str]:
    """(is headline, passage) of the main body, and its text outside code for placeholders."""
    out: list[tuple[bool, str]] = []
    plain: list[str] = []
    lines = text.split("\n")
    fenced = False
    for k, line in enumerate(lines):
        if line.lstrip(" >")[:3] in ("```", "~~~"):
            fenced = not fenced
            continue
        v = p[k] if k < len(p) else None
        if v is None or v < 0.5 or fenced or line.startswith("    "):
            continue
        if set(line.strip()) <= set("=-|: "):
            continue
        head = line.lstrip()[:1] == "#" or (k + 1 < len(lines) and lines[k + 1][:3] in ("===", "---"))
        if "`" in line:
            line = TICKS.sub(" ", line)
        plain.append(line)
        for s in SENTENCE.split(MARK.sub("", line)):
            size = len(TERM.findall(s)) if len(s) < 40 else SHORT + 1
            if size > SHORT or (size and (head or not out or out[-1][0])):
                out.append((head, s))
            elif size:
                out[-1] = (False, f"{out[-1][1]} {s}")
    return out, "\n".join(plain)


def judge(index: ResidueIndex, text: str, p: list[float | None], contain: float, title: str | None = None, status: int | None = None) -> tuple[float, str | None, int]:
    """(share of the main body's words in residue windows, kind, placeholders)."""
    parts, plain = windows(text, p)
    n = index.placeholders(plain, contain)
    heads = [s for h, s in parts if h][:1] + (TITLE_CUT.split(title) if title else [])
    named = any(index.containment(s)[0] >= 1.4 * contain for s in heads)
    need = contain * (0.75 if named else 1.0) * (0.85 if status and status >= 400 else 1.0)
    words: Counter = Counter()
    total = 0
    for _, s in [x for x in parts if not x[0]] or parts:
        c, kind, size = index.containment(s)
        total += size
        if c >= need:
            words[kind] += size
    if not total and plain.strip():
        return 0.0, None, n
    if not total:
        # Nothing counts as main body: a notice among the furniture is then all that the page says.
        for line in text.split("\n"):
            for s in SENTENCE.split(MARK.sub("", line)):
                c, kind, size = index.containment(s)
                if c >= 1.4 * contain and size > SHORT:
                    return 1.0, kind, n
        return 0.0, None, n
    kind = min(words, key=lambda k: (-words[k], k)) if words else None
    return sum(words.values()) / total, kind, n


def residue(tagged: DataFrame, contain: float = 0.35, cover: float = 0.3, exemplars: Iterable[tuple[str, str, str]] = EXEMPLARS) -> DataFrame:
    """(id, share, kind, placeholders, found): every tagged page, judged. ``tagged`` has id, p, text, and may have title
    and status_code. ``exemplars`` is a labelled table of bounded size."""
    shape = "id bigint, share double, kind string, placeholders int, found boolean"
    table = tuple(exemplars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ResidueIndex(table)
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(1, b.num_columns)]
            more = cols[2:] or [[None] * len(b)] * 2
            rows = [judge(index, t, p, contain, ti, st) for p, t, ti, st in zip(cols[0], cols[1], *more)]
            share, kind, marks = zip(*rows) if rows else ((), (), ())
            found = [s >= cover or m > 0 for s, m in zip(share, marks)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(share, pa.float64()), pa.array([k or ("placeholder" if m else None) for k, m in zip(kind, marks)], pa.string()), pa.array(marks, pa.int32()), pa.array(found, pa.bool_())],
                names=["id", "share", "kind", "placeholders", "found"],
            )

    more = ["title", "status_code"] if {"title", "status_code"} <= set(tagged.columns) else []
    return tagged.select("id", "p", "text", *more).mapInArrow(run, shape)
