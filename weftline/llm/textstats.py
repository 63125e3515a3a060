"""Problem 6: text quality statistics of each document, and pages that aren't prose.

A text longer than ``chunk`` characters is cut into chunks at fixed places, so one huge document is many
tasks' work. A chunk's result is a partial: sums over its whole lines, and the boundary state of its first and last
line, which may go on in the neighbours (``Piece``: the tokens at either end as text, the distinct words of the line so
far, and the counts of the tokens between, which no neighbour can change). Partials merge associatively - the tokens
where two pieces meet are joined and counted then, with the pairs and gaps they form - first by groups of 64 neighbouring chunks and
then by document (tree aggregation). Every count is therefore the same wherever a text is cut. Ratios and rule outcomes are
derived from the merged sums alone.

Each line has a kind: prose, list, table, junk or other (headings, rules, short lines of prose pages). A page
isn't prose if lists, tables and junk hold more characters than prose; its kind is the largest of them.

Defined results: null text gives no row; empty and blank text has counts of zero, ratios of zero and no kind;
of equally large kinds the first of junk, list, table wins; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The commonest function words of the eight languages.
COMMON = frozenset(
    "the of and to in a is that for it as was with by on at from an be "
    "der die das und in zu den von mit ist auf für nicht des ein eine dem "
    "le la les de des et à en un une du dans que pour par est "
    "el los las y del que en un una por con para se al "
    "il lo gli di e che è un una per con del della nel dal "
    "o os as do da em um uma e no na por com para ao "
    "het een en van dat op te met voor zijn niet aan bij "
    "и в не на что с по как из у к за от для".split()
)
WORD = re.compile(r"[^\W_]+")
VOWEL = re.compile(r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüœаеёиоуыэюя]")
SENTENCE_END = re.compile(r"[.!?…][\"'”»’)\]*_]{0,8}$")
#: A sentence ends inside a line where one token ends and the next one starts like this.
INNER_END = re.compile(r"[.!?…](?<=[a-zà-ÿа-я0-9].)[\"'”»’)\]]{0,8}\s+[\"'“«„(\[]{0,8}[A-ZÀ-ÞА-Я]")
DIGIT = re.compile(r"\d")
EDGE = re.compile(r"\s*\S+\s*\S*")
ITEM = re.compile(r"(?:[-+*•]|\d{1,3}[.)])\s")
GAP = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
KINDS = ("prose", "list", "table", "junk", "other")
(CHARS, WORDS, LETTERS, DIGITS, SYMBOLS, COMMONS, PIPES, TABS, GAPS, COMMAS, ENDS, LONGS, BROKEN, VOWELLESS, TOKENS, WORD_CHARS, REPEATS) = range(WIDTH := 17)


class _Flags(dict):
    """Of a word: 1 if it's common, and ``_ODD`` if it's of letters but no vowel."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        v = self[word] = (word in COMMON) + _ODD * (len(word) > 3 and word.isalpha() and not VOWEL.search(word))
        return v


_ODD = 1 << 40
_flags = _Flags()


def count_tokens(n: list[int], tokens: list[str], seen: set[str]) -> None:
    """Add what single tokens contribute; ``seen`` gathers the words."""
    low = " ".join(tokens).lower()
    n[TOKENS] += len(tokens)
    sizes = list(map(len, tokens))
    n[CHARS] += sum(sizes)
    if sizes and max(sizes) > 28:
        n[LONGS] += sum(x for x in sizes if x > 28)
    words = WORD.findall(low)
    n[WORDS] += len(words)
    n[WORD_CHARS] += sum(map(len, words))
    odd, common = divmod(sum(map(_flags.__getitem__, words)), _ODD)
    n[COMMONS] += common
    n[VOWELLESS] += odd
    seen.update(words)


def count_pairs(n: list[int], text: str) -> None:
    """Add what successive tokens and the space between them contribute; ``text`` holds exactly the tokens."""
    n[ENDS] += len(INNER_END.findall(text))
    n[GAPS] += len(GAP.findall(text)) if "  " in text or "\t" in text else 0


class Piece:
    """A line or a part of one. While it has few tokens it is its text (``left``). Else the first two tokens stand in
    ``left``, the last two in ``right``; the tokens but the first and last are counted, and so are the pairs between
    the second and the last but one."""

    __slots__ = ("n", "seen", "left", "right")

    def __init__(self, text: str):
        n = self.n = [0] * WIDTH
        self.seen: set[str] = set()
        self.left, self.right = text, None
        # What single characters contribute is never changed by a neighbour.
        n[DIGITS] = len(DIGIT.findall(text))
        n[PIPES], n[TABS] = text.count("|"), text.count("\t")
        n[COMMAS] = text.count(",") + text.count(";")
        n[BROKEN] = text.count("�")

    def settle(self) -> Piece:
        """Count what no neighbour can change any more."""
        if self.right is None:
            tokens = self.left.split()
            if len(tokens) < 6:
                return self
            text, first = self.left, EDGE.match(self.left).end()
            last = len(text) - EDGE.match(text[::-1]).end()
            count_tokens(self.n, tokens[1:-1], self.seen)
            count_pairs(self.n, text[text.index(tokens[1], first - len(tokens[1])) : last + len(tokens[-2])])
            self.left, self.right = text[:first], text[last:]
        return self

    def join(self, right: Piece) -> Piece:
        """The line that goes from this part into ``right``."""
        out = Piece("")
        out.n = [a + b for a, b in zip(self.n, right.n)]
        out.seen = self.seen | right.seen
        if self.right is None and right.right is None:
            out.left = self.left + right.left
            return out.settle()
        if self.right is None:  # few tokens before many: those between the new first and the known second are counted
            text = self.left + right.left
            tokens = text.split()
            first = EDGE.match(text).end() if len(tokens) > 1 else len(text)
            if len(tokens) > 2:
                count_tokens(out.n, tokens[1:-1], out.seen)
                count_pairs(out.n, text[first - len(tokens[1]) :].rstrip())
            out.left, out.right = text[:first], right.right
            return out
        if right.right is None:
            text = self.right + right.left
            tokens = text.split()
            last = len(text) - EDGE.match(text[::-1]).end() if len(tokens) > 1 else 0
            if len(tokens) > 2:
                count_tokens(out.n, tokens[1:-1], out.seen)
                count_pairs(out.n, text[: last + len(tokens[-2])].lstrip())
            out.left, out.right = self.left, text[last:]
            return out
        text = self.right + right.left
        tokens = text.split()
        count_tokens(out.n, tokens[1:-1], out.seen)
        count_pairs(out.n, text.strip())
        out.left, out.right = self.left, right.right
        return out

    def whole(self) -> Piece:
        """The line, now that nothing follows: its open ends counted."""
        n = self.n
        if self.right is None:
            tokens = self.left.split()
            count_tokens(n, tokens, self.seen)
            count_pairs(n, self.left.strip())
        else:
            a, b = self.left.split(), self.right.split()
            count_tokens(n, [a[0], b[-1]], self.seen)
            count_pairs(n, self.left.strip())
            count_pairs(n, self.right.strip())
        n[REPEATS] = n[WORDS] - len(self.seen)
        n[LETTERS] = n[WORD_CHARS] - n[DIGITS]
        n[SYMBOLS] = n[CHARS] - n[WORD_CHARS]
        return self

    @property
    def start(self) -> str:
        """How the line begins: its first two tokens, eight characters of them."""
        m = EDGE.match(self.left)
        return m[0].lstrip()[:8] if m else ""

    @property
    def tail(self) -> str:
        return (self.left if self.right is None else self.right).rstrip()[-10:]

    def state(self) -> list:
        return [self.n, sorted(self.seen), self.left, self.right]

    @staticmethod
    def of(state: list) -> Piece:
        out = Piece("")
        out.n, out.seen, out.left, out.right = state[0], set(state[1]), state[2], state[3]
        return out


def kind(piece: Piece) -> str:
    """Kind of a whole line from its counts, start and end."""
    n, s = piece.n, piece.start
    chars, words = n[CHARS], n[WORDS]
    if not chars or s[:1] == "#":
        return "other"
    if not words and not set(s) - set("=-*_|: "):
        return "table" if "|" in s else "other"
    if n[SYMBOLS] > 0.6 * chars and chars > 25:
        return "junk"
    item = bool(ITEM.match(s))
    ends = bool(SENTENCE_END.search(piece.tail))
    common = n[COMMONS] / max(1, words)
    if n[BROKEN] > 2 and n[BROKEN] > chars / 60:
        return "junk"
    if n[PIPES] >= 2 and (s[:1] == "|" or n[PIPES] >= 3):
        return "table"
    if n[LONGS] > chars / 2 and "](" not in s and n[TOKENS] < 12 and common < 0.1:
        return "junk"
    if (n[TABS] or n[GAPS] >= 2) and n[SYMBOLS] < 0.35 * chars:
        return "table"
    if n[SYMBOLS] > 0.34 * chars and chars > 12 and common < 0.15:
        return "junk"
    if n[SYMBOLS] - n[COMMAS] >= 0.22 * chars and chars > 20 and not item and not n[PIPES] and s[:4] != "http" and s[:1] not in "![*_>":
        return "junk"
    if n[DIGITS] + n[SYMBOLS] > chars / 2 and chars > 20 and n[COMMAS] < 2 and "](" not in s and not n[COMMONS]:
        return "junk"
    if words >= 12 and n[REPEATS] > words / 2 and not n[ENDS]:
        return "junk"
    if n[VOWELLESS] >= 2 and n[VOWELLESS] > 0.12 * words:
        return "junk"
    if words >= 5 and ends and (n[COMMONS] or n[ENDS]):
        return "prose"
    if words >= 9 and common >= 0.12:
        return "prose"
    if n[COMMAS] >= 2 and n[COMMAS] >= n[TOKENS] - 2 and n[DIGITS]:
        return "table"
    if words >= 12 and common < 0.06 and not n[ENDS]:
        return "junk"
    if item or words <= 8:
        return "list"
    return "prose" if ends or n[ENDS] else "list"


class Partial:
    """Sums over whole lines, and the first and last line where they're open. ``last`` is None while there
    was no line end yet; then ``first`` is all."""

    def __init__(self, text: str):
        lines = text.split("\n")
        self.total = [0] * WIDTH
        self.lines = self.ended = 0
        self.kinds = {k: [0, 0] for k in KINDS}
        self.first, self.last = Piece(lines[0]).settle(), None
        if len(lines) > 1:
            for x in lines[1:-1]:
                self.close(Piece(x))
            self.last = Piece(lines[-1]).settle()

    def close(self, piece: Piece) -> None:
        if piece.right or not (piece.left == "" or piece.left.isspace()):
            piece.whole()
            self.total = [a + b for a, b in zip(self.total, piece.n)]
            self.lines += 1
            self.ended += bool(SENTENCE_END.search(piece.tail))
            k = self.kinds[kind(piece)]
            k[0] += 1
            k[1] += piece.n[CHARS]

    def merge(self, right: Partial) -> Partial:
        self.total = [a + b for a, b in zip(self.total, right.total)]
        self.lines += right.lines
        self.ended += right.ended
        for k in KINDS:
            self.kinds[k] = [a + b for a, b in zip(self.kinds[k], right.kinds[k])]
        joined = (self.last if self.last is not None else self.first).join(right.first)
        if self.last is None:
            self.first, self.last = joined, right.last
        elif right.last is None:
            self.last = joined
        else:
            self.close(joined)
            self.last = right.last
        return self

    def finish(self) -> Partial:
        self.close(self.first)
        if self.last is not None:
            self.close(self.last)
        return self

    def state(self) -> list:
        return [self.total, self.lines, self.ended, self.kinds, self.first.state(), self.last and self.last.state()]

    @staticmethod
    def of(state: list) -> Partial:
        out = Partial("")
        out.total, out.lines, out.ended, out.kinds = state[:4]
        out.first, out.last = Piece.of(state[4]), state[5] and Piece.of(state[5])
        return out


SHAPE = (
    "id bigint, words bigint, chars bigint, lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, "
    "ended_lines double, common_words double, prose double, list double, `table` double, junk double, kind string, natural boolean"
)
NAMES = [x.split()[0].strip("`") for x in SHAPE.split(", ")]


def derive(p: Partial) -> tuple:
    """Ratios and rule outcomes of a finished partial."""
    n = p.total
    chars, words, lines = max(1, n[CHARS]), max(1, n[WORDS]), max(1, p.lines)
    share = {k: p.kinds[k][1] / chars for k in KINDS}
    other = share["list"] + share["table"] + share["junk"]
    best = min(("junk", "list", "table"), key=lambda k: -share[k]) if other > share["prose"] else None
    natural = best is None and n[WORDS] >= 20 and n[COMMONS] / words >= 0.15 and 2 <= n[WORD_CHARS] / words <= 12
    return (
        n[WORDS], n[CHARS], p.lines, n[WORD_CHARS] / words if n[WORDS] else 0.0, n[SYMBOLS] / chars, n[DIGITS] / chars, p.ended / lines,
        n[COMMONS] / words, share["prose"], share["list"], share["table"], share["junk"], best, natural,
    )


def statistics(df: DataFrame, id_col: str, text_col: str, chunk: int = 65_536, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row of statistics for each row of ``df`` with text, and the ``extra`` columns; repeated and null ids keep a row each. A text of one chunk
    is finished where it is read; the result is the same."""
    import json

    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), *extra)
    kinds = dict(zip(NAMES[1:], [pa.int64()] * 3 + [pa.float64()] * 9 + [pa.string(), pa.bool_()]))
    more = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in extra)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [derive(Partial(t).finish()) for t in b.column(1).to_pylist()]
            cols = list(zip(*found)) if found else [()] * len(kinds)
            cols = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds.values())), *(b.column(2 + k) for k in range(len(extra)))]
            yield pa.RecordBatch.from_arrays(cols, names=[*NAMES, *extra])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = [json.dumps(Partial(t).state()) for t in b.column(3).to_pylist()]
            cols = [*(b.column(k) for k in range(3)), pa.array(states, pa.string()), *(b.column(4 + k) for k in range(len(extra)))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "no", "state", *extra])

    def merged(pdf) -> Partial:
        out = None
        for s in pdf.sort_values("no")["state"]:
            p = Partial.of(json.loads(s))
            out = p if out is None else out.merge(p)
        return out

    def group(pdf):
        out = pdf.sort_values("no").head(1)[["row", "id", "no", "state", *extra]].copy()
        out["state"] = json.dumps(merged(pdf).state())
        return out

    def last(pdf):
        import pandas as pd

        one = pdf.iloc[:1]
        out = pd.DataFrame([(None if one["id"].isna().iloc[0] else one["id"].iloc[0], *derive(merged(pdf).finish()))], columns=NAMES)
        for c in extra:
            out[c] = one[c].to_numpy()
        return out

    small = rows.where(F.length("text") <= chunk).mapInArrow(whole, SHAPE + more)
    cuts = F.sequence(F.lit(0), ((F.length("text") - 1) / chunk).cast("int"))
    parts = "row bigint, id bigint, no int, state string" + more
    large = rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())  # ids may repeat
    large = large.select("row", "id", "text", F.explode(cuts).alias("no"), *extra)
    large = large.select("row", "id", "no", F.expr(f"substring(text, no * {chunk} + 1, {chunk})").alias("piece"), *extra).mapInArrow(part, parts)
    tree = large.withColumn("up", F.floor(F.col("no") / 64)).groupBy("row", "up").applyInPandas(group, parts)
    return small.union(tree.groupBy("row").applyInPandas(last, SHAPE + more))
