"""Problem 8: evaluation texts leaking into training text.

Texts become words (entities resolved, compatibility forms folded, lower case, letters and digits only).
Runs of three item words are the seeds. A document is joined to the items of which its seeds cover words enough
to reach the required share with single words changed; how many documents hold a seed doesn't matter, as a widely
leaked part of an item counts like any other. Those pairs are scored by Smith-Waterman alignment. An alignment is cut where more than one word in a row is missing, changed or
inserted; the pieces of at least ``stretch`` item words, best set in the item's order, are added up.

The index of a block of items is broadcast; a block has at most ``block_words`` words, so its size is bounded whatever
the benchmark's. One block is the usual case. Beyond that the blocks are taken one after the other, each read, broadcast,
run over the documents and its rows written before the next is read, so the driver never holds more than one.

Only the document's words around its common seeds are aligned, so a task's work grows with the seeds found, not with the
length of the text between them.

Defined results: null, empty and blank texts give no row; each (document, item) pair comes once per
document row, with its share; a repeated document row repeats its rows; an empty benchmark gives none.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.neardup import WORD, _M1, _M2, _words, mix
from weftline.session import cut, written

SEED = 3
_HIDDEN = re.compile("[­​-‍⁠﻿]")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.lower())


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def runs(h: np.ndarray, n: int = SEED) -> np.ndarray:
    if len(h) < n:
        return np.empty(0, np.uint64)
    s = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            s = mix(s * _M2 + h[k : len(h) - n + 1 + k] + _M1)
    return s


def align(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Best local alignment as matched (item position, document position) pairs: +1 a match, -1 a changed,
    dropped or inserted word."""
    n, m = len(item), len(doc)
    score = np.where(item[:, None] == doc[None, :], 1, -1).astype(np.int32)
    h = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n):
        row = np.maximum(h[i, :-1] + score[i], h[i, 1:] - 1)
        np.maximum(row, 0, out=row)
        row[1:] = np.maximum(row[1:], row[:-1] - 1)  # inserted words come one at a time
        h[i + 1, 1:] = row
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    out: list[tuple[int, int]] = []
    while i > 0 and j > 0 and h[i, j] > 0:
        s = score[i - 1, j - 1]
        if h[i, j] == h[i - 1, j - 1] + s:
            if s > 0:
                out.append((int(i) - 1, int(j) - 1))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def stretches(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(item from, item to, document from, document to), ends included, of the stretches of at least ``least``
    item words, found one local alignment after the other."""
    item, doc, found = item.copy(), doc.copy(), []
    for _ in range(2 + len(item) // least):
        path = align(item, doc)
        if len(path) < max(2, least // 2):
            break
        start = 0
        for k in range(1, len(path) + 1):
            cut_here = k == len(path) or path[k][0] - path[k - 1][0] > 2 or path[k][1] - path[k - 1][1] > 2
            if cut_here:
                (a, c), (b, d) = path[start], path[k - 1]
                if b - a + 1 >= least:
                    found.append((a, b, c, d))
                start = k
        for a, c in path:  # what was aligned is taken; 1 and 2 are no words' hashes
            item[a], doc[c] = 1, 2
    return found


def covered(parts: list[tuple[int, int, int, int]]) -> int:
    """Most item words in a set of stretches that follow each other in both texts."""
    parts = sorted(parts)
    best = []
    for k, (a, b, c, d) in enumerate(parts):
        before = max((best[x] for x in range(k) if parts[x][1] < a and parts[x][3] < c), default=0)
        best.append(before + b - a + 1)
    return max(best, default=0)


class Index:
    """Seeds of a block of items, sorted, with their item and position."""

    def __init__(self, items: list[tuple[int, np.ndarray]], cover: float = 0.56):
        self.cover = cover
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(h) for _, h in items])
        self.words = [h for _, h in items]
        g = [runs(h) for h in self.words]
        seeds = np.concatenate(g) if g else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(g)), [len(x) for x in g]).astype(np.int64)
        pos = np.concatenate([np.arange(len(x)) for x in g]) if g else np.empty(0, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.pos = seeds[order], owner[order], pos[order]
        self.keys, self.first, self.count = np.unique(self.seeds, return_index=True, return_counts=True)
        self.mask = np.uint64((1 << max(16, 4 + len(self.keys).bit_length())) - 1)
        self.maybe = np.zeros(int(self.mask) + 1, bool)  # by the last bits: most runs are no seed's
        self.maybe[self.keys & self.mask] = True

    def lookup(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """For each document the indices into ``keys`` of its distinct runs that are seeds."""
        h = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        g = runs(h)
        if not len(self.keys) or not len(g):
            return [np.empty(0, np.int64)] * len(docs)
        ends = np.cumsum([len(d) for d in docs])
        hit = np.flatnonzero(self.maybe[g & self.mask])
        at = np.minimum(np.searchsorted(self.keys, g[hit]), len(self.keys) - 1)
        same = self.keys[at] == g[hit]
        hit, at = hit[same], at[same]
        owner = np.searchsorted(ends, hit, side="right")
        inside = hit + SEED <= ends[owner]  # not across documents
        at, owner = at[inside], owner[inside]
        cuts = np.searchsorted(owner, np.arange(1, len(docs)))
        return [np.unique(x) for x in np.split(at, cuts)]

    def candidates(self, keys: np.ndarray, share: float) -> list[int]:
        """The items of which seeds cover words enough."""
        if not len(keys) or len(keys) * SEED < self.cover * share * self.sizes.min():  # too few for the shortest item
            return []
        size = self.count[keys]
        flat = np.repeat(self.first[keys] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        owner = self.owner[flat]
        out = []
        hits = np.bincount(owner, minlength=len(self.ids))
        many = (hits > 0) & (hits * SEED >= self.cover * share * self.sizes)
        for c in np.flatnonzero(many).tolist():
            mine = flat[owner == c]
            held = np.zeros(self.sizes[c] + SEED, bool)
            for k in range(SEED):
                held[self.pos[mine] + k] = True
            if held.sum() >= self.cover * share * self.sizes[c]:
                out.append(c)
        return out


GAP = np.array([2, 2, 2], np.uint64)  # no words' hashes


def around(at: np.ndarray, doc: np.ndarray, margin: int) -> np.ndarray:
    """The document's words around its common seeds, ``margin`` on either side, parted by what is no word."""
    cuts = np.flatnonzero(np.diff(at) > 2 * margin + SEED) + 1
    out: list[np.ndarray] = []
    for part in np.split(at, cuts):
        out += [GAP, doc[max(0, part[0] - margin) : part[-1] + SEED + margin]]
    return np.concatenate(out[1:])


def reachable(item: np.ndarray, doc: np.ndarray, least: int) -> int:
    """Most item words that stretches can cover: of a run of words that the document holds, single ones between two of
    them missing, no shorter than a stretch. Where a word stands in the document doesn't count here."""
    there = np.isin(item, doc)
    ok = there.copy()
    ok[1:-1] |= there[:-2] & there[2:]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
    size = edges[1::2] - edges[::2]
    return int(size[size >= least].sum())


def share_held(item: np.ndarray, doc: np.ndarray, stretch: int, share: float = 0.0) -> float:
    """The part of the item's words that the document holds in stretches; 0 without alignment where it can't be ``share``."""
    at = np.flatnonzero(np.isin(runs(doc), runs(item)))
    if not len(at):
        return 0.0
    least, near = min(stretch, len(item)), around(at, doc, 2 * stretch)
    if reachable(item, near, least) < share * len(item):
        return 0.0
    return covered(stretches(item, near, least)) / len(item)


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
          share: float = 0.5, stretch: int = 8, block_words: int = 2_000_000, cover: float = 0.56) -> DataFrame:
    """(doc_id, item_id, share): the items of which a document holds at least ``share`` in stretches. A pair is aligned if
    seeds cover ``cover`` of the words that the share asks for (single words changed in every fourth place leave three
    quarters); 0 aligns every pair with a seed in common."""
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    shape = "doc_id bigint, item_id bigint, share double"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(words_of(t)).view(np.int64).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])

    some = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint"), item_text)
    made = cut(some.mapInArrow(hashed, "item_id bigint, words array<bigint>").where(F.size("words") > 0))
    size = made.agg(F.sum(F.size("words"))).first()[0]
    n = -(-(size or 0) // block_words)
    # A block takes items by hash; twice the number of blocks keeps nearly all below the bound.
    blocks = [made] if n <= 1 else [made.where(F.pmod(F.xxhash64("item_id"), F.lit(2 * n)) == k) for k in range(2 * n)]

    def scored(block: DataFrame) -> DataFrame:
        index = spark.sparkContext.broadcast(Index([(r[0], np.array(r[1], np.int64).view(np.uint64)) for r in block.toLocalIterator()], cover))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                h = [word_hashes(words_of(t)) for t in b.column(1).to_pylist()]
                rows: list[tuple[int, int, float]] = []
                for i, words, keys in zip(b.column(0).to_pylist(), h, ix.lookup(h)):
                    for c in ix.candidates(keys, share):
                        got = share_held(ix.words[c], words, stretch, share)
                        if got >= share:
                            rows.append((i, ix.ids[c], got))
                d, it, s = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(it, pa.int64()), pa.array(s, pa.float64())], names=["doc_id", "item_id", "share"])

        out = docs.mapInArrow(score, shape)
        if len(blocks) > 1:
            out = written(out, "leaks")
            index.destroy()
        return out

    if not size:
        return spark.createDataFrame([], shape)
    return functools.reduce(DataFrame.union, [scored(b) for b in blocks])
