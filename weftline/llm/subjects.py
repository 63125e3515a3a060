"""Problem 9: the subject areas of each document by seeded, anchored non-negative factorisation of the whole corpus.

The rows of the matrix are documents first and then passages (sentences), the columns terms, the factors mixtures W of the
rows and components H. Component k is a subject. Texts are read and cut into words once and written as blocks of documents
(``coded``); everything after works on these. The vocabulary is every term of ``least`` documents of the corpus or more
(three; two up to 300 documents). H starts from the counts of all documents that carry the label. Then non-negative updates
for the Kullback-Leibler distance alternate over all documents: with H fixed every document's mixture is found by ``inner``
updates, and the mixtures' counts, summed over the corpus, are the new H. W is anchored: at every update a labelled
document's weights for other subjects are scaled down, not forbidden, as labels may be wrong or name one subject of several.
This goes on until no component moves by more than ``still`` of its mass, ``rounds`` times at most; in ``free`` further ones
all weights are free. There a term counts at most ``most`` times in a document. Terms that all subjects use alike weigh
little in W, by their spread over the components.

Then the same is done ``passes`` times with every passage of every document as a row. At the end every document's subjects
are read from W: a subject's share is the mean of its passages' mixtures, by their words; a passage whose terms hold less
evidence than one term that belongs to one subject alone counts in proportion. A document has the subjects that hold at least
``share`` of its words.

To the driver and to every task goes what the vocabulary bounds: terms and terms x subjects. It grows with the corpus's
different words, not with its rows.

Defined results: null, empty, blank and machine-made texts give no row; a label in another spelling (case, space) is the same, others are ignored;
repeated rows give repeated rows; without labels there is no row.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import broadcastable, cut, written

WORD = re.compile(r"(?<![\w/+=])[^\W\d_]+(?:-[^\W\d_]+)*(?![\w/+=])")
ALL = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
CUT = re.compile(r"[.!?…;][\"'”»’)\]]*\s")  # sentences end here and at every new line; the pattern begins with a set of characters, which is found fast
TARGET = re.compile(r"\]\([^)]*\)|https?://\S+|<[^>\n]{1,200}>")


#: Characters that only part words, but for those that make a word part of an address or formula (``WORD``), hyphens and underscores.
PARTING = {ord(c): " " for c in "\t\r\f\v!\"#$%&'()*,.:;<>?@[\\]^`{|}~"}
PARTING_TOO = "’“”‘…—–«».,!?:;'\"()#*[]%|"
SENTENCE, TEXT = "|", "||"  # tokens that end a sentence and a text; no other token holds the character


def spaced(text: str) -> tuple[str, int]:
    """A text's tokens, each sentence ended by ``SENTENCE``, and the words that small letters make less of it: neither expression
    looks across space, so that every token can be read alone."""
    if "&" in text:
        text = html.unescape(text)
    if "](" in text or "://" in text or "<" in text:
        text = TARGET.sub(" ", text)
    x = CUT.sub("\n", text).lower()
    less = len(ALL.findall(text)) - len(ALL.findall(x)) if "İ" in text else 0  # its small form is two characters
    if x.isascii():
        x = x.translate(PARTING)
    else:
        for c in PARTING_TOO:
            x = x.replace(c, " ")
    return x.replace("\n", f" {SENTENCE} "), less


def read_token(token: str) -> tuple[list[str], int]:
    """``WORD``'s words of a token and how many ``ALL`` finds."""
    if token.isalpha():
        return [token], 1
    if token.isdecimal() or token.isascii() and token.isalnum():
        return [], 1
    return WORD.findall(token), len(ALL.findall(token))


known_token = lru_cache(1 << 16)(read_token)  # for short tokens, so that what it holds has a bound
SHORT = 40


def words_of(text: str) -> tuple[list[str], int]:
    """``WORD``'s words of a text and how many ``ALL`` finds."""
    x, less = spaced(text)
    read = [read_token(t) for t in x.split() if t != SENTENCE]
    return [w for words, _ in read for w in words], sum(n for _, n in read) + less


def informative(h: np.ndarray) -> np.ndarray:
    """Weight of each term: near 1 if it belongs to one subject, near 0 if all subjects use it alike."""
    if not h.size:
        return np.zeros(len(h))
    k = max(2, h.shape[1])
    rel = h.max(axis=1) / np.maximum(h.sum(axis=1), 1e-300)
    return np.clip((rel - 1 / k) / (1 - 1 / k), 0.02, 1.0) ** 1.5


def solved(h: np.ndarray, much: np.ndarray, terms: np.ndarray, counts: np.ndarray, w: np.ndarray, rounds: int, mask: np.ndarray | None = None) -> np.ndarray:
    """W of rows, H fixed. ``terms`` and their evidence ``much`` stand one after the other, ``counts`` are the rows' terms. Rows of
    about the same length are taken together, filled up with terms without evidence."""
    starts, order = np.cumsum(counts) - counts, np.argsort(counts, kind="stable")
    ranked, out, a = counts[order], np.empty_like(w), 0
    while a < len(order):
        b = np.searchsorted(ranked, ranked[a] + 2 + ranked[a] // 4, "right")
        rows, width = order[a:b], np.arange(ranked[b - 1])
        at = np.minimum(starts[rows][:, None] + width, len(terms) - 1)
        e = np.where(width < ranked[a:b, None], much.take(at), np.float32(0))
        g, x = h.take(terms.take(at), axis=0), w[rows]
        for _ in range(rounds):
            r = e / np.maximum(np.matmul(g, x[:, :, None])[:, :, 0], 1e-30)
            x = x * np.matmul(r[:, None, :], g)[:, 0, :]
            if mask is not None:
                x *= mask[rows]
        out[rows] = x
        a = b
    return out


def divided(terms: np.ndarray, v: np.ndarray | float, h: np.ndarray, counts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(terms, subjects): the terms' counts ``v``, divided among the subjects by the rows' mixtures."""
    q, w = h.take(terms, axis=0), np.repeat(w, counts, axis=0)
    w *= np.repeat(v / np.maximum(np.einsum("ij,ij->i", q, w), 1e-30), w.shape[1]).reshape(w.shape)
    return h * summed(terms, w, len(h))


def summed(terms: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(terms, q[:, k], minlength=size) for k in range(q.shape[1])], axis=1)


class SubjectModel:
    def __init__(self, subjects: list[str], vocabulary: dict[str, int], h: np.ndarray, weight: np.ndarray | None = None):
        self.subjects, self.vocabulary, self.h = subjects, vocabulary, h  # h: terms by components
        self.weight = informative(h) if weight is None else weight

    def among(self, words: list[str]) -> tuple[np.ndarray, SubjectModel]:
        """Positions of words in the vocabulary, -1 for others, and the model with these words for terms."""
        at = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        return at, SubjectModel(self.subjects, {}, self.h[at].astype(np.float32), self.weight[at].astype(np.float32))

    def code(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[list[int]], list[int]]:
        """Of each text the terms of its passages one after the other, how many each passage has, the passages' words, and
        all words."""
        x = Block(block([None] * len(texts), [spaced(t) for t in texts], [None] * len(texts)), 0)
        at, _ = self.among(x.words)
        terms, counts, sizes, owner = x.passages(at)
        of = np.repeat(owner, counts)
        each = range(len(texts))
        return [at[terms[of == n]].tolist() for n in each], [counts[owner == n].tolist() for n in each], [sizes[owner == n].tolist() for n in each], x.totals.tolist()

    def mixtures(self, terms: np.ndarray, counts: np.ndarray, rounds: int = 5) -> np.ndarray:
        """W of passages: evidence of each subject, H fixed."""
        much = self.weight.astype(np.float32).take(terms)
        return solved(self.h.astype(np.float32), much, np.asarray(terms), np.asarray(counts), np.ones((len(counts), len(self.subjects)), np.float32), rounds)

    def counts(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What passages add to the next H: their terms' counts, divided among the subjects."""
        return divided(terms, 1.0, self.h.astype(np.float32), counts, self.mixtures(terms, counts))

    def document_counts(self, terms: np.ndarray, v: np.ndarray, counts: np.ndarray, mask: np.ndarray, rounds: int) -> np.ndarray:
        """What documents add to the next H, their mixtures found from ``mask`` and scaled by it at every update."""
        w = solved(self.h, v * self.weight.take(terms), terms, counts, mask, rounds, mask)
        return divided(terms, v, self.h, counts, w / np.maximum(w.sum(axis=1, keepdims=True), 1e-30))

    def shares(self, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """(texts, subjects): the part of each text's words that its passages' mixtures give to the subject."""
        out = np.zeros((len(totals), len(self.subjects)))
        if len(counts):
            w = self.mixtures(terms, counts)
            np.add.at(out, owner, sizes[:, None] * w / np.maximum(1.0, w.sum(axis=1, keepdims=True)))
        return np.minimum(1.0, out / np.maximum(1, totals)[:, None])


NONE = SubjectModel([], {}, np.ones((0, 0)))

#: A block of documents: how many they are and how many labels they carry; ids, all words and number of passages of each; words
#: of each passage, and the passages' words one after the other by their position in ``words``; of each document the different
#: words and how often each stands there; the block's different words, parted by new lines, and how many of its documents hold
#: each; labels as pairs of document and subject. Numbers that only Python reads are ``packed``, as every update reads them and the
#: JVM would hand over each number of an array by itself.
CODED = (
    "docs int, labelled int, doc_ids array<bigint>, totals binary, parts binary, sizes binary, terms binary, distinct binary, own binary, times binary, "
    "words string, df array<int>, label_doc binary, label binary"
)
BLOCK_DOCS, BLOCK_WORDS = 256, 1 << 16  # a block is full from either on; words as the spaces of ``spaced`` tell


def packed(v: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes that hold the largest; how many these are stands before."""
    v = v.astype(np.min_scalar_type(int(v.max(initial=0))))
    return bytes([v.itemsize]) + v.tobytes()


def unpacked(v: pa.Buffer) -> np.ndarray:
    return np.frombuffer(v, f"u{v[0]}", offset=1).astype(np.int64)


def block(ids: list, texts: list[tuple[str, int]], labels: list) -> pa.RecordBatch:
    """One block of documents, of each its ``spaced`` text."""
    tokens = pc.split_pattern(pa.array(["".join([f"{x} {SENTENCE} {TEXT} " for x, _ in texts])]), " ").values.dictionary_encode()
    each, tokens = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
    end, last = (each.index(x) for x in (SENTENCE, TEXT))
    read = [known_token(t) if len(t) <= SHORT else read_token(t) for t in each]
    held, every = np.array([len(words) for words, _ in read]), np.array([n for _, n in read])
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__  # a new word gets the next position
    flat = np.fromiter(map(index.__getitem__, chain.from_iterable(words for words, _ in read)), np.int64)

    counts, starts = held[tokens], np.cumsum(held) - held
    some = tokens[counts > 0]
    terms = flat[starts[some]] if held.max() < 2 else flat[np.repeat(starts[some] - np.cumsum(held[some]) + held[some], held[some]) + np.arange(counts.sum())]
    ends, texts_end = np.flatnonzero(tokens == end), np.flatnonzero(tokens == last)
    upto = np.cumsum(counts)
    sizes = np.diff(upto[ends], prepend=0)
    parts = np.diff(np.searchsorted(ends[sizes > 0], texts_end), prepend=0)
    totals = np.diff(np.cumsum(every[tokens])[texts_end], prepend=0) + [less for _, less in texts]
    keys, times = np.unique(np.repeat(np.arange(len(texts)), np.diff(upto[texts_end], prepend=0)) * len(index) + terms, return_counts=True)
    doc, own = np.divmod(keys, max(1, len(index)))
    pairs = [(n, k) for n, y in enumerate(labels) for k in y or ()]
    made = {
        "totals": totals, "parts": parts, "sizes": sizes[sizes > 0], "terms": terms, "distinct": np.bincount(doc, minlength=len(texts)), "own": own, "times": times,
        "label_doc": np.array([n for n, _ in pairs], np.int64), "label": np.array([k for _, k in pairs], np.int64),
    }
    row = {k: packed(v) for k, v in made.items()} | {"docs": len(ids), "labelled": len(pairs), "doc_ids": ids, "words": "\n".join(index), "df": np.bincount(own, minlength=len(index))}
    return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in SCHEMA], schema=SCHEMA)


ARROW = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, CODED.split(", "))])


class Block:
    """A row of coded documents, with those columns that were read."""

    def __init__(self, x: pa.RecordBatch, row: int):
        for n, name in enumerate(x.schema.names):
            v = x.column(n)[row]
            setattr(self, name, v.as_py().split("\n") if name == "words" else v.values if name == "doc_ids" else unpacked(v.as_buffer()) if pa.types.is_binary(v.type) else v)

    def passages(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Known words of passages that have any, how many each has, the passages' words and their documents."""
        known = at[self.terms] >= 0
        starts = np.cumsum(self.sizes) - self.sizes
        counts = np.add.reduceat(known, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        some = counts > 0
        return self.terms[known], counts[some], self.sizes[some], np.repeat(np.arange(len(self.parts)), self.parts)[some]

    def documents(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Known different words of documents that have any, how often each stands there, how many each has, and the documents."""
        known = at[self.own] >= 0
        counts = np.bincount(np.repeat(np.arange(len(self.distinct)), self.distinct)[known], minlength=len(self.distinct))
        return self.own[known], self.times[known], counts[counts > 0], np.flatnonzero(counts)

    def labels(self, k: int) -> np.ndarray:
        """(documents, subjects): whether the document carries the label."""
        out = np.zeros((len(self.distinct), k), bool)
        out[self.label_doc, self.label] = True
        return out


def coded(documents: DataFrame, doc_id: str, text: str, labels: DataFrame | None = None) -> DataFrame:
    """Blocks of the documents that have a text; ``labels`` (id, labels) has positions of subjects for some ids."""
    rows = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    if labels is None:
        rows = rows.withColumn("labels", F.lit(None).cast("array<int>"))
    else:
        labels = cut(labels)
        few = broadcastable(labels, F.lit(16) + 4 * F.size("labels"))
        rows = rows.join(F.broadcast(labels) if few else labels, "id", "left").select("id", "text", "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, labels, words = [], [], [], 0
        for b in batches:
            for n, t, y in zip(*[b.column(c).to_pylist() for c in range(3)]):
                ids.append(n)
                labels.append(y)
                texts.append(spaced(t))
                words += texts[-1][0].count(" ")
                if len(ids) >= BLOCK_DOCS or words >= BLOCK_WORDS:
                    yield block(ids, texts, labels)
                    ids, texts, labels, words = [], [], [], 0
        if ids:
            yield block(ids, texts, labels)

    return rows.mapInArrow(run, CODED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for x in batches:
        for row in range(len(x)):
            yield Block(x, row)


def _sum(rows: DataFrame, columns: list[str], model: SubjectModel, add: Callable[[Block, np.ndarray, SubjectModel], np.ndarray]) -> np.ndarray:
    """(terms, subjects): sum over all blocks of what ``add`` gives for a block's words. A task sends one row for each term; the
    vocabulary bounds it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    each = [f"s{k}" for k in range(len(model.subjects))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros(m.h.shape)
        for x in _blocks(batches):
            at, part = m.among(x.words)
            known = at >= 0
            total[at[known]] += add(x, at, part)[known]
        i = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), *[pa.array(total[i, k]) for k in range(len(each))]], names=["i", *each])

    sums = rows.select("words", *columns).mapInArrow(run, ", ".join(["i int", *[f"{c} double" for c in each]])).groupBy("i").agg(*[F.sum(c).alias(c) for c in each]).toArrow()
    out = np.zeros(model.h.shape)
    out[sums.column("i").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in each], axis=1)
    shared.unpersist()
    return out


def _positions(labels: DataFrame, subjects: DataFrame) -> tuple[list[str], DataFrame | None]:
    """The fixed list of areas, and of each labelled id the positions of its labels there."""
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    known = {n.strip().lower(): k for k, n in enumerate(names)}
    if not known:
        return names, None
    at = F.get(F.array(*map(F.lit, known.values())), (F.array_position(F.array(*map(F.lit, known)), F.lower(F.trim("subject"))) - 1).cast("int"))
    return names, labels.select(F.col("doc_id").cast("bigint").alias("id"), at.alias("at")).where("id is not null and at is not null").groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("labels"))


def learned(rows: DataFrame, names: list[str], rounds: int = 30, anchor: float = 0.1, free: int = 1, most: int = 8, inner: int = 3, still: float = 1e-3, seed: int = 3) -> SubjectModel:
    """Factor all coded documents."""
    n, labelled = rows.agg(F.sum("docs"), F.sum("labelled")).first()
    if not names or not labelled:
        return NONE
    least = 3 if n > 300 else 2
    words = rows.select(F.explode(F.arrays_zip(F.split("words", "\n").alias("words"), "df")).alias("x")).groupBy(F.col("x.words").alias("word")).agg(F.sum("x.df").alias("n")).where(F.col("n") >= least).select("word")
    vocabulary = {w: i for i, w in enumerate(sorted(words.toArrow().column(0).to_pylist()))}
    if not vocabulary:
        return NONE
    k = len(names)
    columns = ["distinct", "own", "times", "label_doc", "label"]

    def seeds(x: Block, at: np.ndarray, part: SubjectModel) -> np.ndarray:
        terms, times, counts, docs = x.documents(at)
        return summed(terms, np.repeat(x.labels(k)[docs], counts, axis=0) * np.minimum(times, most)[:, None], len(at))

    def update(anchored: float) -> Callable[[Block, np.ndarray, SubjectModel], np.ndarray]:
        def add(x: Block, at: np.ndarray, part: SubjectModel) -> np.ndarray:
            terms, times, counts, docs = x.documents(at)
            if not len(docs):
                return np.zeros((len(at), k))
            y = x.labels(k)[docs]
            mask = np.where(y | ~y.any(axis=1, keepdims=True), 1.0, anchored).astype(np.float32)
            return part.document_counts(terms, np.minimum(times, most).astype(np.float32), counts, mask, inner)

        return add

    h = np.full((len(vocabulary), k), 1e-2) + np.random.default_rng(seed).random((len(vocabulary), k)) * 1e-3
    h += _sum(rows, columns, SubjectModel(names, vocabulary, h), seeds)
    h /= h.sum(axis=0)
    turn = 0
    while turn < rounds:
        before = h
        h = 1e-2 + _sum(rows, columns, SubjectModel(names, vocabulary, h), update(anchor))
        h /= h.sum(axis=0)
        turn += 1
        if np.abs(h - before).sum(axis=0).max() / 2 <= still:
            break
    for _ in range(free):
        h = 1e-2 + _sum(rows, columns, SubjectModel(names, vocabulary, h), update(1.0))
        h /= h.sum(axis=0)
    return SubjectModel(names, vocabulary, h)


def _kept(rows: DataFrame) -> DataFrame:
    """Written in small row groups, as a reader holds a group of blocks at once."""
    return written(rows, "coded", **{"parquet.block.size": 16 << 20})


def train(documents: DataFrame, doc_id: str, text: str, labels: DataFrame, subjects: DataFrame) -> SubjectModel:
    """The model of all documents, with all their labels."""
    names, at = _positions(labels, subjects)
    return learned(_kept(coded(documents, doc_id, text, at)), names) if at is not None else NONE


def refine(rows: DataFrame, model: SubjectModel) -> SubjectModel:
    """One update of H over all passages of coded documents."""
    if not model.subjects:
        return model

    def add(x: Block, at: np.ndarray, part: SubjectModel) -> np.ndarray:
        terms, counts, _, _ = x.passages(at)
        return part.counts(terms, counts) if len(counts) else np.zeros((len(at), len(part.subjects)))

    h = 1e-2 + _sum(rows, ["parts", "sizes", "terms"], model, add)
    return SubjectModel(model.subjects, model.vocabulary, h / h.sum(axis=0))


def _read(rows: DataFrame, model: SubjectModel, passes: int) -> DataFrame:
    for _ in range(passes):
        model = refine(rows, model)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in _blocks(batches):
            if not m.subjects:
                continue
            at, part = m.among(x.words)
            s = part.shares(*x.passages(at), x.totals)
            i, k = np.nonzero(np.round(s, 6))
            yield pa.RecordBatch.from_arrays([x.doc_ids.take(pa.array(i)), pa.array([m.subjects[j] for j in k], pa.string()), pa.array(s[i, k], pa.float64())], names=["doc_id", "subject", "share"])

    return rows.select("words", "doc_ids", "totals", "parts", "sizes", "terms").mapInArrow(run, "doc_id bigint, subject string, share double")


def mixtures(documents: DataFrame, doc_id: str, text: str, model: SubjectModel, passes: int = 1) -> DataFrame:
    """(doc_id, subject, share): the subjects of each document with the part of its words, those above 0."""
    rows = coded(documents, doc_id, text)
    return _read(_kept(rows) if passes else rows, model, passes)


def factored(documents: DataFrame, doc_id: str, text: str, labels: DataFrame, subjects: DataFrame, passes: int = 1) -> DataFrame:
    """``mixtures`` of the documents by the model of themselves; their texts are read once."""
    names, at = _positions(labels, subjects)
    rows = _kept(coded(documents, doc_id, text, at))
    return _read(rows, learned(rows, names), passes)
