"""Problem 1: the language of each document and of each stretch of it, with a confidence.

A sentence is the average of hashed embeddings of its words' character runs and of the words themselves,
followed by a linear softmax over the languages and a class for what is no language; both layers are trained
together by stochastic gradient descent in numpy. The temperature of the softmax is fitted on held-out pages,
and a sentence whose calibrated probability stays under the rejection threshold has no language (``und``).
The threshold is the lowest at which the held-out sentences that pass are right in ``precision`` of cases.

Training sentences come from pages with a usable label, at most ``per_language`` pages of each (the lowest by
hash of their id). Labels are partly wrong and pages partly mixed: after a first fit the pages whose sentences mostly speak
for another language, and single sentences that do, are left out and the model is fitted again. The class of no language is trained on words drawn at
random: letters, pseudo-Latin filler, and the training words with their letters in another order.

Only running text of the main body is read for stretches: no headings, lists, tables, code, or lines that don't end as
sentences do. Successive sentences of one language form a stretch; a sentence of one word belongs to the stretch before it
(at the beginning, after it); two sentences and ``min_words`` words make it running text. ``documents`` gives every page a language: the one
of most words of its running text, and where there is none that of its main body's lines (headings, lists, tables) and title.

The languages are the eight of ``NAMES``; text in another one is rejected (``und``) or, if close, taken for one of them.

Defined results: null text gives no row; a page without running text has no stretch, but a row among the documents, with
``und`` and confidence 0 where it has no words; of two languages with equally many words the first in the alphabet is the
page's; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.mainbody import Scores

#: The languages with the codes and names that label them.
NAMES = {
    "en": "en eng english anglais englisch inglés inglese inglês engels английский",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão duits немецкий",
    "fr": "fr fra fre french français francais französisch francés francese francês frans французский",
    "es": "es spa spanish español espanol castellano espagnol spanisch spagnolo espanhol spaans испанский",
    "it": "it ita italian italiano italienisch italien italiaans итальянский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese portugees португальский",
    "nl": "nl nld dut dutch nederlands niederländisch néerlandais neerlandés olandese holandês holländisch нидерландский",
    "ru": "ru rus russian русский russisch russe ruso russo",
}
CODES = sorted(NAMES)
NONE = len(CODES)
#: The vocabulary of pseudo-Latin filler.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt "
    "culpa qui officia deserunt mollit anim id est laborum"
).split()

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SPLIT = re.compile(r"(?<=[.!?…])[\"'”»’)\]]*\s+")
ITEM = re.compile(r"\s*(?:[-+*•#|]|\d{1,3}[.)]\s|```|~~~|={3,}|-{3,})")
END = re.compile(r"[.!?…][\"'”»’)\]*_]*\s*$")
LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
CODE = re.compile(r"`[^`]*`")
BUCKETS, DIM = 1 << 14, 16


def named(label: Column) -> Column:
    """The code of the language that a label names, in any spelling and with or without a region; else null."""
    x = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_ (].*)?$", 1)
    pairs = [F.lit(v) for code, names in NAMES.items() for n in names.split() for v in (n, code)]
    return F.element_at(F.create_map(*pairs), x)


def grams(word: str) -> list[int]:
    """Buckets of a word: itself and its character runs of two to four with its ends marked."""
    w = f"<{word}>"
    out = [w] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in out]


def sentences(text: str, p: list[float | None]) -> list[str]:
    """Sentences of the running text among the main-body lines of ``text``."""
    out: list[str] = []
    fenced = False
    for line, v in zip(text.split("\n"), p):
        if line.lstrip(" >")[:3] in ("```", "~~~"):
            fenced = not fenced
            continue
        if v is None or v < 0.5 or fenced:
            continue
        line = line.strip().lstrip("> ")
        if ITEM.match(line) or not END.search(line):
            continue
        line = CODE.sub(" ", LINK.sub(r"\1", line) if "](" in line else line)
        out += [s for s in SPLIT.split(line) if s.strip()]
    return out


class LanguageModel:
    def __init__(self, table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.table, self.bias, self.temperature, self.threshold = table, bias, temperature, threshold
        self.words = self._sums()

    def _sums(self) -> Scores:
        """Sums of the buckets' class scores by word, and at the end their number."""
        return Scores(np.hstack([self.table, np.ones((len(self.table), 1))]), grams)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words = self._sums()

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Class probabilities of sentences given as words; without words all mass is on no language."""
        out = np.zeros((len(texts), NONE + 1))
        out[:, NONE] = 1
        some = [k for k, words in enumerate(texts) if words]
        if some:
            starts = np.cumsum([0] + [len(texts[k]) for k in some[:-1]])
            v = np.add.reduceat(self.words.of([w for k in some for w in texts[k]]).astype(np.float64), starts, axis=0)
            z = (v[:, :-1] / v[:, -1:] + self.bias) / self.temperature
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[some] = z / z.sum(axis=1, keepdims=True)
        return out

    def label(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """(code or ``und``, confidence, words) of each sentence."""
        words = [WORD.findall(t.lower()) for t in texts]
        p = self.scores(words)
        best = p.argmax(axis=1)
        return [
            (CODES[b] if b < NONE and p[k, b] >= self.threshold else "und", float(p[k, b]), len(words[k])) for k, b in enumerate(best)
        ]


def _sgd(x: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM))
    w = rng.normal(0, 0.1, (DIM, NONE + 1))
    bias = np.zeros(NONE + 1)
    ge, gw = np.full((BUCKETS, 1), 1e-3), 1e-3
    sizes = np.bincount(y, minlength=NONE + 1)
    weight = np.sqrt(sizes.max() / np.maximum(sizes, 1)).clip(1, 8)[y]  # rare languages count more
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            i = order[at : at + 64]
            n = np.array([len(x[k]) for k in i])
            flat = np.concatenate([x[k] for k in i])
            own = np.repeat(np.arange(len(i)), n)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            avg = np.add.reduceat(e[flat], starts, axis=0) / n[:, None]
            z = avg @ w + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p *= weight[i, None] / len(i)
            back = (p @ w.T) / n[:, None]
            cells, inv = np.unique(flat, return_inverse=True)
            rank = np.argsort(inv, kind="stable")
            cuts = np.flatnonzero(np.diff(inv[rank], prepend=-1))
            grad = np.add.reduceat(back[own[rank]], cuts, axis=0)
            ge[cells, 0] += (grad**2).mean(axis=1)
            e[cells] -= rate * grad / np.sqrt(ge[cells])
            d = avg.T @ p
            gw += float((d**2).mean())
            w -= rate * d / np.sqrt(gw)
            bias -= 0.1 * p.sum(axis=0)
    return e, w, bias


def fit(pages: list[tuple[str, list[str]]], precision: float = 0.995, epochs: int = 5, rate: float = 0.1, seed: int = 5, noise_pages: int = 200, noise_sentences: int = 6) -> LanguageModel:
    """``pages``: (code, sentences) of labelled pages; a code may be wrong. The noise of the class of no language is made of
    words of the first ``noise_sentences`` sentences of ``noise_pages`` of them."""
    rng = np.random.default_rng(seed)

    def junk(n: int) -> list[list[str]]:
        own = [w for _, s in pages[:noise_pages] for t in s[:noise_sentences] for w in WORD.findall(t.lower())] or LATIN
        made = []
        for k in range(n):
            size = int(rng.integers(4, 24))
            if k % 3 == 0:
                made.append(["".join(map(chr, rng.integers(97, 123, rng.integers(2, 13)))) for _ in range(size)])
            elif k % 3 == 1:
                made.append([LATIN[j] for j in rng.integers(0, len(LATIN), size)])
            else:
                made.append(["".join(rng.permutation(list(own[j]))) for j in rng.integers(0, len(own), size)])
        return made

    def build(rows: list[tuple[str, list[str]]]) -> tuple[list[list[str]], np.ndarray]:
        texts, ys = [], []
        for code, s in rows:
            for t in s:
                words = WORD.findall(t.lower())
                if len(words) >= 3:
                    texts.append(words)
                    ys.append(CODES.index(code))
        noise = junk(max(60, len(texts) // 10))
        return texts + noise, np.array(ys + [NONE] * len(noise))

    def learn(rows: list[tuple[str, list[str]]]) -> LanguageModel:
        texts, y = build(rows)
        rounds = min(4 * epochs, max(epochs, 60_000 // max(1, len(texts))))  # few sentences are seen more often
        e, w, b = _sgd([np.array([g for x in t for g in grams(x)]) for t in texts], y, rounds, rate, seed)
        return LanguageModel(e @ w, b, 1.0, 0.0)

    if not pages:
        return LanguageModel(np.zeros((BUCKETS, NONE + 1)), np.eye(NONE + 1)[NONE] * 9, 1.0, 0.5)
    held = [k % 6 == 5 and len(pages) >= 60 for k in range(len(pages))]
    first = learn([r for r, h in zip(pages, held) if not h])

    def cleaned(rows: list[tuple[str, list[str]]], strict: bool = False) -> list[tuple[str, list[str]]]:
        """Pages that speak for their label, without the sentences that don't. A few pages to calibrate by are cleaned
        strictly, as one with a wrong label would hold the temperature up."""
        out = []
        for code in CODES:
            scored = [(s, first.scores([WORD.findall(t.lower()) for t in s])[:, CODES.index(code)]) for c, s in rows if c == code]
            fits = [x for x in scored if x[1].mean() >= 0.5]
            if not strict and 2 * len(fits) < len(scored):  # a language that the first fit hasn't learned keeps its pages
                out += [(code, s) for s, _ in scored]
            else:
                out += [(code, [t for t, v in zip(s, p) if v >= 0.3]) for s, p in fits]
        return out

    kept = cleaned([r for r, h in zip(pages, held) if not h]) or pages
    model = learn(kept)
    texts, y = build(cleaned([r for r, h in zip(pages, held) if h], True) or kept)
    best = (np.inf, 1.0)
    for t in (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0):
        model.temperature = t
        p = model.scores(texts)[np.arange(len(y)), y]
        best = min(best, (float(-np.log(np.maximum(p, 1e-9)).mean()), t))
    model.temperature = best[1]
    p = model.scores(texts)
    named_ = np.flatnonzero(p.argmax(axis=1) < NONE)
    top, right = p[named_].max(axis=1), p[named_].argmax(axis=1) == y[named_]
    order = np.argsort(-top, kind="stable")
    ok = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
    model.threshold = float(min(0.9, max(0.5, top[order[ok[-1]]]))) if len(ok) else 0.9
    return model


def train(tagged: DataFrame, label: str, per_language: int = 100, per_page: int = 30) -> LanguageModel:
    """Fit on tagged pages (id, p, text, label column): at most ``per_language`` pages of each language, and of each the
    first ``per_page`` sentences. Both bound the sample for fitting only."""
    rows = tagged.select("id", "p", "text", named(F.col(label)).alias("code")).where("code is not null")
    order = Window.partitionBy("code").orderBy(F.xxhash64("id"), "id")
    some = rows.select("id", "code").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    picked = rows.join(F.broadcast(some.select("id")), "id", "left_semi")  # at most per_language ids for each code
    pages = [(r["code"], sentences(r["text"], r["p"])[:per_page]) for r in picked.orderBy(F.xxhash64("id"), "id").collect()]
    return fit([p for p in pages if p[1]])


def stretches(tagged: DataFrame, model: LanguageModel, min_words: int = 16, *extra: str) -> DataFrame:
    """(id, seg_no, lang, confidence, sentences, words, running, extra columns): the stretches of each page."""
    shared = tagged.sparkSession.sparkContext.broadcast(model)
    more = "".join(f", {c} {tagged.schema[c].dataType.simpleString()}" for c in extra)
    seg = "array<struct<seg_no:int,lang:string,confidence:double,sentences:int,words:int,running:boolean>>"
    kind = pa.list_(pa.struct([("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("words", pa.int32()), ("running", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            out = []
            parts = [sentences(text, p) for p, text in zip(x.column(1).to_pylist(), x.column(2).to_pylist())]
            labels = iter(m.label([s for page in parts for s in page]))
            for page in parts:
                segs: list[dict] = []
                every = [next(labels) for _ in page]
                found = [y for y in every if y[2] >= 2]
                k, before = -1, 0
                for lang, conf, n in every:
                    if n < 2:  # says too little of its own
                        if segs:
                            segs[-1]["short"] += n
                        else:
                            before += n
                        continue
                    k += 1
                    if lang == "und" and 0 < k < len(found) - 1 and found[k - 1][0] == found[k + 1][0]:
                        lang = found[k - 1][0]  # one rejected sentence doesn't part a stretch
                    if segs and segs[-1]["lang"] == lang:
                        s = segs[-1]
                        s["confidence"] += conf * n
                        s["sentences"] += 1
                        s["words"] += n
                    else:
                        segs.append({"seg_no": len(segs) + 1, "lang": lang, "confidence": conf * n, "sentences": 1, "words": n, "short": 0})
                if segs:
                    segs[0]["short"] += before
                for s in segs:
                    s["confidence"] = round(s["confidence"] / s["words"], 4)
                    s["words"] += s.pop("short")
                    s["running"] = s["lang"] != "und" and s["sentences"] >= 2 and s["words"] >= min_words
                out.append(segs)
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(out, kind), *(x.column(3 + k) for k in range(len(extra)))], names=["id", "segs", *extra])

    made = tagged.select("id", "p", "text", *extra).mapInArrow(run, f"id bigint, segs {seg}{more}")
    return made.select("id", *extra, F.inline("segs"))


def documents(tagged: DataFrame, model: LanguageModel, title: str = "title", *extra: str) -> DataFrame:
    """(id, lang, confidence, basis, extra columns): a row for every tagged page. ``basis`` is what was read: ``running``
    text, else the ``lines`` of the main body and the title, else ``none``. The confidence is the mean of the words' sentences,
    those of other languages as none."""
    shared = tagged.sparkSession.sparkContext.broadcast(model)
    more = "".join(f", {c} {tagged.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            parts, basis = [], []
            for p, text, head in zip(*(x.column(k).to_pylist() for k in (1, 2, 3))):
                read = sentences(text, p)
                basis.append("running" if read else "lines")
                parts.append(read or [*(line for line, v in zip(text.split("\n"), p) if v is not None and v >= 0.5), head or ""])
            labels = iter(m.label([s for page in parts for s in page]))
            langs, confs = [], []
            for k, page in enumerate(parts):
                words: dict[str, list[float]] = {}
                total = 0
                for lang, conf, n in [next(labels) for _ in page]:
                    total += n
                    w = words.setdefault(lang, [0, 0.0])
                    w[0] += n
                    w[1] += n * conf
                known = [c for c in words if c != "und" and words[c][0]]
                best = min(known, key=lambda c: (-words[c][0], c)) if known else "und"
                langs.append(best)
                confs.append(round(words[best][1] / total, 4) if total else 0.0)
                if not total:
                    basis[k] = "none"
            cols = [x.column(0), pa.array(langs, pa.string()), pa.array(confs, pa.float64()), pa.array(basis, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(x.column(4 + k) for k in range(len(extra)))], names=["id", "lang", "confidence", "basis", *extra])

    return tagged.select("id", "p", "text", title, *extra).mapInArrow(run, f"id bigint, lang string, confidence double, basis string{more}")


def mislabelled(segments: DataFrame, label: str) -> DataFrame:
    """(id, lang): pages whose label names no language or not the one of most of their running text, and pages
    of several languages, with each language of their running text. ``segments`` has the label column."""
    by = segments.where("running").groupBy("id", "lang").agg(F.sum("words").alias("words"), F.first(named(F.col(label)), True).alias("named"))
    page = by.groupBy("id").agg(
        F.min_by("lang", F.struct(-F.col("words"), F.col("lang"))).alias("main"), F.first("named", True).alias("named"), F.collect_list("lang").alias("langs")
    )
    case = F.col("named").isNull() | (F.col("named") != F.col("main")) | (F.size("langs") > 1)
    return page.where(case).select("id", F.explode("langs").alias("lang"))
