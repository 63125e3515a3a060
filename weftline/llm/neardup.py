"""Problem 4: near-duplicate records by ProbMinHash over word shingles.

1. Each text becomes its set of distinct runs of ``n`` words, as sorted 64-bit hashes; texts with equal
   sets form a class and only the class's lowest id goes on.
2. The likeness asked for counts every shingle once, so every shingle has the same weight. Weights that fall with
   document frequency would spare candidates that only share template phrases, but they lose the links of a group
   of near copies, whose own phrases are the frequent ones.
3. ProbMinHash: every shingle sends exponential arrivals, at a rate equal to its weight, to random
   registers; a register keeps its first arrival, and a shingle stops once its next arrival comes after
   the latest register (early termination). Two signatures agree in a register with the probability
   Jaccard of the weighted sets; with equal weights that's the plain likeness.
4. Bands of registers give candidates. Small buckets are paired directly; members of a bucket above
   ``bucket`` are cut into blocks of ``block`` members, and pairs of blocks are compared in tasks of bounded size, whole
   matrices of signatures at once, that emit only pairs whose signatures agree. Nothing is dropped in either way.
5. Candidates whose signatures agree in too few registers to reach the threshold are left (the bound is
   ``sigmas`` standard deviations below it; at five a pair at the threshold is lost with a probability of 3e-7, and
   ``sigmas=None`` leaves none), the rest are verified exactly on the shingle sets.

The bounded result is ``links`` between class representatives with ``members``; ``pairs`` expands it to all pairs of rows,
with the rows of large classes spread over salts.

Defined results: null texts and texts of fewer than ``n`` words have no shingles and so no partners; equal
likeness needs no tie rule as every pair at or above the threshold is kept; repeated rows with an id of
their own are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, salted, semi, written

WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
WORD_CACHE = 500_000


#: Registers of which a byte is kept for the filter of candidates.
FILTER_BYTES = 160


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = _WordHash()


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` successive words."""
    if not text:
        return np.empty(0, np.uint64)
    words = WORD.findall(text.lower())
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        return np.empty(0, np.uint64)
    s = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            s = mix(s * _M2 + h[k : len(h) - n + 1 + k] + _M1)
    return np.unique(s)


def prob_min_hash(sets: list[np.ndarray], weights: list[np.ndarray], m: int, seed: int = 1) -> np.ndarray:
    """Signatures (len(sets), m) of uint64: the bits of the earliest arrival at each register.

    All sets of a batch go through the arrivals together: round r holds the shingles whose r-th arrival can
    still change a register of their set.
    """
    out = np.full((len(sets), m), np.inf)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return flat.view(np.uint64).reshape(-1, m)
    h = np.concatenate(sets)
    w = np.concatenate(weights).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    t = np.zeros(len(h))
    state = h
    step = np.uint64(seed * int(_M1) & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        while len(state):
            state = mix(state + step)
            u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            t = t - np.log(u) / w
            reg = (mix(state ^ _M3) % np.uint64(m)).astype(np.int64)
            np.minimum.at(flat, owner * m + reg, t)
            last = out.max(axis=1)
            live = t < last[owner]
            state, t, w, owner = state[live], t[live], w[live], owner[live]
    return flat.view(np.uint64).reshape(-1, m)


def shingled(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, sh): rows with at least one shingle and the bytes of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, n) for t in b.column(1).to_pylist()]
            keep = [k for k, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[k].tobytes() for k in keep], pa.binary())], names=["id", "sh"])

    return df.mapInArrow(run, "id bigint, sh binary")


def agreeing(a: list[bytes], b: list[bytes], least: int) -> np.ndarray:
    """Which pairs of signatures agree in ``least`` registers."""
    if not len(a):
        return np.zeros(0, bool)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return (x == y).sum(axis=1) >= least


def signed(texts: DataFrame, n: int, bands: int, width: int) -> DataFrame:
    """(id, key, sig, bands) of the rows with shingles: 128 bits of hash of the set, one byte of each of the first
    registers and a hash per band."""
    import hashlib

    m = bands * width

    def packed(sig: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
        with np.errstate(over="ignore"):
            band = np.tile(mix(np.arange(bands, dtype=np.uint64) + _M3), (len(sig), 1))
            for k in range(width):
                band = mix(band * _M2 + sig[:, k::width] + _M1)
            small = (mix(sig[:, :FILTER_BYTES]) & np.uint64(255)).astype(np.uint8)
        return [x.tobytes() for x in small], list(band.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                ids, texts_ = (b.column(k).slice(at, 256).to_pylist() for k in (0, 1))
                sets = [(i, s) for i, s in ((i, shingles(t, n)) for i, t in zip(ids, texts_)) if len(s)]
                ids, sets_ = [i for i, _ in sets], [s for _, s in sets]
                if not ids:
                    continue
                small, band = packed(prob_min_hash(sets_, [np.ones(len(s)) for s in sets_], m))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets_], pa.binary()),
                        pa.array(small, pa.binary()),
                        pa.array(band, pa.list_(pa.int64())),
                    ],
                    names=["id", "key", "sig", "bands"],
                )

    return texts.mapInArrow(run, "id bigint, key binary, sig binary, bands array<bigint>")


def agreements(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two matrices of signature bytes that agree in ``least`` registers."""
    i, j = [], []
    for at in range(0, len(x), 64):
        same = np.zeros((len(x[at : at + 64]), len(y)), np.uint16)
        for r in range(x.shape[1]):
            same += x[at : at + 64, r, None] == y[None, :, r]
        p, q = np.nonzero(same >= least)
        i.append(p + at)
        j.append(q)
    return np.concatenate(i), np.concatenate(j)


def candidates(sigs: DataFrame, bucket: int, least: int, block: int = 2048) -> DataFrame:
    """(a, b), a < b: distinct pairs that share a band and agree in at least ``least`` registers."""
    flat = sigs.select("id", F.explode("bands").alias("h"))
    sizes = flat.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    flat = cut(flat.join(sizes, "h"))  # a hot bucket's rows: split by AQE's skew join
    small = flat.where(F.col("size") <= bucket).groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    pairs = small.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b").distinct()
    s = sigs.select("id", "sig")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not len(x):
                continue
            keep = pa.array(agreeing(x.column(2).to_pylist(), x.column(3).to_pylist(), least))
            yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep)], names=["a", "b"])

    near = both.select("a", "b", "sa", "sb").mapInArrow(agree, "a bigint, b bigint")

    # Large buckets: blocks of members, pairs of blocks. A member goes to size / block tasks, which compare block x block.
    blocks = F.ceil(F.col("size") / block).cast("int")
    large = flat.where(F.col("size") > bucket).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id").join(s, "id")

    def blockwise(key, pdf):
        import pandas as pd

        left, right = pdf[pdf["own"] == key[1]], pdf[pdf["own"] == key[2]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x, y = (np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), -1) for part in (left, right))
        i, j = agreements(x, y, least)
        p, q = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        out = pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)})
        return out[out["a"] < out["b"]].drop_duplicates()

    hot = large.groupBy("h", "i", "j").applyInPandas(blockwise, "a bigint, b bigint")
    return near.union(hot).distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, likeness): the pairs whose shingle sets reach the threshold, exactly."""
    s = sets.select("id", "sh")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            like = np.zeros(len(x))
            for k, (p, q) in enumerate(zip(x.column(2).to_pylist(), x.column(3).to_pylist())):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both_ = np.concatenate([p, q])
                both_.sort(kind="stable")
                common = int((both_[1:] == both_[:-1]).sum())
                like[k] = common / (len(p) + len(q) - common)
            keep = pa.array(like >= threshold)
            yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep), pa.array(like).filter(keep)], names=["a", "b", "likeness"])

    return both.mapInArrow(run, "a bigint, b bigint, likeness double")


class NearDuplicates:
    """The links of a collection. ``members`` (id, rep, copies) maps every row with shingles to its class of equal
    sets; ``links`` (a, b, likeness) are the pairs of classes at or above the threshold.

    Texts are read twice, for the signatures and the sets of the few candidates, as their shingles take more room
    than they do; nothing of their size is written or shuffled."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int = 5, threshold: float = 0.8, bands: int = 100, width: int = 4, bucket: int = 64, sigmas: float | None = 5.0):
        texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        sigs = written(signed(texts, n, bands, width), "signatures")
        keys = sigs.select("id", "key")
        reps = keys.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
        shared = salted(keys, reps, "key", "id", "left")  # only keys with copies are spread, and a hot one isn't one task's
        self.members = cut(shared.select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies")))
        firsts = semi(sigs, self.members.where("id = rep").select("id"), "id")
        m = min(FILTER_BYTES, bands * width)
        least = 0 if sigmas is None else int(max(1, m * (threshold - sigmas * (threshold * (1 - threshold) / m) ** 0.5)))
        pairs = cut(candidates(firsts, bucket, least))
        ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        sets = written(shingled(semi(texts, ids, "id"), "id", "text", n), "sets")
        self.links = cut(verified(pairs, sets, threshold))

    def pairs(self) -> DataFrame:
        """(id_a, id_b, likeness), id_a < id_b: all pairs of rows, those inside classes included."""
        m = self.members.select("id", "rep")
        a, b = m.toDF("id_a", "a"), m.toDF("id_b", "b")
        across = self.links.join(a, "a").join(b, "b")
        across = across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "likeness")
        # Copies: the rows of a class against each other, those of the right side once for each salt of the left.
        many = self.members.where("copies > 1").select("id", "rep", F.when(F.col("copies") > 64, 16).otherwise(1).alias("salts"))
        x = many.select(F.col("id").alias("id_a"), "rep", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
        y = many.select(F.col("id").alias("id_b"), "rep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        inside = x.join(y, ["rep", "salt"]).where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("likeness"))
        return across.union(inside)

    def groups(self, rounds: int = 30) -> DataFrame:
        """(id, group_id, copies, links): every row with shingles with the lowest id of its connected group, the
        size of its class of copies, and its class's number of links to other classes. Labels spread by
        neighbour minimum and pointer jumping until nothing changes (a few rounds: they halve the distance)."""
        both = cut(self.links.select("a", "b").union(self.links.select("b", "a")))
        label = cut(self.members.where("id = rep").select("id", F.col("id").alias("label")))
        for _ in range(rounds):
            near = both.join(label.toDF("b", "other"), "b").groupBy("a").agg(F.min("other").alias("other"))
            step = label.join(near, label["id"] == near["a"], "left").select("id", F.least("label", "other").alias("label"), F.col("label").alias("old"))
            jump = step.alias("s").join(step.select(F.col("id").alias("j"), F.col("label").alias("far")), F.col("s.label") == F.col("j"))
            new = cut(jump.select("id", F.least("s.label", "far").alias("label"), "old"))
            label = new.select("id", "label")
            if not new.where("label <> old").limit(1).count():
                break
        degree = both.groupBy("a").agg(F.count("*").alias("links"))
        out = self.members.join(label.toDF("rep", "group_id"), "rep").join(degree.toDF("rep", "links"), "rep", "left")
        return out.select("id", "group_id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
