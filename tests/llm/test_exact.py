"""Operators with an exact answer: tokens, near duplicates, site lines, leakage, statistics."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import leakage, neardup, sitelines, textstats, tokens

VOCAB = f"{tokens.DEFAULT_DIR}/byte_bpe_50k.tiktoken"
ODD = [None, "", "   ", "\n\r\n\t", "<|endoftext|> <s> <unk>", "日本語 🎉 é́", "\x00\x01​", "a" * 30_000, "don't WE'LL 123 ½", "  　x", "repeat", "repeat"]


def test_tokens_equal_reference_encoder_and_decode(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(tokens.read_ranks(VOCAB))}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    got = tokens.encode(df, "doc_id", "text")
    rows = {r.doc_id: r.ids for r in got.collect()}
    assert len(rows) == len(ODD)
    for i, t in enumerate(ODD):
        assert rows[i] == ([] if not t else enc.encode_ordinary(t))
    back = {r.doc_id: r.text for r in tokens.decode(got, "doc_id").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_tokens_of_test_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert tokens.encode(d, "doc_id", "text").count() == d.count()


def brute(rows, n, least):
    def sh(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    s = {i: sh(t) for i, t in rows}
    ids = sorted(i for i in s if s[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= least}


def near_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(words) for _ in range(80)] for _ in range(12)]
    for k, b in enumerate(base):
        rows.append((10 * k, " ".join(b)))
        for j in range(1, 6):
            w = list(b)
            for _ in range(3 * j):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((10 * k + j, " ".join(w).upper() if j == 1 else ", ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(90)]  # a hot group of copies
    rows += [(2000 + i, rows[0][1] + f" tail{i} end{i}") for i in range(80)]  # and of near copies, above the bucket
    return [*rows, (5000, None), (5001, ""), (5002, "two words"), (5003, "x " * 5000)]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "id long, markdown string, rep long")
    near = neardup.NearDuplicates(df, "id", "markdown", n=3, threshold=0.5)
    got, clear, all_ = {(r.id_a, r.id_b) for r in near.pairs().collect()}, brute(rows, 3, 0.6), brute(rows, 3, 0.5)
    assert clear <= got <= all_  # at the threshold itself banding misses one pair in some hundreds
    assert len(got) >= 0.995 * len(all_)
    g = {r.id: r.group_id for r in near.groups().collect()}
    assert g[1000] == g[0] == g[2079] == 0 and 5000 not in g and g[5003] == 5003


@pytest.mark.parametrize("others, groups, group", [(400, 6, 5), (400, 6, 16), (35, 1, 10)])
def test_near_duplicates_of_a_hot_group(spark, others, groups, group):
    """Near copies among 1 to 4 % of the rows, or in a small table: the shared phrases are the frequent ones."""
    rng = random.Random(7)
    fresh = lambda k: [f"v{rng.randrange(10**9)}" for _ in range(k)]
    rows = [(i, " ".join(fresh(100))) for i in range(others)]
    for g in range(groups):
        base = fresh(200)
        rows += [(10_000 + 100 * g + k, " ".join([*base, *fresh(90)])) for k in range(group)]  # likeness 0.52
    near = neardup.NearDuplicates(spark.createDataFrame(rows, "id long, markdown string"), "id", "markdown", n=3, threshold=0.5)
    got, all_ = {(r.id_a, r.id_b) for r in near.pairs().collect()}, brute(rows, 3, 0.5)
    assert got <= all_ and len(all_) == groups * group * (group - 1) // 2
    assert len(got) >= 0.98 * len(all_)


def test_near_duplicates_empty(spark):
    near = neardup.NearDuplicates(spark.createDataFrame([], "id long, markdown string"), "id", "markdown")
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_prob_min_hash_estimates_likeness():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:200], rng.integers(1, 2**63, 100, dtype=np.uint64)])
    s = neardup.prob_min_hash([np.unique(a), np.unique(b), np.empty(0, np.uint64)], [np.ones(300), np.ones(300), np.ones(0)], 2048)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05


def test_near_duplicates_in_hot_groups(spark):
    """Recall against brute force where groups of near copies hold half a percent to five percent of all rows, and all pairs
    of a class of copies that is spread over salts."""
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(4000))
    texts = [" ".join(word() for _ in range(90)) for _ in range(1100)]
    for share in (0.005, 0.01, 0.03, 0.05):
        base = [word() for _ in range(90)]
        for _ in range(int(2000 * share)):
            copy = list(base)
            for k in rng.sample(range(90), rng.choice([2, 4, 6, 9])):
                copy[k] = word()
            texts.append(" ".join(copy))
    texts += [texts[0]] * 70
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    near = neardup.NearDuplicates(df, "id", "text", n=3, threshold=0.5, bucket=16)
    got = {(r.id_a, r.id_b) for r in near.pairs().collect()}
    sets = [set(neardup.shingles(t, 3).tolist()) for t in texts]
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.5:
                want.add((i, j))
    assert not got - want and len(got & want) >= 0.995 * len(want) > 3000
    members = {r.id: (r.rep, r.copies) for r in near.members.collect()}
    assert members[0] == (0, 71) and members[len(texts) - 1] == (0, 71) and members[1] == (1, 1)
    exact = neardup.NearDuplicates(df.where("id < 60 or id > 1250"), "id", "text", n=3, threshold=0.5, bucket=16, sigmas=None)
    assert {(r.a, r.b) for r in exact.links.collect()} >= {(a, b) for a, b in got if a > 1250 and b < len(texts) - 70}


def test_site_lines(spark):
    rows = [(i, "https://WWW.a.example:80/p", f"Legal notice {i}!\n\nbody {chr(97 + i)}{chr(98 + i)}q\n{i}{i}\n**LEGAL** notice") for i in range(6)]
    rows += [(9, "http://a.example/x", "other"), (10, None, "Legal notice"), (11, "https://b.example", None), (12, "https://b.example", "")]
    rows += [(100 + i, "https://c.example/x", f"unique {chr(97 + i)}") for i in range(24)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, url string, markdown string, host int")
    got = {(r.id, r.line_no) for r in sitelines.repeated_lines(df, "id", "url", "markdown").collect()}
    assert got == {(i, n) for i in range(6) for n in (1, 5)}
    clean = {r.id: (r.text, r.removed) for r in sitelines.without_repeated_lines(df, "id", "url", "markdown").collect()}
    assert clean[0] == ("\nbody abq\n00", 2) and clean[12] == ("", 0) and 11 not in clean
    e = sitelines.excess(sitelines.keyed(df, "id", "url", "markdown"), decide="llr").collect()
    assert len(e) == 1 and e[0].n == 6 and e[0].q <= 0.05 and e[0].llr > 0
    assert sitelines.repeated_lines(df.limit(0), "id", "url", "markdown").count() == 0


ITEM = "Which of the 41 buckets did Velmo Quiost leave beside the button in Cruepp? Cruul Morhul keeps 57 shovels in a smaller basket and hands every lantern to Velke Morvel."


def test_leakage(spark):
    w = ITEM.split()
    changed = [("zzz" if k % 9 == 4 else x) for k, x in enumerate(w)]
    docs = [
        (1, "Intro text here. " + ITEM + " Outro."),
        (2, "> " + ITEM.lower().replace(" ", "\n> ")),
        (3, " ".join(changed)),
        (4, " ".join(w[:15]) + " some other text stands between the two parts of it " + " ".join(w[15:])),
        (5, " ".join(w[:8])),
        (6, " ".join(x for k in range(0, len(w), 4) for x in [*w[k : k + 4], "aaa", "bbb", "ccc"])),
        (7, "x&nbsp;" + ITEM.replace(" ", "&nbsp;")),
        (8, None), (9, ""), (10, "word " * 20_000 + ITEM), (11, " ".join(reversed(w))), (1, ITEM),
    ]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM), (2, "An entirely different passage of text that nobody ever copied into any of these documents at all."), (3, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (7, 1), (10, 1)]
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(d, "doc_id", "text", items, "item_id", "text", cover=0.0).collect()) == got
    small = leakage.leaks(d, "doc_id", "text", items, "item_id", "text", block_words=10)
    assert sorted((r.doc_id, r.item_id) for r in small.collect()) == got
    assert leakage.leaks(d, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leakage.leaks(d.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def test_leakage_across_a_long_text():
    """Only words around common seeds are aligned; what lies between them changes neither share nor order."""
    item = leakage.word_hashes(ITEM.split())
    far = leakage.word_hashes([f"x{k}" for k in range(50_000)])
    one = np.concatenate([item[:15], far, item[15:]])
    assert len(leakage.around(np.array([0, 50_015]), one, 16)) < 200
    assert leakage.share_held(item, one, 8) == 1.0
    assert leakage.share_held(item, np.concatenate([item[15:], far, item[:15]]), 8) < 1.0
    rng = np.random.default_rng(3)
    for _ in range(200):  # what is left without alignment never reaches the share
        doc = np.where(rng.random(len(item)) < rng.random() * 0.4, far[: len(item)], item)[: rng.integers(4, len(item) + 1)]
        full = leakage.share_held(item, doc, 8)
        assert leakage.share_held(item, doc, 8, 0.5) == full or full < 0.5


def test_leakage_of_a_widely_leaked_part(spark):
    """Half an item in a third of many documents, and an item known only with every sixth word changed."""
    one, two = ([f"{p}{k}" for k in range(40)] for p in "pq")
    half, sixth = " ".join(one[:20]), " ".join("zzz" if k % 6 == 3 else x for k, x in enumerate(two))
    docs = [(i, f"intro {i} {half} outro" if i % 3 == 0 else f"note {i} of nothing") for i in range(6000)] + [(6000 + i, sixth) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(i, 1) for i in range(0, 6000, 3)} | {(6000 + i, 2) for i in range(20)}


def test_statistics_of_chunks_equal_whole(spark):
    """All columns, the kind included, over all pages and odd texts, wherever the text is cut."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "of", "Bericht.", "x\n", "- item\n", "| a | b |\n", "1234,", "Über", "\n\n"]) for _ in range(300)) for _ in range(6)]
    rows = list(enumerate([*texts, None, "", "\n \n", "a" * 5000, "the " * 3000, ' .  " X\t\tb  c. D', "x.  “Y” z.  (W\n- a  b\tc", "one. " * 40 + "Two"]))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "id long, text string, words int")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id + 1000 as id", "markdown as text", "0 as words")
    df = df.union(pages).cache()
    whole = {r.id: tuple(r) for r in textstats.statistics(df, "id", "text").collect()}
    for chunk in (97, 1000):
        assert {r.id: tuple(r) for r in textstats.statistics(df, "id", "text", chunk=chunk).collect()} == whole
    assert set(whole) >= {i for i, t in rows if t is not None} and 6 not in whole
    assert whole[0][1] == len(re.findall(r"[^\W_]+", texts[0]))
    assert whole[8][1:4] == (0, 0, 0)
    for text in (*texts, rows[11][1]):  # cut at every third character, merged in any order
        parts = [textstats.Partial(text[i : i + 3]) for i in range(0, len(text), 3)]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].merge(parts[k + 1])]
        assert textstats.derive(parts[0].finish()) == textstats.derive(textstats.Partial(text).finish())


@pytest.mark.parametrize(
    "text, kind",
    [
        ("The parser reads the file and then it writes a report. It was the first of them.\n" * 3, None),
        ("- Old town\n- Harbour\n- Night train\n- Museum\n", "list"), ("1. Old town (Lum)\n2. Harbour (Tas)\n3. Night train (Wex)\n", "list"),
        ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "table"), ("Lum\t12\t3.5\t2001\nTas\t13\t4.5\t2002\n", "table"), ("Server         123    4.5  ok\nCrawler        77     1.5  -\n", "table"),
        ("var sa=function(e,t){return e[39]^t>>>1};\nvar ta=function(e,t){return e[61]^t>>>22};\n", "junk"), ("I/Z9L4YFSG2buVyW7ZAaf6+elaEE/WWrhGeLWKXvervwIW9fCgfq/9sB6CIR4FkXwGWgcn\n" * 3, "junk"),
        ("01:13:04 [15] 0xc5f8e005 ihKYtR=8948;VNiM=0.5674\n10:07:54 [83] 0xe0c06b7f Mjyy4k=7479;hZSL=0.3422\n", "junk"), ("genome map telescope genome map genome map telescope telescope genome map telescope telescope genome map\n" * 2, "junk"), ("", None),
    ],
)
def test_kinds(text, kind):
    p = textstats.Partial(text).finish()
    assert textstats.derive(p)[12] == kind


def test_operators_take_long_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "the same text of five words")] * 3, "id long, text string")
    assert textstats.statistics(df, "id", "text").count() == 3
    assert df.select(F.count("*")).first()[0] == 3


def test_statistics_of_long_texts_with_repeated_and_null_ids(spark):
    rows = [(1, "the same words " * 40), (1, "the same words " * 40), (1, "other " * 200), (None, "a " * 300), (None, "b " * 400), (2, "short")]
    df = spark.createDataFrame(rows, "id long, text string")
    cols = ["id", "words", "chars"]
    whole, parts = (sorted(map(str, textstats.statistics(df, "id", "text", chunk=c).select(cols).collect())) for c in (65_536, 97))
    assert parts == whole and len(parts) == 6
