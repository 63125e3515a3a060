"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import language, leakage, mainbody, neardup, residue, sitelines, subjects, textstats, tokens
from weftline.session import cut, semi, table, written


def _tagged(spark: SparkSession, sf_dir: str, *extra: str, body: bool = False) -> DataFrame:
    """Tagged pages with further columns of theirs."""
    pages = table(spark, sf_dir, "pages")
    found = cut(mainbody.notices(mainbody.prepared(pages, "page_id", "url", "markdown")))
    rows = mainbody.prepared(pages, "page_id", "url", "markdown", *extra, html_col="html")
    return mainbody.tag(mainbody.with_notices(rows, found), mainbody.train(pages, found), ",".join(extra), body)


def _tagged_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    tables = [("pages", pages, "page_id", "url", "markdown", "html"), ("job_results", table(spark, sf_dir, "job_results"), "id", "url", "markdown", None)]
    return mainbody.tagged_tables(tables, pages)[0]


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each page with language and confidence."""
    tagged = written(_tagged(spark, sf_dir, "language"), "tagged")
    return language.stretches(tagged, language.train(tagged, "language"), 16, "language")


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's language with confidence, those without running text included, and whether its label names it."""
    tagged = written(_tagged(spark, sf_dir, "language", "title"), "tagged")
    docs = language.documents(tagged, language.train(tagged, "language"), "title", "language")
    right = F.coalesce(language.named(F.col("language")) == F.col("lang"), F.lit(False))
    return docs.select(F.col("id").alias("page_id"), "lang", "confidence", "basis", right.alias("label_right"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(p1_segments(spark, sf_dir), "language").withColumnRenamed("id", "page_id")


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's share of residue, its kind and its placeholders."""
    return residue.residue(_tagged(spark, sf_dir, "title", "status_code")).withColumnRenamed("id", "page_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pages(spark, sf_dir).where("found").select("page_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tagged_both(spark, sf_dir)
    return mainbody.furniture(t, "tbl").select("tbl", F.col("id").alias("row_id"), "line_no")


def p3_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every page of both tables."""
    t = _tagged_both(spark, sf_dir)
    return t.select("tbl", F.col("id").alias("row_id"), mainbody.body_text().alias("body"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs().select("id_a", "id_b")


def _near(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, sf_dir, "job_results"), "id", "markdown", n=3, threshold=0.5)


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded form of ``p4_found``: links between representatives of classes of equal texts."""
    return _near(spark, sf_dir).links.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), F.round("likeness", 6).alias("likeness"))


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To ``p4_links``: each row's representative and the number of rows of its class."""
    return _near(spark, sf_dir).members


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its group at the pipeline's own setting (five words, 0.8)."""
    return neardup.NearDuplicates(table(spark, sf_dir, "job_results"), "id", "markdown").groups()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, sf_dir, "job_results"), "id", "url", "markdown")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.without_repeated_lines(table(spark, sf_dir, "job_results"), "id", "url", "markdown")


def p5_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts' repeated lines by significance: log-likelihood ratio and q value of every tested line."""
    rows = sitelines.cut(sitelines.keyed(table(spark, sf_dir, "job_results"), "id", "url", "markdown"))
    e = sitelines.excess(rows, decide="llr")
    return e.select("host", "key", "n", "host_rows", F.round("llr", 3).alias("llr"), F.round("q", 6).alias("q"), "excessive")


def p6_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the whole text of each page, texts above 4,096 characters in chunks, and the part by which the stated
    number of words is off (null where none is stated)."""
    s = textstats.statistics(table(spark, sf_dir, "pages"), "page_id", "markdown", 4096, ("word_count",))
    off = F.abs(F.col("word_count") - F.col("words")) / F.greatest("words", F.lit(1))
    return s.withColumn("count_off", off).drop("word_count").withColumnRenamed("id", "page_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = written(_tagged(spark, sf_dir, "title", "status_code", body=True), "tagged")
    odd = cut(textstats.statistics(tagged, "id", "body").where("kind is not null").select("id", "kind"))
    gone = residue.residue(semi(tagged, odd, "id")).where("found").select("id")
    return odd.join(gone, "id", "left_anti").select(F.col("id").alias("page_id"), "kind")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items that leaked into them, with the share of the item's words held."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return leakage.leaks(d, "doc_id", "text", b, "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of each document with their part of its words."""
    docs = table(spark, sf_dir, "documents")
    return subjects.factored(docs, "doc_id", "text", table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_mixtures(spark, sf_dir).where("share >= 0.25").select("doc_id", "subject")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


_P5 = r"""
with r as (select id, regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)', 1) as host, markdown
           from job_results where markdown is not null),
l as (select id, coalesce(host, '') as host, unnest(string_split(markdown, chr(10))) as line,
             generate_subscripts(string_split(markdown, chr(10)), 1) as line_no from r),
k as (select id, host, line_no, line, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') as key from l),
h as (select coalesce(host, '') as host, count(*) as host_rows from r group by 1),
x as (select host, key, count(distinct id) as n from k where key <> '' group by host, key),
bad as (select x.host, x.key from x join h using (host) where n >= 3 and n >= 0.15 * host_rows)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _P5 + "select k.id, k.line_no from k join bad using (host, key)",
        "p5_clean": _P5
        + """select id, string_agg(case when bad.key is null then line end, chr(10) order by line_no) as text,
                    cast(count(bad.key) as integer) as removed
             from k left join bad using (host, key) group by id""",
    }
