"""Problem 5: lines repeated across one site's documents.

Each row's lines become keys (the hash of their lower-cased letters in order; 0 where a line has none),
distinct inside the row before anything is shuffled. Keys are counted per host with map-side combining,
each host-line is compared with the rest of the corpus by a log-likelihood ratio under false-discovery
control, and the excessive keys return to the rows as one short array per host (a host can't have more than
``lines per row / min_share`` of them). Rows of a hot host are spread over salts, so that no task holds a host.

Which lines are excessive (``decide``): ``share`` is the support rule (at least ``min_rows`` rows and
``min_share`` of the host's rows); ``llr`` asks for significant excess over the other hosts in addition.

Defined results: rows with null text don't count and give no row; a null or host-less URL is the host '';
ties don't occur as no ranking is made; repeated rows count once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.hosts import host
from weftline.session import cut, salted

SALTS = 16


def line_keys(text: Column) -> Column:
    """array<bigint>: a key for each line of ``text``, 0 for a line without letters."""
    letters = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.lower(x), r"\P{L}+", ""))
    return F.transform(letters, lambda x: F.when(x == "", F.lit(0).cast("bigint")).otherwise(F.xxhash64(x)))


def keyed(df: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(id, host, keys): one row for each row with text."""
    return df.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.coalesce(host(url_col), F.lit("")).alias("host"), line_keys(F.col(text_col)).alias("keys")
    )


def line_counts(rows: DataFrame) -> DataFrame:
    """(host, key, n): rows of a host that hold the key; key 0 counts all its rows with text."""
    distinct = F.array_union(F.array(F.lit(0).cast("bigint")), F.array_distinct("keys"))
    return rows.select("host", F.explode(distinct).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def excess(rows: DataFrame, min_rows: int = 3, min_share: float = 0.15, decide: str = "share", fdr: float = 0.05) -> DataFrame:
    """(host, key, n, host_rows, llr, q, excessive): the lines that stand in ``min_rows`` rows of a host or
    more, with the signed log-likelihood ratio of their frequency inside against outside the host and the
    Benjamini-Hochberg value of its chi-square tail.

    The ranks that the correction needs come from counts per rounded ratio (a few thousand bins), not from
    a global sort; a bin takes the rank of its last member, so q is never too small.
    """
    counts = cut(line_counts(rows))
    hosts = counts.where("key = 0").select("host", F.col("n").alias("host_rows"))
    total = counts.where("key = 0").agg(F.sum("n").alias("all_rows"))
    outside = counts.where("key <> 0").groupBy("key").agg(F.sum("n").alias("n_all"))
    seen = counts.where((F.col("key") != 0) & (F.col("n") >= min_rows))
    c = salted(seen, hosts, "host", "key").join(outside, "key").crossJoin(F.broadcast(total))  # one row
    a, m, t = F.col("n").cast("double"), F.col("host_rows").cast("double"), F.col("n_all").cast("double")
    b, big = t - a, F.col("all_rows") - m
    g = 2 * (
        _xlogx(a) + _xlogx(b) + _xlogx(m - a) + _xlogx(big - b) + _xlogx(m + big)
        - _xlogx(m) - _xlogx(big) - _xlogx(a + b) - _xlogx(m + big - a - b)
    )
    more = a * big >= b * m
    llr = F.when(more, F.greatest(g, F.lit(0.0))).otherwise(-F.greatest(g, F.lit(0.0)))
    # Upper tail of chi-square with one degree of freedom: erfc(sqrt(g/2)), by a rational form of relative error 1e-7.
    z = F.sqrt(F.greatest(F.col("llr"), F.lit(0.0)) / 2)
    u = 1 / (1 + 0.5 * z)
    poly = F.lit(0.17087277)
    for k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * u + k
    p = F.when(F.col("llr") > 0, u * F.exp(-z * z + poly)).otherwise(1.0)
    tested = c.withColumn("llr", llr).withColumn("p", p).withColumn("bin", F.round(F.least(F.col("llr"), F.lit(400.0)), 1))
    bins = tested.groupBy("bin").agg(F.count("*").alias("in_bin"), F.max("p").alias("bin_p"))
    # At most 4001 + the bins of negative ratios, which all have p = 1: bounded by the rounding, not by the data.
    bins = bins.groupBy(F.greatest(F.col("bin"), F.lit(-0.1)).alias("bin")).agg(F.sum("in_bin").alias("in_bin"), F.max("bin_p").alias("bin_p"))
    from pyspark.sql import Window

    up = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    q = bins.select("bin", (F.col("bin_p") * F.sum("in_bin").over(every) / F.sum("in_bin").over(up)).alias("raw"))
    q = q.select("bin", F.least(F.lit(1.0), F.min("raw").over(down)).alias("q"))
    enough = F.col("n") >= F.lit(min_share) * F.col("host_rows")
    flag = enough if decide == "share" else enough & (F.col("llr") > 0) & (F.col("q") <= fdr)
    out = tested.withColumn("bin", F.greatest(F.col("bin"), F.lit(-0.1))).join(F.broadcast(q), "bin")
    return out.select("host", "key", "n", "host_rows", "llr", "q", flag.alias("excessive"))


def _with_excess(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """``rows`` with the array of its host's excessive keys; salted, so a hot host is spread."""
    bad = flagged.where("excessive").groupBy("host").agg(F.collect_list("key").alias("bad"))
    return salted(rows, bad, "host", "id", "inner", SALTS)


def repeated_lines(df: DataFrame, id_col: str, url_col: str, text_col: str, **rule) -> DataFrame:
    """(id, line_no): the places of excessive lines, ``line_no`` from 1."""
    rows = cut(keyed(df, id_col, url_col, text_col))
    hit = _with_excess(rows, excess(rows, **rule))
    places = F.filter(
        F.transform("keys", lambda k, i: F.when((k != 0) & F.array_contains(F.col("bad"), k), (i + 1).cast("bigint"))), lambda x: x.isNotNull()
    )
    return hit.select(F.col("id").alias(id_col), F.explode(places).alias("line_no"))


def without_repeated_lines(df: DataFrame, id_col: str, url_col: str, text_col: str, **rule) -> DataFrame:
    """(id, text, removed): each row with text, its other lines joined in their order."""
    bad = repeated_lines(df, id_col, url_col, text_col, **rule).groupBy(id_col).agg(F.collect_set("line_no").alias("gone"))
    kept = df.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text")).join(bad, id_col, "left")
    gone = F.coalesce("gone", F.array().cast("array<bigint>"))
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, (i + 1).cast("bigint")))
    return kept.select(id_col, F.array_join(lines, "\n").alias("text"), F.size(gone).alias("removed"))
