"""Crawl traversal over a table of edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth): what can be reached from ``seeds`` (url) within ``max_depth`` links, with its least depth.

    One join and one anti join per level; each level is checkpointed, so a lost executor costs one level and
    the plan doesn't grow. Nothing is collected but whether a level is empty."""
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = level = cut(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        found = edges.join(level.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        level = cut(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return seen


def best_first(edges: DataFrame, seeds: DataFrame, score: Column, batch: int, rounds: int, max_depth: int) -> DataFrame:
    """(url, depth, score, round): each round visits the ``batch`` best pages of the frontier (ties by url, then
    depth) and adds their links. ``score`` is a column of ``url``. A frontier of any size is ranked by a
    distributed top-k."""
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    front = seeds.select("url").distinct().withColumn("depth", F.lit(0)).withColumn("score", score.cast("double"))
    visited = None
    for r in range(rounds):
        now = cut(front.orderBy(F.desc("score"), "url", "depth").limit(batch).withColumn("round", F.lit(r)))
        if not now.limit(1).count():
            break
        visited = now if visited is None else visited.unionByName(now)
        links = edges.join(now.where(F.col("depth") < max_depth).select(F.col("url").alias("src"), "depth"), "src")
        links = links.groupBy(F.col("dst").alias("url")).agg((F.min("depth") + 1).alias("depth")).withColumn("score", score.cast("double"))
        front = front.unionByName(links).join(visited.select("url"), "url", "left_anti").groupBy("url").agg(F.min("depth").alias("depth"), F.max("score").alias("score"))
        front = cut(front)
    return visited


def depth_first(edges: DataFrame, seed_of: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """(site, n, url, depth): order of a depth-first visit of each site from its seed, the first link first.

    Depth-first order is sequential by nature, so a site is one task; its edges are (site, src, dst, pos)."""
    import pandas as pd

    def visit(key, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        links: dict[str, list[str]] = {}
        for x in e.sort_values(["src", "pos"]).itertuples():
            links.setdefault(x.src, []).append(x.dst)
        out, seen = [], set()
        stack = [(u, 0) for u in sorted(s["url"], reverse=True)]
        while stack and len(out) < max_pages:
            u, depth = stack.pop()
            if u in seen:
                continue
            seen.add(u)
            out.append((key[0], len(out), u, depth))
            if depth < max_depth:
                stack += [(v, depth + 1) for v in reversed(links.get(u, [])) if v not in seen]
        return pd.DataFrame(out, columns=["site", "n", "url", "depth"])

    return edges.groupBy("site").cogroup(seed_of.groupBy("site")).applyInPandas(visit, "site string, n int, url string, depth int")


def admitted(found: DataFrame, visited: DataFrame, key: Column, allowed: Column, cap: int, score: Column | None = None, least: float = 0.0) -> DataFrame:
    """(url, key): what enters the frontier of ``found`` (url, pos): allowed, of a score of at least ``least``, not visited,
    first of its key, at most ``cap`` (the frontier's own limit) in order of discovery."""
    x = found.where(allowed if score is None else allowed & (score >= least)).withColumn("key", key).join(visited.select("key"), "key", "left_anti")
    x = x.groupBy("key").agg(F.min_by("url", "pos").alias("url"), F.min("pos").alias("pos"))
    return x.orderBy("pos", "key").limit(cap).select("url", "key")


def frontier_room(visited: DataFrame, queued: DataFrame, max_pages: int) -> int:
    """How many addresses a frontier still takes: twenty for each page of the crawl, less what was seen or waits."""
    return max(0, max_pages * 20 - visited.count() - queued.count())


def save_state(visited: DataFrame, frontier: DataFrame, path: str) -> None:
    """Write what a crawl has visited and what waits, so that it can go on after its end."""
    visited.write.mode("overwrite").parquet(f"{path}/visited")
    frontier.write.mode("overwrite").parquet(f"{path}/frontier")


def load_state(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/visited"), spark.read.parquet(f"{path}/frontier")


def resumed(edges: DataFrame, visited: DataFrame, frontier: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of a breadth-first crawl that goes on from its state: (url, depth) visited, and waiting."""
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    wait = frontier.groupBy("url").agg(F.min("depth").alias("depth")).join(visited.select("url"), "url", "left_anti")
    seen = visited.select("url", "depth")
    level = cut(wait)
    while level.limit(1).count():
        seen = cut(seen.unionByName(level.select("url", "depth")))
        near = level.where(F.col("depth") < max_depth).select(F.col("url").alias("src"), "depth")
        found = edges.join(near, "src").groupBy(F.col("dst").alias("url")).agg((F.min("depth") + 1).alias("depth"))
        level = cut(found.join(seen.select("url"), "url", "left_anti"))
    return seen
