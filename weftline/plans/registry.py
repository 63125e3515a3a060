"""All registered queries of the core, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import analytics, dom, flows, lookups, more, pages, texts, urls

MODULES = [urls, analytics, texts, dom, pages, flows, lookups, more]
FLAGSHIP = urls.url_dedup_first


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
