"""Host of a URL as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST_PATTERN = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?(?:[wW][wW][wW]\.)?([^/?#:]*)"


def host(url: Column | str) -> Column:
    """Lower-cased host without user, port and one leading ``www.``; null for a null URL, '' where there is none."""
    c = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(F.trim(c), HOST_PATTERN, 1))
