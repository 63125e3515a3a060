"""Exports of results: flat CSV, JSON, lines of JSON, archives of files, signed bodies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON, one header per file."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str, status: str = "completed") -> None:
    """Rows as lines of JSON without their nulls; a file of its own holds the status line."""
    df.write.mode("overwrite").json(f"{path}/rows")
    df.sparkSession.createDataFrame([(status,)], "status string").coalesce(1).write.mode("overwrite").json(f"{path}/status")


def only(df: DataFrame, fields: list[str]) -> DataFrame:
    """The columns on a list that there are, in the list's order."""
    return df.select(*[c for c in fields if c in df.columns])


def safe_name(url: Column) -> Column:
    """What of an address may stand in a file name: every other character an underscore, 120 at most."""
    x = F.regexp_replace(F.regexp_replace(url, r"https?://", ""), r"[^a-zA-Z0-9._-]", "_")
    x = F.substring(F.regexp_replace(x, r"^_+|_+$", ""), 1, 120)
    return F.when(x == "", F.lit("page")).otherwise(x)


def file_name(url: Column, n: Column) -> Column:
    """Folder of a page in an archive: its number and its address."""
    return F.concat(F.lpad(n.cast("string"), 8, "0"), F.lit("_"), safe_name(url))


def archives(df: DataFrame, name: str = "name", text: str = "text", html: str | None = None, metadata: str | None = None, per: int = 1000) -> DataFrame:
    """(rows, archive binary): ZIP files of at most ``per`` pages each, made on the executors. A page is a folder of its
    content, its source and its metadata (JSON text) where there are any; an index lists the folders."""
    import io
    import json
    import zipfile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4))))
        while part := [r for _, r in zip(range(per), rows)]:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("index.json", json.dumps([{"folder": k, "length": len(v or "")} for k, v, _, _ in part], ensure_ascii=False))
                for k, v, source, about in part:
                    z.writestr(f"{k}/content.md", v or "")
                    if source is not None:
                        z.writestr(f"{k}/content.html", source)
                    if about is not None:
                        z.writestr(f"{k}/metadata.json", about)
            yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["rows", "archive"])

    none = F.lit(None).cast("string")
    cols = [F.col(name).alias("name"), F.col(text).alias("text"), (F.col(html) if html else none).alias("html"), (F.col(metadata) if metadata else none).alias("metadata")]
    return df.select(*cols).mapInArrow(run, "rows bigint, archive binary")


def signed(df: DataFrame, body: str, secret: str) -> DataFrame:
    """``df`` with the hexadecimal HMAC-SHA256 of a column, by the definition on built-in hashes."""
    key = secret.encode()
    key = __import__("hashlib").sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(k ^ x for k in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.col(body).cast("binary")), 256))
    return df.withColumn("signature", F.sha2(F.concat(pad(0x5C), inner), 256))
