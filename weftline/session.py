"""Session, table and checkpoint helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "jobs pages job_results webhook_deliveries monitor_checks benchmark subjects subject_labels"
).split()


def get_spark(cores: int | str = "*", partitions: int = 8, app: str = "weftline", **conf: str) -> SparkSession:
    """Local session for tests, bench and interactive use; a cluster passes its own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names. A local session without one gets a folder of its process
    (``get_spark`` sets it); on a cluster, where a machine's own folder would lose rows with the machine, it must be set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        d = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and continue from there: the lineage before it is
    not run again, and a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; its folder is the cluster's to clean
        pass


def written(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Like ``cut`` but as Parquet, so later steps can prune columns; ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_remove, spark, path)  # what is written goes with the session's process
    return spark.read.schema(df.schema).parquet(path)


MAX_BROADCAST_IDS = 200_000


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``. Ids are counted first: few (a few MB) are broadcast, so that wide
    rows aren't shuffled; more are joined by key."""
    ids = ids.select(key).distinct()
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


MAX_BROADCAST_BYTES = 32 << 20


def broadcastable(df: DataFrame, row_bytes: Column, limit: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df``, at ``row_bytes`` a row and an allowance, has at most ``limit`` bytes. ``df`` should be cut."""
    size = df.agg(F.sum(row_bytes.cast("bigint") + 32)).first()[0]
    return (size or 0) <= limit


def salted(df: DataFrame, per_key: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``df`` to the one row that ``per_key`` has for each key; a hot key's rows go to ``salts`` tasks by ``spread``."""
    many = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [key, "_salt"], how).drop("_salt")
