"""Sessions and the few things every operator needs from one."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, memory: str = "20g", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster, submit with the cluster's own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that later plans read it and lost executors cost nothing.

    The folder is the cluster's spark.checkpoint.dir. Where that is unset, a session of one process (local[...], as in tests) gets a
    temporary one, which goes when the process ends; a cluster must name a shared one.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
            folder = tempfile.mkdtemp(prefix="kindred-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def parallel(df: DataFrame, factor: int = 1) -> DataFrame:
    """`df` in at least as many partitions as the session has cores, for CPU-heavy steps over a few large files."""
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def broadcast_upto(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """`df` with a broadcast hint if it has at most `rows` rows (counted), else as it is; and which of the two.

    Give it a checkpointed or cached `df`, as the count runs it.
    """
    small = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if small else df), small


def salted_join(many: DataFrame, few: DataFrame, key: str, counts: DataFrame, *, hot_share: float = 1 / 1024, salts: int = 64) -> DataFrame:
    """`many` joined with `few` on `key`, where a key may hold a large part of `many`.

    `counts` has (key, n), the rows of `many` by key; give it checkpointed or cached. Keys with at least a share `hot_share` of all rows are at most
    1 / hot_share, which bounds what is broadcast. Their rows are spread over `salts` parts by a hash of the row, and their rows of
    `few` are repeated for each part; all others join as they are.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") >= max(1, hot_share * total)).select(key, F.lit(salts).alias("__salts")))
    parts = F.coalesce("__salts", F.lit(1))
    spread = many.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("__salts")
    repeated = few.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__salts")
    return spread.join(repeated, [key, "__salt"]).drop("__salt")


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
