"""SparkSession factory with the settings that the engine assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 200_000


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow; on a cluster pass a larger shuffle_partitions."""
    builder = (
        SparkSession.builder.master(master)
        .appName("weftlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local master may do without one (tests): it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='weftlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: plans stay short, a table that is read often is
    made once, and a lost executor costs no recomputation."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it was counted and has at most bound rows, else as it is. df should be a written table."""
    return F.broadcast(df) if df.count() <= bound else df
