"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: white space is exactly these six characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A set of ids is broadcast only when it was counted and holds at most this many
#: (16 bytes each in the hash relation: 16 MB); larger sets go through a shuffle join.
BROADCAST_IDS = 1_000_000
#: A group with more than this share of all rows is hot: there are fewer than 1 / HOT of them.
HOT = 0.001


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


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.held = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}
        self.n = 0

    def write(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftlake_path = path
        self.held[path] = out
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that no later step reads."""
        path = getattr(df, "_weftlake_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            self.held.pop(path, None)

    def result(self, df: DataFrame) -> DataFrame:
        """df as a written table; all others are removed."""
        out = self.write(df, "result")
        for held in list(self.held.values()):
            if held is not out:
                self.drop(held)
        return out


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (one column doc_id, distinct).

    The ids are counted: a bounded set is broadcast and the texts are not shuffled, a larger
    one is joined through a shuffle on doc_id. Rows with a null doc_id stay.
    """
    return docs.join(counted(ids), "doc_id", "left_anti")


def counted(df: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """df marked for broadcast if it was counted and holds at most bound rows, else as it is."""
    return F.broadcast(df) if df.count() <= bound else df


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row for each group, whose column size counts the group's rows of total.

    A counted, bounded set of groups is broadcast. Of a larger one only the hot groups are (more than HOT
    of all rows each, so fewer than 1 / HOT of them); the rows of the others go through a shuffle join,
    in which no key holds more than that share.
    """
    if groups.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(groups), on)
    hot = groups.filter(F.col(size) > HOT * total)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(groups.filter(F.col(size) <= HOT * total), on))


def array_runs(col: pa.Array, chars: int = 2_000_000, rows: int = 256) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of an Arrow array, of bounded total length where no single text is longer."""
    at = held = 0
    for i, size in enumerate(pc.binary_length(col).to_pylist()):
        if i > at and (held + size > chars or i - at >= rows):
            yield at, col.slice(at, i - at)
            at, held = i, 0
        held += size
    if at < len(col):
        yield at, col.slice(at)


def text_runs(batch: pa.RecordBatch, column: str = "text", chars: int = 2_000_000, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """(first row, whole texts) of runs of an Arrow batch. Only one run at a time is turned into Python strings."""
    for at, texts in array_runs(batch.column(column), chars, rows):
        yield at, texts.to_pylist()


def idle() -> None:
    """Give back what a Python worker no longer holds; it stays alive between tasks, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n
