"""What the operators of this subpackage share: written intermediate tables, size-checked broadcasts, text patterns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side with at most so many narrow rows is broadcast (some tens of MB); a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of our own only where that is unset."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = f"file://{tempfile.mkdtemp(prefix='spark-hopmill-')}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in Arrow batches of 8 MB rather than the default of 64, unless the session chose a size itself.

    A batch is held by the JVM, in its buffers, and by the Python worker at the same time.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, "8m")


def release() -> None:
    """Give freed memory of a Python worker back to the system: workers live on, and their parts add to an executor's memory."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def reuse() -> None:
    """Let a Python worker keep freed blocks of up to 4 MB for its next arrays, 32 MB in all, until release(): each page mapped anew costs a fault."""
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        for option, size in ((-1, 32 << 20), (-3, 4 << 20)):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD
            ctypes.CDLL(None).mallopt(option, size)


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, and has known sizes. options go to the writer."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (a stashed table, so that its count is read from file footers) marked for broadcast if it has at most limit rows, and BROADCAST_BYTES in its texts and arrays."""
    if df.count() > limit:
        return df
    n = lambda c, of: F.coalesce(of(c), F.lit(0)).cast("long")
    sizes = [n(c, F.octet_length) for c, kind in df.dtypes if kind in ("string", "binary")]
    sizes += [n(F.to_json(F.struct(c)), F.octet_length) if "string" in kind else n(c, F.size) * 8 * (kind.count(":") or 1) for c, kind in df.dtypes if kind.startswith("array")]
    return F.broadcast(df) if not sizes or (df.agg(F.sum(sum(sizes, F.lit(0)))).first()[0] or 0) <= BROADCAST_BYTES else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
