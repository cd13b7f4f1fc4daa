"""What several of these operators need: tables, the shared folder, ASCII text rules."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word and line rules here, space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Only where the session names none and everything runs on this machine, as in local tests, is one made
    here; on a cluster that is an error, for executors don't share the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="eocatalog-")
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The rows of df, written to the shared folder and read from there; drop() takes the table away.

    This cuts lineage: a lost executor costs the tasks that it ran, not the plan before.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def materialise_by(df: DataFrame, label: str, column: str, values: list[int], compression: str = "snappy") -> dict[int, DataFrame]:
    """Like materialise(), in one pass a table for each of a few values of a column, which drop() takes away one by one."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, str(len(values)))  # a file for each value side by side in a task, so rows needn't be sorted
    try:
        df.write.partitionBy(column).parquet(path, compression=compression)
    finally:
        spark.conf.set(writers, before)
    out, schema = {}, df.drop(column).schema
    for value in values:
        at = f"{path}/{column}={value}"
        there = spark._jvm.org.apache.hadoop.fs.Path(at)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(there)  # a value without rows has no folder yet
        out[value] = spark.read.schema(schema).parquet(at)
        out[value]._scratch_path = at
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets the driver's JVM find shuffles that no plan refers to any more, so that Spark's cleaner deletes their files.

    The plan that ran last is referred to until listeners have been told of its end, so it takes a second look.
    """
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.3)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote and that nothing will read again."""
    for t in tables:
        delete(t.sparkSession, t._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Hadoop's file system, whatever the scheme of its path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def file_system(path: str):
    """pyarrow's file system and the path in it. Hadoop's name of S3 is one that pyarrow doesn't know."""
    import pyarrow.fs as pfs

    scheme, sep, rest = path.partition("://")
    return pfs.FileSystem.from_uri(f"s3{sep}{rest}" if scheme in ("s3a", "s3n") else path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows in what runs inside: texts are long, and batches are copied."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: glibc's mallopt: what is given back to the system at the heap's end, and blocks that are mapped apart.
_TRIM, _MAPPED = -1, -3


def hold_memory() -> None:
    """Until release_memory() what a task frees stays with its process, instead of being mapped anew for each large array."""
    import ctypes

    with contextlib.suppress(AttributeError, OSError):  # glibc only
        libc = ctypes.CDLL(None)
        libc.mallopt(_MAPPED, 32 << 20)
        libc.mallopt(_TRIM, 1 << 30)


def release_memory() -> None:
    """Gives memory that a task has freed back to the system; Python workers live on for other tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        libc = ctypes.CDLL(None)
        libc.malloc_trim(0)
        libc.mallopt(_TRIM, 64 << 20)  # as much as glibc comes to by itself where large blocks are freed


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast built-in."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_RE), "")


def carried(docs: DataFrame, added: list[str]) -> list[str]:
    """The columns of docs that an operator carries along: those without the name of an added one."""
    taken = {a.lower() for a in added}
    return [n for n in docs.columns if n.lower() not in taken]
