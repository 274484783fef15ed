"""Cutting lineage through the shared folder, and broadcasts behind a check of their size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be sent whole to every executor.
BROADCAST_ROWS = 200_000
#: Rows of which a merge shuffles no more at a time, for the disk that it takes.
PORTION_ROWS = 1 << 23
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it. Only a session without executors of its own may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def own_dir(spark: SparkSession) -> str:
    """Where this application writes what it cuts, inside the shared folder."""
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"


def _at(spark: SparkSession, path: str):
    """A path, and the file system that it is in."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared folder, if it is there."""
    found, files = _at(spark, path)
    files.delete(found, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder in the shared folder another name; without one at that path an empty folder is made."""
    found, files = _at(spark, path)
    target, _ = _at(spark, to)
    files.mkdirs(target.getParent())
    if not (files.rename(found, target) if files.exists(found) else files.mkdirs(target)):
        raise OSError(f"{path} could not be moved to {to}")


def release(spark: SparkSession) -> None:
    """Delete what this application has cut so far; call it when the results made of it are written."""
    delete(spark, own_dir(spark))


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, what a write has shuffled is deleted when the write ends; else it stays on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to a table in the shared folder and read it again: later work neither repeats it nor loses it with an executor."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(path: str, *parts: DataFrame) -> None:
    """Write parts to one folder, one after the other, in little space (Zstandard halves hashes in hex). No more is on disk beside it than what one part shuffles."""
    with tidy(parts[0].sparkSession):
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(path)


def packed(*parts: DataFrame) -> DataFrame:
    """cut() of all parts as one table, by pack()."""
    spark = parts[0].sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    pack(path, *parts)
    return spark.read.schema(parts[0].schema).parquet(path)


def portions(rows: int) -> int:
    """Into how many parts a table of so many rows is taken that is shuffled whole."""
    return max(1, -(-rows // PORTION_ROWS))


def portion(df: DataFrame, i: int, n: int, *by: str) -> DataFrame:
    """The i-th of n parts of df that hold all rows of a key together."""
    return df if n == 1 else df.filter(F.pmod(F.xxhash64(*by), F.lit(n)) == i)


def drop(df: DataFrame) -> None:
    """Delete the table that ``cut`` gave, when all that is made of it is written; other tables are left alone."""
    spark = df.sparkSession
    own = own_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in folder:
            delete(spark, folder)


def small_or_plain(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to have few rows; else as it is, so that Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
