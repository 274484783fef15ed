"""Stored tables that answer from what their files say of themselves: counts from footers, and single keys from few row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group of a table that is read by key; the less, the fewer rows are read for one.
GROUP_BYTES = 8 << 20


def _counting(spark: SparkSession) -> SparkSession:
    """A session beside the given one in which Parquet answers counts, minima and maxima from the footers of files."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def stored_counts(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Rows of each table, by its name and folder, without reading a row."""
    own, out = _counting(spark), None
    for name in sorted(tables):
        part = own.read.parquet(tables[name]).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("table").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))  # the count of a table without files of rows comes as null


def stored_health(spark: SparkSession, ledger: str, activities: str) -> DataFrame:
    """One row: rows of the ledger and of the activities by their footers, and whether these agree. Which keys are apart is for metrics.health()."""
    counts = stored_counts(spark, {"ledger": ledger, "activities": activities})
    of = lambda name: F.coalesce(F.sum(F.when(F.col("table") == name, F.col("n"))), F.lit(0))
    return counts.agg(of("ledger").alias("ledger"), of("activities").alias("activities"), (of("ledger") == of("activities")).alias("healthy"))


def save_by_key(df: DataFrame, path: str, *keys: str, rows: int | None = None, group_bytes: int = GROUP_BYTES) -> None:
    """Write df so that ``find`` reads little: dealt by range of the keys and sorted by them, with a Bloom filter of each key in every row group.

    The bounds of a row group leave out most others for the first key; the Bloom filters do for the rest, and for keys within the bounds that are not there.
    ``rows``: how many different keys a row group may have, for the size of its filters.
    """
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("parquet.block.size", group_bytes)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", rows or max(1000, group_bytes // 64))
    writer.parquet(path)


def find(spark: SparkSession, path: str, **keys: object) -> DataFrame:
    """The rows that have the keys; only row groups are read that may hold them."""
    out = spark.read.parquet(path)
    for name, value in keys.items():
        out = out.filter(F.col(name) == F.lit(value))
    return out


def find_all(df: DataFrame, keys: DataFrame, *names: str, most: int = 1000) -> DataFrame:
    """The rows of a stored table that have one of the keys. Up to ``most`` of them are told to the scan, so that row groups without any are left out; more are joined."""
    wanted = keys.select(*names).distinct()
    listed = wanted.limit(most + 1).collect()
    if len(listed) > most:
        return df.join(wanted, list(names), "left_semi")
    first = sorted({r[0] for r in listed if r[0] is not None})
    return df.filter(F.col(names[0]).isin(first)).join(F.broadcast(wanted), list(names), "left_semi")
