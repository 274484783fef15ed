"""The ledger as a bucketed table: a batch meets what is known without the ledger being shuffled.

The table is bucketed and sorted by the key, so Spark joins it bucket by bucket with the batch, which alone is dealt out. A merge
gives the same buckets again, each from one of the old and the few rows that landed in it.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lineage import own_dir
from millrace.model import KEY, TABLES
from millrace.operators.merge import applied

#: Rows of a bucket; a table has so many buckets that none is expected to have more, and no fewer than Spark deals a batch into.
BUCKET_ROWS = 5_000_000


def buckets_for(spark: SparkSession, rows: int) -> int:
    return max(-(-rows // BUCKET_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def save_ledger(ledger: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """Write a ledger as a table of that name in the shared folder, in buckets by key, and read it. The name must be new: a version is a table."""
    spark = ledger.sparkSession
    n = buckets or buckets_for(spark, ledger.count())
    rows = ledger.select(*[c.split()[0] for c in TABLES["ledger"].split(", ")])
    rows.write.format("parquet").bucketBy(n, *KEY).sortBy(*KEY).option("path", f"{own_dir(spark)}/tables/{name}").saveAsTable(name)
    return spark.table(name)


def open_ledger(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """The ledger that an earlier session wrote to a folder in so many buckets, as a table of that name."""
    if not re.fullmatch(r"\w+", name) or "'" in path:
        raise ValueError(f"no name or path for a table: {name!r}, {path!r}")
    spark.sql(f"CREATE TABLE {name} ({TABLES['ledger']}) USING parquet CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def merged_ledger(ledger: DataFrame, decided: DataFrame, now: datetime) -> DataFrame:
    """The ledger after the decided rows. What landed is summed up by key first; the old rows stay where they are."""
    at = F.lit(now).cast("timestamp")
    last = F.max_by(F.struct("content_hash", F.col("occurred").alias("occurred_at")), F.struct("occurred", "content_hash"))
    new = applied(decided).groupBy(*KEY).agg(last.alias("_new"), F.max("version").alias("_version"))
    own = lambda new, old: F.coalesce(new, F.col(old)).alias(old)
    met = F.col("_version").isNotNull()
    return ledger.join(new, KEY, "full").select(
        *KEY, own(F.col("_new.content_hash"), "content_hash"), own(F.col("_new.occurred_at"), "occurred_at"), own(F.col("_version"), "version"),
        F.coalesce("first_synced_at", at).alias("first_synced_at"), F.when(met, at).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
    )
