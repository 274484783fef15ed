from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lookup


def scanned(df):
    """The rows that the scan of df gave on, after it was run."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().apply("numOutputRows").value()


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(f"{tmp_path}/ledger")
    spark.range(990).write.parquet(f"{tmp_path}/activities")
    spark.range(0).write.parquet(f"{tmp_path}/audit")
    tables = {name: f"{tmp_path}/{name}" for name in ("ledger", "activities", "audit")}
    counts = lookup.stored_counts(spark, tables)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == 3
    assert {r["table"]: r["n"] for r in counts.collect()} == {"ledger": 1000, "activities": 990, "audit": 0}
    assert tuple(lookup.stored_health(spark, tables["ledger"], tables["activities"]).first()) == (1000, 990, False)
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")  # the caller's session is left alone


def test_one_key_reads_one_row_group(spark, tmp_path):
    n = 400_000
    rows = spark.range(n).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("natural_key"), F.md5(F.col("id").cast("string")).alias("hash"), (F.col("id") % 5).alias("source"))
    lookup.save_by_key(rows, f"{tmp_path}/t", "natural_key", "hash", group_bytes=1 << 20)
    found, read = scanned(lookup.find(spark, f"{tmp_path}/t", natural_key="k00123456"))
    assert [r["source"] for r in found] == [123456 % 5] and 0 < read < n // 10
    by_hash = rows.filter("natural_key = 'k00200000'").first()["hash"]
    found, read = scanned(lookup.find(spark, f"{tmp_path}/t", hash=by_hash))  # not what the table is sorted by: the filters alone leave the others out
    assert [r["natural_key"] for r in found] == ["k00200000"] and 0 < read < n // 5
    assert scanned(lookup.find(spark, f"{tmp_path}/t", hash="0" * 32))[1] < n // 5
    keys = spark.createDataFrame([("k00000007", 2), ("k00300000", 0), ("k00300000", 1), (None, 1)], "natural_key string, source long")
    for most in (1000, 1):
        got = lookup.find_all(spark.read.parquet(f"{tmp_path}/t"), keys, "natural_key", "source", most=most)
        assert sorted(r["natural_key"] for r in got.collect()) == ["k00000007", "k00300000"]
