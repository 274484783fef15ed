"""The corpus pipeline: STAGES turn documents into a training mix, each stage written and reread before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lineage import drop, own_dir
from millrace.llm import decontamination, mixing, secret_scan, simhash, toxicity
from millrace.llm.common import cut, fresh, small_or_plain, table

#: What run() gives cannot be said in SQL (trained models, fingerprints, a schedule); tests/llm holds it against a plain version.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, rejects go.

    Null and empty texts are judged as any other; repeated rows stay or go together. Without labels all stay.
    """
    score, toxic = fresh(docs, "toxicity", "toxic")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return model.score(docs, names=(score, toxic)).filter(F.col(toxic) == 0).select(docs.columns)


def _without(docs: DataFrame, gone: DataFrame, text_hash: str) -> DataFrame:
    """docs without the rows whose doc_id and text (by its hash) are listed; a null id equals a null id. gone: two columns."""
    gone = small_or_plain(gone.toDF("_gone_id", "_gone_hash"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (docs[text_hash] == gone["_gone_hash"]), "left_anti")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays, the one with the smallest id.

    Null and blank texts are copies of each other; a row without an id stays only in a group of such rows. Of several
    texts in a group under the smallest id the one with the smallest hash stays, of repeated rows any one. Rows that
    share an id but no group are judged each for itself.
    """
    found = cut(simhash.near_copies(docs))
    own = F.struct("doc_id", "text_hash")
    first = found.groupBy("group").agg(F.min_by(own, F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
    rows = found.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(first, "group")
    rows = cut(rows.select("doc_id", "text_hash", "n", own.eqNullSafe(F.col("k")).alias("stays")))
    (text_hash,) = fresh(docs, "text_hash")
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    left = _without(hashed, rows.filter("not stays").select("doc_id", "text_hash"), text_hash)
    repeated = cut(rows.filter("stays and n > 1").select("doc_id", "text_hash"))
    if not repeated.isEmpty():
        keys = small_or_plain(repeated.toDF("_kept_id", "_kept_hash"))
        several = left.join(keys, left["doc_id"].eqNullSafe(keys["_kept_id"]) & (left[text_hash] == keys["_kept_hash"]), "left_semi")
        left = _without(left, repeated, text_hash).unionByName(several.dropDuplicates(["doc_id", text_hash]))
    return left.select(docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and blank texts contain none; rows without an id are judged like any other, repeated rows go together, and of
    two texts under one id only the one that contains an item.
    """
    key, text_hash = fresh(docs, "key", "text_hash")
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    keyed = hashed.withColumn(key, F.struct("doc_id", text_hash))
    found = decontamination.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    gone = cut(found.select(F.col(key)["doc_id"], F.col(key)[text_hash]).distinct().toDF("doc_id", "text_hash"))
    return _without(hashed, gone, text_hash).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blanked out of the texts; all documents stay, with n_chars of what is left. A null text stays null and has none."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix to the target weights takes of each document that is left; a null or blank text has size 0 and gives nothing."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("SimHash near-dedup", without_copies),
    ("benchmark decontamination", without_benchmarks),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing each to the shared folder; what a stage gave is deleted when the next is written.

    Without documents, or with null columns only, each stage gives what it says of such rows; lineage.release() deletes the result.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{own_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        drop(docs)
        docs = spark.read.parquet(path)
    return docs
