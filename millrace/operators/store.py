"""The tables in a folder of Parquet, in buckets by key: a commit writes the buckets that it touched, and then what makes a version of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.lineage import drop, packed, portion, portions, tidy
from millrace.model import KEY, SOURCES, TABLES
from millrace.operators.merge import State, apply_staged, stage
from millrace.operators.normalize import dead_letters

_COMMITS = "version long, batch_id long, name string, bucket int, at long"
#: What the rows of a table are dealt to buckets by.
_BY = {
    "contacts": ["email"], "accounts": ["name"], "activities": KEY, "ledger": KEY, "cursors": ["source"], "audit": KEY, "dead_letter": KEY,
    "milestones": ["milestone_key"], "milestone_deps": ["milestone_key"], "escalations": ["milestone_key"],
}
#: The bucket of a row of the commits that stands for all of a version's.
_WHOLE = -1

#: Buckets by table; a table that is not named has none.
Buckets = dict[str, list[int]]


class Store:
    """Tables under a path that all executors see. One writer at a time; readers keep the version that they opened.

    A version's files are written first and its rows in ``commits`` last, so a run that fails in between leaves the
    version before as it was. What a failed run wrote is overwritten by the next. The audit is only added to; of the
    other tables a commit may rewrite some buckets alone. ``buckets`` is fixed when the store is made; it bounds how
    much a batch of few keys rewrites, and how many versions a table's files lie in.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _commits(self) -> DataFrame:
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not files.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
            return self.spark.createDataFrame([], _COMMITS)
        return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")

    def _parts(self, version: int) -> dict[str, list[tuple[int, int]]]:
        """For each table its buckets and the versions that wrote them; as many as there are buckets, but for the audit."""
        out: dict[str, list[tuple[int, int]]] = {name: [] for name in TABLES}
        for r in self._commits().filter(F.col("version") == version).collect():
            out[r["name"]].append((r["bucket"], r["at"]))
        return out

    def _bucket(self, name: str, *columns: Column | str) -> Column:
        return F.pmod(F.xxhash64(*(columns or _BY[name])), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The last version; zero before the first commit."""
        return self._commits().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def has_batch(self, batch_id: int) -> bool:
        return not self._commits().filter(F.col("batch_id") == batch_id).isEmpty()

    def read(self, version: int | None = None, only: Buckets | None = None) -> State:
        """The tables of a version; with ``only`` just these buckets of them (all of a table that is not named)."""
        version = self.version() if version is None else version
        parts = self._parts(version) if version else {name: [] for name in TABLES}
        out = {}
        for name, schema in TABLES.items():
            held: dict[int, list[int]] = {}
            for bucket, at in parts[name]:
                held.setdefault(at, []).append(bucket)
            rows = self.spark.createDataFrame([], schema)
            for at, buckets in held.items():
                part = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}/v={at}")
                part = part if _WHOLE in buckets else part.filter(F.col("bucket").isin(buckets))
                part = part.filter(F.col("bucket").isin(only[name])) if only is not None and name in only else part
                rows = rows.unionByName(part.drop("bucket"))
            out[name] = rows
        return out

    def commit(self, state: State, batch_id: int = -1, only: Buckets | None = None, audit: DataFrame | None = None, turns: int = 1) -> int:
        """Write the next version. The tables may be made from those of the last one.

        With ``only``, state holds these buckets of the tables that it names, and all else stays as it is. ``audit`` are
        the rows to add to the audit, in place of a whole one, written in so many ``turns``.
        """
        version, rows = self.version() + 1, []
        before = self._parts(version - 1)
        for name, schema in TABLES.items():
            if name == "audit" and audit is not None:
                self._write(name, audit, version, turns)
                rows += [*((name, *part) for part in before[name]), (name, _WHOLE, version)]
            elif only is None or name == "audit":
                self._write(name, state[name], version)
                rows.append((name, _WHOLE, version))
            else:
                known = {b: at for b, at in before[name]}
                new = set(only.get(name, []))
                if new:
                    self._write(name, state[name], version)
                rows += [(name, b, version if b in new else known.get(b, known.get(_WHOLE))) for b in range(self.buckets) if b in new or b in known or _WHOLE in known]
        table = self.spark.createDataFrame([(version, batch_id, *r) for r in rows], _COMMITS)
        table.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return version

    def _write(self, name: str, df: DataFrame, version: int, turns: int = 1) -> None:
        columns = self.spark.createDataFrame([], TABLES[name]).columns
        for i in range(turns):
            dealt = portion(df.select(*columns), i, turns, *_BY[name]).withColumn("bucket", self._bucket(name)).repartition("bucket", F.pmod(F.hash(*_BY[name]), F.lit(4)))
            writer = dealt.write.mode("append" if i else "overwrite").option("compression", "zstd")
            with tidy(self.spark):
                writer.partitionBy("bucket").parquet(f"{self.path}/{name}/v={version}")

    def touched(self, staged: DataFrame) -> Buckets:
        """The buckets that hold the keys of staged rows; those of the audit only matter for what was recorded once."""
        valid, poison = staged.filter("error is null"), staged.filter("error is not null")
        keys = valid.select(*KEY).unionByName(dead_letters(poison).select(*KEY)).select(F.lit("key").alias("name"), self._bucket("ledger").alias("bucket"))
        for name, column in (("contacts", "contact_email"), ("accounts", "account_name")):
            keys = keys.unionByName(valid.select(F.lit(name).alias("name"), self._bucket(name, column).alias("bucket")))
        found: Buckets = {"key": [], "contacts": [], "accounts": []}
        for r in keys.distinct().collect():  # as many as there are buckets, for each of three
            found[r["name"]].append(r["bucket"])
        of_key = found.pop("key")
        return found | {name: of_key for name in ("activities", "ledger", "dead_letter", "audit")} | {"cursors": list(range(self.buckets))}

    def merge(self, raw: DataFrame, *, now: datetime, attempts: int = 3, sources: tuple[str, ...] | None = SOURCES, batch_id: int = -1) -> DataFrame:
        """A run over raw on the last version, committed; returns the run's counts. Only buckets that hold keys of the batch are read and written."""
        staged, made = stage(raw, sources, attempts), []
        only, turns = self.touched(staged), portions(staged.count())
        state, rows, stats = apply_staged(self.read(only=only), staged, now=now, attempts=attempts, made=made)
        stats = packed(stats)  # as it was before the commit
        self.commit(state, batch_id, only, rows, turns)
        for table in made:
            drop(table)
        return stats
