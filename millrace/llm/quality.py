"""Quality: perplexity under an interpolated modified Kneser-Ney model of trusted texts, cut at quantiles of each language.

The model is of order four over UTF-16 units, so that an n-gram is one long. Counts of all trusted texts are summed on
Spark; the lower orders, the discounts and the probabilities come from joins of the count tables. For scoring, the
tables are sharded by the two units before the predicted one: all that a position looks up lies in one shard, each
shard is sent to the documents as the small side of a join, and a document's log probability is the sum of what it gets
from each. The bounds come from trusted texts as a model sees them that was not trained on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, small_or_plain, text_batches

ORDER = 4
#: Rows of the model that are sent to the executors at once; a larger model is scored shard by shard.
SHARD_ROWS = 2_000_000
#: Share of a language's trusted texts that lies within its bound, each judged by a model of the other half of them.
QUANTILE = 0.99
_PAD = "\x02" * (ORDER - 1)


def ngrams(text: str) -> np.ndarray:
    """The n-gram that ends at each unit of the text, as a number; the text is preceded by ORDER - 1 marks."""
    u = np.frombuffer((_PAD + text).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    n = len(u) - ORDER + 1
    return (u[:n] << np.uint64(48)) | (u[1 : n + 1] << np.uint64(32)) | (u[2 : n + 2] << np.uint64(16)) | u[3:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """half, gram, n of texts and their halves, counted for each batch."""

    def made(half: int, held: list[np.ndarray]) -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), half), pa.int32()), pa.array(gram.view(np.int64)), pa.array(n)], ["half", "gram", "n"])

    for batch in batches:
        held: dict[int, list[np.ndarray]] = {}
        for value, half in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = held.setdefault(half, [])
            own.append(ngrams(value.as_py() or ""))
            if sum(map(len, own)) > 4_000_000:
                yield made(half, held.pop(half))
        for half, own in held.items():
            yield made(half, own)


def _last(gram: str, units: int) -> str:
    return f"({gram} & {(1 << 16 * units) - 1})" if units < 4 else gram


def model_tables(texts: DataFrame) -> DataFrame:
    """order, key, value: for a gram of ``order`` units its log probability, and for a context (order 10 + units) the log
    of the weight of the lower order. texts: one column, all of them counted."""
    return _tables(texts.select(F.col(texts.columns[0]).alias("text"), F.lit(0).alias("half"))).drop("half")


#: What stands for the halves together.
_ALL = 2


def half_tables(texts: DataFrame) -> DataFrame:
    """model_tables() of each half of the texts and, as half _ALL, of both, made side by side. texts: text, half (0 or 1)."""
    return _tables(texts, together=True)


def _tables(texts: DataFrame, together: bool = False) -> DataFrame:
    counts = {ORDER: cut(texts.select("text", "half").mapInArrow(_counted, "half int, gram long, n long").groupBy("half", "gram").agg(F.sum("n").alias("n")))}
    if together:
        counts[ORDER] = counts[ORDER].unionByName(counts[ORDER].groupBy("gram").agg(F.sum("n").alias("n")).withColumn("half", F.lit(_ALL)))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = cut(counts[k + 1].groupBy("half", F.expr(_last("gram", k)).alias("gram")).agg(F.count("*").alias("n")))
    sizes = {r["half"]: r["n"] for r in counts[1].groupBy("half").agg(F.count("*").alias("n")).collect()}
    per_half = lambda values: F.element_at(F.create_map(*[F.lit(x) for h, v in values.items() for x in (h, float(v))]), F.col("half")) if values else F.lit(None).cast("double")
    unknown, out, lower = 1 / (per_half(sizes) + 1), None, None
    for k in range(1, ORDER + 1):
        found: dict[int, dict[int, int]] = {h: {} for h in sizes}
        for r in counts[k].filter("n <= 4").groupBy("half", "n").agg(F.count("*").alias("c")).collect():
            found[r["half"]][r["n"]] = r["c"]
        d = {h: _discounts(n) for h, n in found.items()}
        first, second, more = (per_half({h: x[i] for h, x in d.items()}) for i in range(3))
        off = F.when(F.col("n") == 1, first).when(F.col("n") == 2, second).otherwise(more)
        rows = counts[k].select("half", "gram", "n", off.alias("off"), F.expr("shiftrightunsigned(gram, 16)").alias("context"), F.expr(_last("gram", max(1, k - 1))).alias("suffix"))
        totals = rows.groupBy("half", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("spare"))
        weights = totals.select("half", "context", "total", (F.col("spare") / F.col("total")).alias("weight"))
        joined = rows.join(weights, ["half", "context"])
        if k == 1:
            p = (F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * unknown
        else:
            joined = joined.join(lower, ["half", "suffix"])
            p = (F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * F.col("p")
        level = cut(joined.select("half", "gram", p.alias("p")))
        part = level.select("half", F.lit(k).alias("order"), F.col("gram").alias("key"), F.log("p").alias("value"))
        part = part.unionByName(weights.select("half", F.lit(10 + k - 1).alias("order"), F.col("context").alias("key"), F.log("weight").alias("value")))
        if k == 1:
            part = part.unionByName(weights.select("half", F.lit(0).alias("order"), F.lit(0).cast("long").alias("key"), F.log(F.col("weight") * unknown).alias("value")))
        out = part if out is None else out.unionByName(part)
        lower = level.select("half", F.col("gram").alias("suffix"), "p")
    return cut(out)


def _discounts(n: dict[int, int]) -> list[float]:
    """What is taken off counts of one, two, and more, from how many grams have counts of one to four."""
    n1, n2, n3, n4 = (max(1, n.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return [min(max(x, 0.05), i - 0.05) for i, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


@dataclass
class Shard:
    """Sorted keys and values of each order; the positions whose two units before fall to this remainder are its own."""

    index: int
    of: int
    tables: dict[int, tuple[np.ndarray, np.ndarray]]

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Of each gram's last unit after the ones before; zero for those of other shards."""
        out = np.zeros(len(grams))
        first, second = (grams >> np.uint64(32)) & np.uint64(0xFFFF), (grams >> np.uint64(16)) & np.uint64(0xFFFF)
        at = np.flatnonzero((first * np.uint64(_SPREAD[0]) + second * np.uint64(_SPREAD[1])) % np.uint64(self.of) == self.index)
        for k in range(ORDER, 0, -1):
            known, value = self._look(k, grams[at] & np.uint64((1 << 16 * k) - 1))
            out[at] += value
            at = at[~known]
            if not len(at):
                return out
            out[at] += self._look(10 + k - 1, (grams[at] & np.uint64((1 << 16 * k) - 1)) >> np.uint64(16))[1]
        out[at] += self.tables[0][1][0] - self.tables[10][1][0]
        return out

    def _look(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held, values = self.tables.get(order, (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(held):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        known = held[at] == keys
        return known, np.where(known, values[at], 0.0)


#: Multipliers of the two units whose sum, modulo the number of shards, names the shard.
_SPREAD = (40503, 30011)


def shards(tables: DataFrame, most: int = SHARD_ROWS) -> Iterator[Shard]:
    """The model in parts of about ``most`` rows; the rows of one unit and of two (orders 0 to 2, 10 and 11) are in each."""
    shared = F.col("order").isin(0, 1, 2, 10, 11)
    of = max(1, -(-tables.filter(~shared).count() // most))
    pair = F.when(F.col("order").isin(3, 4), F.expr("shiftrightunsigned(key, 16) & 4294967295")).otherwise(F.expr("key & 4294967295"))
    unit = F.shiftright(pair, 16) * _SPREAD[0] + pair.bitwiseAND(F.lit(65535)) * _SPREAD[1]
    for i in range(of):
        rows = tables.filter(shared | (unit % of == i)).toPandas()
        parts = {}
        for order, own in rows.groupby("order"):
            key = own["key"].to_numpy(np.int64).view(np.uint64)
            by = np.argsort(key)
            parts[int(order)] = (key[by], own["value"].to_numpy(float)[by])
        yield Shard(i, of, parts)


def log_probabilities(docs: DataFrame, tables: DataFrame, most: int = SHARD_ROWS) -> DataFrame:
    """id, lang, th, n_units, logp of each row. docs: id, lang, text. One pass over the documents for each shard."""
    base = docs.select("id", "lang", F.xxhash64("text").alias("th"), "text")
    kinds = dict(docs.dtypes)
    passes, of = None, 0
    for shard in shards(tables, most):
        shared = docs.sparkSession.sparkContext.broadcast(shard)

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                n, logp = [], []
                for value in batch.column(3):
                    text, total, units = value.as_py() or "", 0.0, 0
                    for at in range(0, len(text), 1 << 20):
                        grams = ngrams(text[max(0, at - 8) : at + (1 << 20)]) if at else ngrams(text[: 1 << 20])
                        if at:
                            grams = grams[len(text[at - 8 : at].encode("utf-16-le", "surrogatepass")) // 2 :]
                        total += float(own.log_probability(grams).sum())
                        units += len(grams)
                    n.append(units)
                    logp.append(total)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(logp, pa.float64())], ["id", "lang", "th", "n_units", "logp"])

        found = base.mapInArrow(score, f"id {kinds['id']}, lang string, th long, n_units long, logp double")
        passes, of = found if passes is None else passes.unionByName(found), of + 1
    if of == 1:
        return passes
    summed = passes.groupBy("id", "lang", "th", "n_units").agg(F.avg("logp").alias("mean"), F.count("*").alias("n"))
    return summed.select("id", "lang", "th", "n_units", (F.col("mean") * of).alias("logp"), F.explode(F.sequence(F.lit(1), (F.col("n") / of).cast("int"))).alias("_copy")).drop("_copy")


def judge(
    docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE
) -> DataFrame:
    """id, lang (``und`` for null), n_units, perplexity, bound and kept of each row. trusted: ids of the texts to learn from.

    The model is of all trusted texts. A text is kept if its perplexity is at most the bound of its language (ties are
    kept): that quantile of the language's trusted texts, or of all trusted texts for a language without any, where
    each half of them, by a hash of the text, is judged by a model of the other. A null or empty text has no perplexity
    and is not kept; a very long one is read in pieces that overlap. Without a trusted text nothing can be judged, the
    perplexity and the bound are null and all is kept. Repeated rows each give a row, an empty table none; other
    columns are neither read nor returned.
    """
    text_batches(docs)
    ids = cut(trusted.select(F.col(trusted.columns[0]).alias("id")).filter("id is not null").distinct())
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    own = base.join(small_or_plain(ids), "id", "left_semi").filter("text <> ''").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    models = half_tables(own.select("text", F.col("half").cast("int").alias("half")))
    of = lambda half: models.filter(F.col("half") == half).drop("half")
    tables = of(_ALL)
    if tables.isEmpty():
        none = F.lit(None).cast("double")
        return base.select(F.col("id").alias(id_col), "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_units"), none.alias("perplexity"), none.alias("bound"), F.lit(True).alias("kept"))
    perplexity = F.when(F.col("n_units") > 0, F.exp(-F.col("logp") / F.col("n_units")))
    scored = cut(log_probabilities(base, tables).withColumn("perplexity", perplexity))
    known = None
    for half in (0, 1):
        other = of(1 - half)
        if not other.isEmpty():
            part = log_probabilities(own.filter(F.col("half") == half).select("id", "lang", "text"), other).select("lang", perplexity.alias("perplexity"))
            known = part if known is None else known.unionByName(part)
    known = cut(known)
    if known.isEmpty():  # all trusted texts are one
        known = scored.join(small_or_plain(ids), "id", "left_semi").filter("perplexity is not null")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    bounds = known.groupBy("lang").agg(at.alias("bound"))
    overall = known.agg(at.alias("overall"))
    return (
        scored.join(small_or_plain(bounds, 10_000), "lang", "left").crossJoin(F.broadcast(overall))  # one row
        .withColumn("bound", F.coalesce("bound", "overall"))
        .select(F.col("id").alias(id_col), "lang", "n_units", "perplexity", "bound", F.coalesce(F.col("perplexity") <= F.col("bound"), F.lit(False)).alias("kept"))
    )
