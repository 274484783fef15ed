"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three letters are hashed to a fixed number of buckets. Document frequencies are counted over all
texts that may be learned from; the weights are fitted by follow-the-regularised-leader with elastic-net penalties on
a bounded sample of each language, and a temperature, fitted on other rows of the sample, calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_batches
from millrace.llm.toxicity import held_out

BITS = 13
BUCKETS = 1 << BITS
#: About so many texts of each language are in the sample.
ROWS_PER_LANGUAGE = 600
#: The weights of all languages are held by the driver and each task; more languages than this are refused.
MAX_LANGUAGES = 1000
_PIECE = 1 << 20
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane, its lower-case letter, or a space if it is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def bucket_counts(text: str) -> np.ndarray:
    """How often the n-grams of a whole text fall into each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), _PIECE):
        points = np.frombuffer(text[max(0, at - 2) : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        m = _letters()[np.minimum(points, 65535)]
        m = np.concatenate([[np.uint32(32)], m, [np.uint32(32)]]).astype(np.uint32)
        m = m[np.concatenate([[True], (m[1:] != 32) | (m[:-1] != 32)])]
        one = m * _MULT[0]
        two = one[:-1] * np.uint32(31) + m[1:] * _MULT[1]
        three = two[:-1] * np.uint32(31) + m[2:] * _MULT[2]
        h = np.concatenate([one, two, three])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        total += np.bincount(h >> np.uint32(32 - BITS), minlength=BUCKETS)
    return total


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / max(float(np.linalg.norm(x)), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many hold each bucket. texts: one column; all are counted, a row per bucket comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                held += bucket_counts(value.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(BUCKETS), -1)), pa.array(np.append(held, n))], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = {r["bucket"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(BUCKETS)], float)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4, seed: int = 5) -> np.ndarray:
    """Weights (buckets and a bias, by class) of a multinomial model. rows: buckets and values of an example, and its class."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(z, n)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        x = np.stack([np.append(tf_idf(bucket_counts(t), self.idf), 1.0) for t in texts])
        s = x @ self.weights / self.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which the classes y are likeliest, on a grid from 1/50 to 20."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.02, 20, 200):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        best = min(best, (float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean()), float(t)))
    return best[1]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model of the languages of the rows that are not held out; None if no such row has a text with a letter.

    The sample takes about ``per_language`` texts of each language, by a hash of the id against its share; what comes
    to the driver is their bucket counts, of fixed width for each of MAX_LANGUAGES at most. Document frequencies are of
    all rows. Null texts and languages are left out, repeated rows count each; with an empty table there is no model.
    """
    text_batches(docs)
    known = docs.filter(~held_out(id_col) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    languages = sorted(sizes)
    total, df = document_frequencies(known.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    share = F.create_map(*[F.lit(v) for name in languages for v in (name, min(1.0, per_language / sizes[name]))])
    draw = F.pmod(F.xxhash64(F.lit(9), "id", F.length("text")), F.lit(1_000_000)) / 1_000_000

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = [], []
            for value in batch.column(0):
                c = bucket_counts(value.as_py())
                at.append(np.flatnonzero(c))
                counts.append(c[at[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(at, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ["lang", "draw", "at", "counts"]
            )

    sample = (
        known.withColumn("draw", draw)
        .filter(F.col("draw") < share[F.col("lang")])
        .select("text", "lang", F.pmod(F.xxhash64(F.lit(10), "id"), F.lit(5)).alias("draw"))
        .mapInArrow(featured, "lang string, draw long, at array<long>, counts array<long>")
        .limit(2 * per_language * len(languages))
        .collect()
    )
    rows = []
    for r in sorted(sample, key=lambda r: (r["lang"], r["draw"], len(r["at"]), r["counts"][:20])):
        at = np.array(r["at"])
        x = np.log1p(np.array(r["counts"], float)) * idf[at]
        rows.append((np.append(at, BUCKETS), np.append(x / max(np.linalg.norm(x), 1e-12), 1.0), languages.index(r["lang"]), r["draw"] == 0))
    train = [r[:3] for r in rows if not r[3]] or [r[:3] for r in rows]
    weights = ftrl(train, len(languages))
    check = [r for r in rows if r[3]] or rows
    logits = np.stack([x @ weights[at] for at, x, _, _ in check])
    return Model(languages, idf, weights, temperature(logits, np.array([r[2] for r in check])))


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score of each row, from the whole text alone.

    ``und`` with score 0 for a null text, one without a letter, or where there was nothing to learn from. Of languages
    that are equally likely the first by code point is taken. Repeated rows each give a row, an empty table none; other
    columns are neither read nor returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets by MAX_LANGUAGES at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, lettered = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            todo = [i for i, has in enumerate(lettered) if has and model is not None]
            for k in range(0, len(todo), 64):
                some = todo[k : k + 64]
                p = model.probabilities([texts[i] for i in some])
                for i, best, value in zip(some, p.argmax(axis=1), p.max(axis=1), strict=True):
                    lang[i], score[i] = model.languages[best], float(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return (
        docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
        .mapInArrow(scan, f"id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")
        .withColumnRenamed("id", id_col)
    )
