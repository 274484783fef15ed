"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon has two parts: a few plain insults, and words and word beginnings that the labelled texts show to go with
the label, counted on Spark. The trees and the calibration are Spark ML's, fitted on other rows than the lexicon.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import SMALL_BATCH_BYTES, cut, first_by_hash, fresh, text_batches

#: Labelled rows that the model is fitted on, at most: the first by a hash of the id.
SAMPLE_ROWS = 12_000
#: Learned terms, at most, and the toxic texts that must hold one.
LEARNED_TERMS, LEAST_SUPPORT = 600, 4
#: Bytes of text that a worker judges at once; the arrays that it needs for them take some 20 times as much.
PART_BYTES = 1 << 20
# Plain insults of the four languages, and words that address the reader.
INSULTS = frozenset(
    "idiot moron stupid loser scum trash worthless pathetic disgusting clown fool jerk dumb "
    "dumm trottel abschaum versager idiota imbécil basura estúpido idiote imbécile abruti ordure crétin".split()
)
YOU = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasii")
_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>«»“”‘’*#%&$_-|~^/\\"
FEATURES = (
    "insult_rate", "insults", "learned_rate", "learned", "learned_weight", "veiled_rate", "you_rate", "near_you",
    "capitals", "shouted", "punctuation", "exclamations", "odd_words", "stretched", "words",
)


def _terms(word: str) -> Iterator[str]:
    """A word, and its beginnings of four to six letters as ``begin*``."""
    if 3 <= len(word) <= 30 and word.isalpha():
        yield word
        for n in (4, 5, 6):
            if len(word) > n:
                yield word[:n] + "*"


@lru_cache(maxsize=1)
def _letter_facts() -> np.ndarray:
    """For each code point of the basic plane what _judged says of it."""
    return np.array([_judged(i) for i in range(1 << 16)], np.int64)


def _judged(point: int) -> tuple[bool, bool, bool]:
    """Whether a code point is a capital, a mark of _EDGE, a letter."""
    c = chr(point)
    return c.isupper(), c in _EDGE, c.isalpha()


def _points(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, each word followed by a space, and where each word begins."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
    points = np.frombuffer(f"{joined} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words)) + 1)]).astype(np.int64)


def _per_word(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[begin[1:]] - sums[begin[:-1]]


#: What is known of a word, by column: insult, hit of any kind, form of address, hit of a learned term, veiled insult, odd, shouted,
#: stretched; capitals, marks and letters in it.
_FACTS = 11


def word_facts(raw: pa.StringArray, learned: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """The facts of different words (a row each), and the weight of the best learned term of each."""
    words = pc.utf8_trim(raw, characters=_EDGE)
    low = pc.utf8_lower(words)
    alpha = np.asarray(pc.utf8_is_alpha(low))
    insult = np.asarray(pc.is_in(low, pa.array(sorted(INSULTS)))) & alpha
    odd, veiled, spelt = np.zeros(len(raw), bool), np.zeros(len(raw), bool), low.filter(pa.array(~alpha)).to_pylist()
    for k, i in enumerate(np.flatnonzero(~alpha)):
        plain = "".join(c for c in spelt[k].translate(_LEET) if c.isalpha())
        odd[i] = any(map(str.isalpha, spelt[k]))
        veiled[i] = odd[i] and plain in INSULTS
        spelt[k] = plain if odd[i] else spelt[k]
    best, low = np.zeros(len(raw)), pc.replace_with_mask(low, pa.array(~alpha), pa.array(spelt, pa.string()))
    if learned:
        terms, weights = pa.array(list(learned)), np.array([*learned.values(), 0.0])
        for n in (0, 4, 5, 6):
            begun = low if not n else pc.binary_join_element_wise(pc.utf8_slice_codeunits(low, 0, n), "*", "")
            best = np.maximum(best, weights[np.asarray(pc.fill_null(pc.index_in(begun, terms), len(learned)))])
    facts = np.zeros((len(raw), _FACTS), np.int64)
    facts[:, 0], facts[:, 4], facts[:, 5] = insult, veiled, odd
    facts[:, 1], facts[:, 3] = insult | veiled | (best > 0), best > 0
    facts[:, 2] = np.asarray(pc.is_in(low, pa.array(sorted(YOU))))
    facts[:, 6] = np.asarray(pc.utf8_is_upper(words)) & (np.asarray(pc.utf8_length(words)) > 2)
    points, begin = _points(low)
    same = points[1:] == points[:-1]
    facts[:, 7] = _per_word(np.concatenate([same[1:] & same[:-1], np.zeros(min(2, len(points)), bool)]), begin) > 0
    points, begin = _points(raw)
    held = _letter_facts()[np.minimum(points, 65535)]
    for i in np.flatnonzero(points > 65535):
        held[i] = _judged(int(points[i]))
    for k in range(3):
        facts[:, 8 + k] = _per_word(held[:, k], begin)
    return facts, best


def _parts(texts: pa.Array) -> list[pa.Array]:
    """The texts in runs of some PART_BYTES; a longer text is never cut."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    edges = [0, *(np.flatnonzero(np.diff(ends // PART_BYTES)) + 1).tolist(), len(texts)]
    return [texts[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def features(texts: pa.Array, learned: dict[str, float]) -> np.ndarray:
    """Dense features of whole texts, a row each; all zero for a null or blank one. What it holds besides them is bounded by a part of the texts."""
    return np.concatenate([_part_features(part, learned) for part in _parts(texts)])


def _part_features(texts: pa.Array, learned: dict[str, float]) -> np.ndarray:
    """Each different word of the texts is judged once."""
    texts = pc.fill_null(texts, "")
    out = np.zeros((len(texts), len(FEATURES)))
    listed = pc.utf8_split_whitespace(texts)
    begin = np.asarray(listed.offsets).astype(np.int64)
    coded = listed.flatten().dictionary_encode()
    if not len(coded):
        return out
    begin, code = begin - begin[0], np.asarray(coded.indices)
    facts, weight = word_facts(coded.dictionary, learned)
    blank = np.asarray(pc.equal(coded.dictionary, ""))  # before and after the white space at the ends of a text
    n = _per_word(~blank[code], begin)
    some, div = n > 0, np.maximum(n, 1)
    insults, _, you, known, veiled, odd, shouted, stretched, capitals, marks, letters = (_per_word(facts[code, k], begin) for k in range(_FACTS))
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    at = np.arange(len(code)) + 16 * doc  # no word is near one of another text
    hits, called = at[facts[code, 1] > 0], facts[code, 2] > 0
    first = np.searchsorted(hits, at[called] - 5)
    met = (np.append(hits, np.iinfo(np.int64).max)[first] <= at[called] + 5) if len(hits) else np.zeros(called.sum(), bool)
    near = np.bincount(doc[called][met], minlength=len(texts))
    best = np.zeros(len(texts))
    np.maximum.at(best, doc[facts[code, 3] > 0], weight[code[facts[code, 3] > 0]])
    length = np.maximum(np.asarray(pc.utf8_length(texts)), 1)
    columns = (
        insults / div, np.log1p(insults), known / div, np.log1p(known), best, veiled / div, you / div, near / div,
        capitals / np.maximum(letters, 1), shouted / div, marks / length, np.asarray(pc.count_substring(texts, "!")) / length,
        odd / div, stretched / div, np.log1p(n),
    )
    for k, column in enumerate(columns):
        out[:, k] = np.where(some, column, 0.0)
    return out


def feature_column(text: str, learned: dict[str, float]) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def made(texts: pa.Array) -> pa.Array:
        held = features(texts, learned)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(FEATURES), pa.int32()), pa.array(held.ravel()))

    return made(F.col(text))


def learn_terms(sample: DataFrame, most: int = LEARNED_TERMS) -> dict[str, float]:
    """Terms that go with the label, by smoothed log odds. sample: text, toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w.strip(_EDGE).lower() for w in _WORD.findall(text or "")}
                held[int(toxic)].update({t for w in words for t in _terms(w)})
            terms = list(held[0].keys() | held[1].keys())
            counts = [pa.array([h[t] for t in terms], pa.int64()) for h in (held[1], held[0])]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *counts], ["term", "toxic", "clean"])

    n = sample.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = n["toxic"] or 0, n["n"] - (n["toxic"] or 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    top = (
        sample.select("text", "toxic").mapInArrow(count, "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= LEAST_SUPPORT)
        .withColumn("odds", odds)
        .filter("odds > 2.0")
        .orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term")
        .limit(most)
    )
    return {r["term"]: float(r["odds"]) for r in top.collect()}


@dataclass
class Model:
    """What fit() found. trees is None where the labelled rows do not hold both labels; rate is then every score."""

    learned: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float

    def score(self, docs: DataFrame, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
        """docs with two more columns: the score (0 to 1), and 1 where it is at least 0.5, else 0.

        Null and empty texts are scored like any other, repeated rows each; all columns of docs stay as they are, and
        one that has a result's name is refused.
        """
        if clash := set(names) & set(docs.columns):
            raise ValueError(f"these names are results: {sorted(clash)}")
        score, predicted = names
        if self.trees is None:
            return docs.withColumn(score, F.lit(self.rate)).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
        made, margin, probability, prediction, raw, calibrated = fresh(docs, "features", "margin", "probability", "prediction", "raw", "calibrated")
        trees, calibration = self.trees.copy(), self.calibration.copy()
        trees.setFeaturesCol(made).setRawPredictionCol(margin).setProbabilityCol(probability).setPredictionCol(prediction)
        calibration.setFeaturesCol(raw).setPredictionCol(calibrated)
        held = trees.transform(docs.withColumn(made, array_to_vector(feature_column(text, self.learned))))
        scored = calibration.transform(held.withColumn(raw, vector_to_array(probability)[1]))
        scored = scored.withColumn(score, F.least(F.greatest(calibrated, F.lit(0.0)), F.lit(1.0)))
        return scored.withColumn(predicted, (F.col(score) >= 0.5).cast("int")).select(*docs.columns, score, predicted)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out, chosen by a hash of the id.

    A document with several labels counts as toxic if one says so; null labels and labels without a document are left
    out; repeated documents count each. Without documents or labels the model gives every text the same score. The
    sampled ids (a fixed number) are broadcast, so the documents are read once and not shuffled.
    """
    text_batches(docs, SMALL_BATCH_BYTES)
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    chosen = first_by_hash(cut(known.withColumn("_h", F.xxhash64(F.lit(3), "_id"))), "_h", rows)
    sample = cut(
        docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic", F.pmod("_h", F.lit(10)).alias("part"))
    )
    learned = learn_terms(sample.filter("part < 4"))
    seen = sample.filter("part >= 4").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    rate = (seen["toxic"] or 0) / seen["n"] if seen["n"] else 0.0
    if not 0 < rate < 1:
        return Model(learned, None, None, rate)
    made = cut(sample.filter("part >= 4").select("part", "toxic", feature_column("text", learned).alias("f"))).select(
        "part", F.col("toxic").cast("double").alias("label"), array_to_vector("f").alias("_features")
    )
    trees = GBTClassifier(
        featuresCol="_features", labelCol="label", predictionCol="_prediction", maxIter=20, maxDepth=4, stepSize=0.3, maxBins=32, seed=11
    ).fit(made.filter("part < 8").coalesce(4))
    trees.setRawPredictionCol("_margin").setProbabilityCol("_probability")
    raw = trees.transform(made.filter("part >= 8")).select(vector_to_array("_probability")[1].alias("_raw"), "label")
    if raw.isEmpty():
        raw = trees.transform(made).select(vector_to_array("_probability")[1].alias("_raw"), "label")
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated").fit(raw.coalesce(1))
    return Model(learned, trees, calibration, rate)
