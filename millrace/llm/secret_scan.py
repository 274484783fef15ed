"""Secret scans: patterns that name credentials, and formats learned from what they find.

The credentials that the patterns match are labelled examples of their kind. From a bounded sample of each kind a
prefix tree is built, states whose continuations do not differ significantly are merged (a Hoeffding test on every
pair, carried down the tree), and the automaton that remains gives the probability of a text of that format. Every
other token is scored by how much likelier a format makes it than ordinary words do, whose letters follow each other as
counted over the different tokens of all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, first_by_hash, text_batches

# The kinds of the contract in their order, with their patterns.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more
#: What is scored: runs of the letters that credentials are made of, long enough to tell.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
_ANY_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Examples of a kind that its automaton is learned from, at most, their length, and the fewest that make one.
SAMPLE, LONGEST, FEWEST = 400, 256, 20
#: How many tokens stand against one bare credential, as assumed beforehand; the share of a kind's examples that may be shorter than
#: a hit; and by how many deviations a hit may be less likely, letter for letter, than the mean of the examples.
ODDS, SHORTER, DEVIATIONS = 1e6, 0.01, 4.0
#: Tokens whose score a task remembers, before it begins anew.
MEMO_TOKENS = 200_000
_CLASS = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")})
_SIZE = {"0": 10, "a": 6, "g": 20, "A": 26}
_FLOOR, _END = 1e-4, "end"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIDE = len(_LETTERS) + 1  # 0 stands for the edge of a token


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of each match that is long enough, by start and then kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in _KEYS):
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[tuple[str, int, int, int]]) -> Iterator[tuple[int, int]]:
    """The tokens of the stretches that the spans leave free. taken: by start."""
    at = 0
    for _, start, end, _ in [*taken, ("", len(text), len(text), 0)]:
        if start > at:
            for m in TOKEN.finditer(text, at, start):
                yield m.span()
        at = max(at, end)


class Automaton:
    """A probabilistic automaton over character classes: per state how often it was passed, ended, and left by each symbol."""

    def __init__(self) -> None:
        self.passed, self.ended, self.to, self.times = [0], [0], [{}], [{}]

    @classmethod
    def learned(cls, words: list[str], alpha: float = 0.05) -> Automaton:
        own = cls()
        for word in words:
            state = 0
            own.passed[0] += 1
            for c in word.translate(_CLASS):
                if c not in own.to[state]:
                    own.to[state][c] = len(own.passed)
                    own.times[state][c] = 0
                    own.passed.append(0)
                    own.ended.append(0)
                    own.to.append({})
                    own.times.append({})
                own.times[state][c] += 1
                state = own.to[state][c]
                own.passed[state] += 1
            own.ended[state] += 1
        own._merge(alpha)
        return own

    def _merge(self, alpha: float) -> None:
        kept = [0]
        fringe = [(0, c) for c in sorted(self.to[0])]
        while fringe:
            at, c = fringe.pop(0)
            state = self.to[at][c]
            if state in kept:
                continue
            for other in kept:
                if self._alike(other, state, alpha):
                    self.to[at][c] = other
                    self._fold(other, state)
                    break
            else:
                kept.append(state)
            fringe = [(s, x) for s in kept for x in sorted(self.to[s]) if self.to[s][x] not in kept]

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        todo = [(a, b)]
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        while todo:
            a, b = todo.pop()
            n, m = self.passed[a], self.passed[b]
            if not n or not m:
                continue
            limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) > limit:
                return False
            for c in self.times[a].keys() | self.times[b].keys():
                if abs(self.times[a].get(c, 0) / n - self.times[b].get(c, 0) / m) > limit:
                    return False
                if c in self.to[a] and c in self.to[b]:
                    todo.append((self.to[a][c], self.to[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for c, n in self.times[b].items():
                self.times[a][c] = self.times[a].get(c, 0) + n
                if c in self.to[a]:
                    todo.append((self.to[a][c], self.to[b][c]))
                else:
                    self.to[a][c] = self.to[b][c]

    def rows(self) -> list[tuple[int, str, int, float]]:
        """(state, symbol, next state, log probability) of what can be reached; the end has the symbol ``end``."""
        out, seen, todo = [], {0}, [0]
        while todo:
            s = todo.pop()
            n = self.passed[s]
            if self.ended[s]:
                out.append((s, _END, -1, math.log(self.ended[s] / n)))
            for c, t in self.to[s].items():
                out.append((s, c, t, math.log(self.times[s][c] / n)))
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return out


Format = dict[tuple[int, str], tuple[int, float]]


def log_likelihood(word: str, form: Format) -> float:
    """Of the word's letters and its end; a step that the automaton lacks has a small probability and begins anew."""
    state, total = 0, 0.0
    for c in word.translate(_CLASS):
        state, p = form.get((state, c), (0, math.log(_FLOOR)))
        total += p - math.log(_SIZE.get(c, 1))
    return total + form.get((state, _END), (0, math.log(_FLOOR)))[1]


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for i, c in enumerate(_LETTERS):
        out[ord(c)] = i + 1
    return out


def letter_pairs(texts: list[str]) -> np.ndarray:
    """How often each letter of tokens follows each other, by _SIDE times the first plus the second; the edges of tokens count as a letter."""
    data = np.frombuffer(b"\0" + b"\0".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"\0", np.uint8)
    code = _codes()[data]
    pairs = np.bincount(code[:-1] * _SIDE + code[1:], minlength=_SIDE * _SIDE)
    pairs[0] = 0
    return pairs


class Plain:
    """What ordinary tokens are made of: the log probability of each letter after the one before.

    One is taken off each pair's count, so that a token that stands alone says nothing for itself, and spread by how
    frequent the second letter is.
    """

    def __init__(self, pairs: np.ndarray) -> None:
        n = pairs.reshape(_SIDE, _SIDE).astype(float)
        alone, total = n.sum(axis=0) + 0.1, n.sum(axis=1, keepdims=True)
        spread = np.where(total > 0, (n > 0).sum(axis=1, keepdims=True) / np.maximum(total, 1), 1.0)
        p = np.log(np.maximum(n - 1, 0) / np.maximum(total, 1) + spread * (alone / alone.sum()))
        names = ["", *_LETTERS]
        self.pair = {a + b: float(p[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if i and j}
        self.first = {c: float(p[0, j]) for j, c in enumerate(names) if j}
        self.last = {c: float(p[i, 0]) for i, c in enumerate(names) if i}

    def log_likelihood(self, word: str) -> float:
        if any(c not in self.first for c in word):  # a value of a pattern may hold a point
            word = "".join(c for c in word if c in self.first) or "-"
        return self.first[word[0]] + sum(self.pair[word[i : i + 2]] for i in range(len(word) - 1)) + self.last[word[-1]]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, value: what the patterns match, and as ``plain`` the tokens of the rest, each once for a batch."""
    for batch in batches:
        held, plain = set(), set()
        for text in batch.column(0).to_pylist():
            text = text or ""
            spans = base_spans(text)
            held.update((kind, text[at:end]) for kind, _, end, at in spans)
            plain.update(_ANY_TOKEN.findall(redacted(text, [(a, b) for _, a, b, _ in spans], " ")))
        plain = [v for v in plain if len(v) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held] + ["plain"] * len(plain)), pa.array([*(v for _, v in held), *plain], pa.string())], ["kind", "value"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = letter_pairs(batch.column(0).to_pylist())
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(pairs[some])], ["pair", "n"])


def _infer(group: pd.DataFrame) -> pd.DataFrame:
    kind = group["kind"].iloc[0]
    rows = Automaton.learned(sorted(group["value"])).rows()
    return pd.DataFrame([(kind, *r) for r in rows], columns=["kind", "state", "symbol", "to", "p"])


class Formats:
    """Automata of the kinds of credentials, and what a token needs to be one.

    A token is a hit of a kind if the kind's format makes it ODDS times likelier than ordinary words do, if at most a
    share SHORTER of the kind's own examples are shorter, and if it is not far less likely than these are.
    """

    def __init__(self, kinds: dict[str, Format], plain: Plain, examples: dict[str, list[str]]) -> None:
        self.plain, self.kinds, self.memo = plain, {}, {}
        for kind, form in kinds.items():
            words = examples[kind]
            own = np.array([log_likelihood(w, form) / (len(w) + 1) for w in words])
            shortest = sorted(map(len, words))[int(len(words) * SHORTER)]
            self.kinds[kind] = (form, shortest, float(own.mean() - DEVIATIONS * own.std()))

    def hit(self, value: str) -> bool:
        found = self.memo.get(value)
        if found is None:
            if len(self.memo) > MEMO_TOKENS:
                self.memo.clear()
            found = self.memo[value] = self._judge(value)
        return found

    def _judge(self, value: str) -> bool:
        need = self.plain.log_likelihood(value) + math.log(ODDS)
        if -sum(math.log(_SIZE.get(c, 1)) for c in value.translate(_CLASS)) < need:
            return False  # no automaton can make it that likely
        for form, shortest, least in self.kinds.values():
            if len(value) >= shortest:
                p = log_likelihood(value, form)
                if p >= need and p / (len(value) + 1) >= least:
                    return True
        return False


def learn_formats(docs: DataFrame, text: str) -> Formats:
    """An automaton of each kind, and the letters of ordinary words.

    The patterns' matches and the tokens (of up to LONGEST letters) are taken from all documents, equal ones as one, so
    that copies have no weight. At most SAMPLE examples of a kind, the first by a hash, are learned from, one task for
    each kind; a kind with fewer than FEWEST has none.
    """
    text_batches(docs)
    counted = cut(docs.select(text).mapInArrow(_examples, "kind string, value string").distinct())
    pairs = np.zeros(_SIDE * _SIDE, np.int64)
    found = counted.filter("kind = 'plain'").select("value").mapInArrow(_paired, "pair long, n long")
    for r in found.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # as many as there are pairs of letters, at most
        pairs[r["pair"]] = r["n"]
    picked, examples = None, {}
    hashed = counted.filter((F.col("kind") != "plain") & (F.length("value") <= LONGEST)).withColumn("h", F.xxhash64("value"))
    for kind in KINDS[:3]:
        own = first_by_hash(hashed.filter(F.col("kind") == kind), "h", SAMPLE).select("kind", "value")
        picked = own if picked is None else picked.unionByName(own)
    picked = cut(picked)
    for r in picked.collect():
        examples.setdefault(r["kind"], []).append(r["value"])
    formats: dict[str, Format] = {}
    for r in picked.groupBy("kind").applyInPandas(_infer, "kind string, state long, symbol string, to long, p double").collect():
        if len(examples[r["kind"]]) >= FEWEST:
            formats.setdefault(r["kind"], {})[(r["state"], r["symbol"])] = (r["to"], r["p"])
    return Formats(formats, Plain(pairs), examples)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value", pa.string())])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base and format of each row: lists of kind, start, end, value_start and value (code points, end exclusive).

    base holds what the patterns match, format the further tokens that a learned format makes likely. A null text is
    an empty one. Repeated rows each give a row; texts are scanned whole, once to learn and once to find. With fewer
    than FEWEST examples a kind has no automaton; with none, format is empty. An empty table gives none; other columns
    are neither read nor returned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn_formats(docs, text))  # bounded by the sample

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = shared.value
        for batch in batches:
            base, more = [], []
            for value in batch.column(1):
                own = value.as_py() or ""
                spans = base_spans(own)
                base.append([dict(zip(("kind", "start", "end", "value_start", "value"), (*s, own[s[3] : s[2]]), strict=True)) for s in spans])
                tokens = [(a, b) for a, b in candidates(own, spans) if formats.hit(own[a:b])]
                more.append([{"kind": "format", "start": a, "end": b, "value_start": a, "value": own[a:b]} for a, b in tokens])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(more, pa.list_(_SPAN))], ["id", "base", "format"])

    span = "array<struct<kind:string,start:long,end:long,value_start:long,value:string>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(found, f"id {dict(docs.dtypes)[id_col]}, base {span}, format {span}").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 and spans, from what scan() found."""
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    joined = lambda spans: F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("b"), s["kind"].alias("k"), s["end"].alias("e")))),
            lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["e"].cast("string")),
        ),
        ",",
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col, *[count(k) for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "format")).alias("spans")
    )


def redacted(text: str | None, spans: list[tuple[int, int]], mark: str) -> str | None:
    """The text with each stretch of overlapping spans replaced by the mark."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the values of all secrets, of the patterns and of the learned formats, replaced by the mark.

    All rows and columns stay, repeated ones too; only texts that hold a secret change, null and empty ones never.
    Spans that overlap are replaced as one. The formats are learned from docs first; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn_formats(docs, text))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        def one(value: str | None) -> str | None:
            base = base_spans(value or "")
            more = [(a, b) for a, b in candidates(value or "", base) if shared.value.hit(value[a:b])]
            return redacted(value, [(s[3], s[2]) for s in base] + more, mark)

        return texts.map(one)

    return docs.withColumn(text, cleaned(text))
