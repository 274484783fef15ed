from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import substring_dedup

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows: list[tuple], window: int) -> list[tuple]:
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    least: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                least[tuple(w[k : k + window])] = min(i, least.get(tuple(w[k : k + window]), i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    word = lambda: draw.choice("a b c d e f ä x1 . ! zz".split()) + str(draw.randrange(40))
    passages = [[word() for _ in range(draw.randrange(40, 130))] for _ in range(4)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            parts += [word() for _ in range(draw.randrange(0, 60))]
            if draw.random() < 0.6:
                p = draw.choice(passages)
                at = draw.randrange(len(p))
                parts += p if draw.random() < 0.7 else p[at:]
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(parts), "x"))
    rows += [(200, rows[3][1], "x"), (201, rows[3][1], "x"), (202, " ".join(rows[3][1].split()), "x")]
    rows += [(203, None, None), (204, "", "x"), (205, " \n ", "x"), (206, "w " * 300, "x"), (207, "w " * 120, "x"), (3, rows[3][1], "x"), (3, rows[4][1], "x"), (None, rows[3][1], "x")]
    return rows


@pytest.mark.parametrize("tree_rows", [1000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, tree_rows):
    rows = corpus(seed)
    found = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA), tree_rows=tree_rows)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 50)


def test_suffixes_are_sorted_to_a_depth():
    draw = random.Random(4)
    words = np.array([draw.choice([b"a", b"b", b"c"]) for _ in range(300)], dtype=object)
    for depth in (1, 3, 5, 50):
        order, alike = substring_dedup.suffix_array(words, depth)
        whole = [i for i in order if i + depth <= len(words)]
        heads = [tuple(words[i : i + depth]) for i in whole]
        assert heads == sorted(heads) and sorted(order) == list(range(300))
        place = {i: k for k, i in enumerate(order)}
        for a, b in zip(order[:-1], order[1:], strict=True):
            if max(a, b) + depth <= len(words):
                assert alike[place[b]] == (tuple(words[a : a + depth]) == tuple(words[b : b + depth]))
    assert [len(x) for x in substring_dedup.suffix_array(np.array([], dtype=object), 5)] == [0, 0]


def test_empty_table(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_text_is_read_whole(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    filler = " ".join(f"f{k}" for k in range(200_000))
    rows = [(1, passage, "x"), (2, f"{filler} {passage}", "x")]
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: 0, 2: 60}


@pytest.mark.parametrize("tree_rows", [1000, 1])
@pytest.mark.parametrize("first", [1, 9, 27, 49, 50])
def test_texts_whose_first_words_are_longer_than_a_chunk(spark, first, tree_rows):
    passage = " ".join(f"p{k}" for k in range(70))
    blobs = " ".join(f"{k}" + "x" * (600_000 // first) for k in range(first))
    more = " ".join(f"f{k}" for k in range(30))
    rows = [(1, f"{blobs} {more} {passage} end", "x"), (2, f"{more} {passage}", "x"), (3, f"{blobs} {passage} {blobs} {more}", "x"), (4, f"{more} {blobs}", "x")]
    found = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA), tree_rows=tree_rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, 50)
