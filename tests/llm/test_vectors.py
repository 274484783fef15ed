from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import vector_codes, whitening
from millrace.llm.vector_codes import Block, Change, Codebooks, nearest


def rows_of(spark, vectors, ids=None, labels=None):
    """Rows with columns that have the names which the operators use inside."""
    rows = [(ids[i] if ids else i, v, labels[i] if labels else i % 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame([(i, v, k, "a", 0.5, "p") for i, v, k in rows], "vec_id long, embedding array<double>, label int, id string, x double, part string").repartition(5)


def plain_codes(rows, parts, entries, rounds):
    """Lloyd's rounds over all parts and entries, in Python's integers."""
    kept = sorted((i, [int(np.floor(4096 * c)) for c in v], k) for i, v, k in rows)
    width = len(kept[0][1]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, x, _ in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        own = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, o in zip(cut, own) if o[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    own = assign()
    errors = [sum(far(v[p], books[p][o[p]]) for p in range(parts)) for v, o in zip(cut, own)]
    label = defaultdict(int)
    for (_, _, k), e in zip(kept, errors):
        label[k] += e
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return sorted((i, "".join(f"{c:02x}" for c in o), e, label[k]) for (i, _, k), o, e in zip(kept, own, errors)), hashlib.sha256(text.encode()).hexdigest()


def coded(df, **options):
    found, books = vector_codes.encode(df, **options)
    rows = vector_codes.with_label_errors(found).selectExpr("vec_id", "lower(hex(code))", "error", "label_error").collect()
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r)), books.sha256()


@pytest.mark.parametrize(("seed", "entries", "rounds"), [(1, 4, 6), (2, 16, 6), (3, 16, 1)])
def test_codes_equal_plain_rounds(spark, seed, entries, rounds):
    draw = np.random.default_rng(seed)
    clusters = draw.normal(size=(6, 8)) * 0.3
    vectors = (clusters[draw.integers(0, 6, 240)] + draw.normal(size=(240, 8)) * 0.05).tolist()
    vectors += [vectors[7]] * 90 + [[0.0] * 8] * 5 + [[0.25, -0.25] * 4] * 20  # copies, and parts at equal distances
    labels = [None if i % 7 == 0 else 0 if i % 3 else 1 for i in range(len(vectors))]
    ids = [int(i) for i in draw.permutation(len(vectors)) - 50]
    bad = [None, [], [float("nan")] * 8, [None] * 8, [float("inf")] + [0.0] * 7, [1.0] * 16]
    df = rows_of(spark, vectors + bad, ids + [-1000 + i for i in range(len(bad))], labels + [0] * len(bad))
    assert coded(df, parts=4, entries=entries, rounds=rounds) == plain_codes(list(zip(ids, vectors, labels)), 4, entries, rounds)


def test_a_round_pops_only_what_may_change():
    draw = np.random.default_rng(5)
    x = np.floor(draw.normal(size=(4000, 2, 4)) * 1000).astype(np.int64)
    books = Codebooks(x[:8].transpose(1, 0, 2).copy(), np.zeros((2, 8)))
    block = Block.first(x, books)
    compared = []
    for step in (300, 30, 3, 0):
        moved = books.entries + np.floor(draw.normal(size=books.entries.shape) * step).astype(np.int64)
        distance = np.sqrt(((moved - books.entries) ** 2).sum(axis=2))
        others = np.stack([np.delete(distance, e, axis=1).max(axis=1) for e in range(8)], axis=1)
        books = Codebooks(moved, books.drift + distance + others)
        before, seen = block.codes(), []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(vector_codes, "nearest", lambda rows, entries: seen.append(len(rows)) or nearest(rows, entries))
            change = Change(books.entries.shape)
            block.reassign(books, change)
        compared.append(sum(seen))
        codes = block.codes()
        for p in range(2):
            assert (codes[:, p] == nearest(x[:, p], books.entries[p])[0]).all()
            gained = np.bincount(codes[:, p], minlength=8) - np.bincount(before[:, p], minlength=8)
            assert (change.counts[p] == gained).all()
            for e in range(8):
                heap = block.heap(p, e)
                assert all(heap[i] >= heap[(i - 1) // 2] for i in range(1, len(heap)))
    assert compared[0] > compared[1] > compared[2] > compared[3] and compared[2] < 800 and compared[3] < 8  # of 8000 parts


def test_codes_of_few_and_no_vectors(spark):
    one = rows_of(spark, [[0.1, -0.2] * 4])
    rows, _ = coded(one)
    assert rows == [(0, "00" * 8, 0, 0)]
    for none in (one.filter("false"), rows_of(spark, [None, [], [float("nan")]])):
        assert coded(none) == ([], hashlib.sha256(b"").hexdigest())
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.encode(rows_of(spark, [[0.5] * 9]))
    null_id = rows_of(spark, [[0.5] * 8, [0.25] * 8], ids=[None, 3], labels=[1, 1])
    assert coded(null_id, entries=1, rounds=0)[0] == [(3, "00" * 8, 0, 8 * 1024**2), (None, "00" * 8, 8 * 1024**2, 8 * 1024**2)]


def test_whitening_equals_the_definition(spark):
    draw = np.random.default_rng(9)
    vectors = (draw.normal(size=(300, 12)) @ draw.normal(size=(12, 12)) * 0.1 + draw.normal(size=12)).tolist()
    vectors += [vectors[3]] * 60
    bad = [None, [], [None] * 12, [float("-inf")] * 12, [float("nan")] * 12, [0.5] * 7]
    df = rows_of(spark, vectors + bad)
    got = whitening.whiten(df).collect()
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    v = np.cov(x.T.astype(float), bias=True)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    white = (x - sums / n) @ axes[:, :8] / np.sqrt(e[:8])
    assert len(got) == n * 8 and {r["n"] for r in got} == {n}
    found = np.zeros((n, 8))
    for r in got:
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(v), rel=1e-9)
        assert r["identity_error"] < 1e-10
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found - white * signs).max() < 1e-8
    assert {r["whitened"] for r in got if r["vec_id"] == 3} == {r["whitened"] for r in got if r["vec_id"] == 310}


def test_deviations_beyond_a_long_are_exact():
    x = np.array([[3, 1 << 33], [5, -(1 << 33)]], np.int64)
    n, sums = 1 << 29, (1 << 32, -(1 << 55))
    off = whitening.deviations(x, n, sums)
    assert off.tolist() == [[n * int(a) - s for a, s in zip(row, sums)] for row in x]
    assert [int(d) for d in whitening._squares(off).to_pylist()] == [sum(int(d) ** 2 for d in row) for row in off]


def test_sums_beyond_a_long_are_exact(spark):
    big = float((1 << 37) - 1)
    rows = [[big, 0.0]] * 70_000 + [[-0.5, 1.0]]
    model = whitening.fit(rows_of(spark, rows), components=1)
    assert model.sums == (70_000 * (1024 * ((1 << 37) - 1) + 100_000) - 512 + 100_000, 70_000 * 100_000 + 101_024) and model.sums[0] > 1 << 63


def test_whitening_of_few_and_no_vectors(spark):
    assert whitening.whiten(rows_of(spark, [None, [], [float("nan")]])).collect() == []
    assert whitening.fit(rows_of(spark, [[1.0]]).filter("false")) is None
    same = whitening.whiten(rows_of(spark, [[0.5, 0.25, 1.0]] * 4)).collect()
    assert len(same) == 12 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)
    line = whitening.whiten(rows_of(spark, [[0.5 * i, 0.25, 1.0] for i in range(4)], ids=[None, 1, 1, 2])).collect()
    assert len(line) == 12 and sum(r["whitened"] is not None for r in line) == 4
    assert sum(r["vec_id"] is None for r in line) == 3
