from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, simhash
from millrace.llm.components import components

MASK = (1 << 64) - 1
DOCS = "doc_id long, text string, fp string, id long, a string"


def roots(nodes, linked):
    """The smallest reachable node of each, by repeated relabelling."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    order = sorted(fps)
    return roots(order, [(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if bin(fps[a] ^ fps[b]).count("1") <= 3])


def texts(seed):
    draw = random.Random(seed)
    out = []
    for _ in range(40):
        words = [draw.choice("alpha Beta gamma DELTA é ü 你 x.".split()) + str(draw.randrange(30)) for _ in range(draw.randrange(3, 400))]
        out.append(" ".join(words))
        for _ in range(draw.randrange(3)):
            again = list(words)
            again[draw.randrange(len(again))] = "changed"
            out.append("\t".join(again))
    return out + ["", None, " \n ", "one", "ONE", "one two", "y " * 5000]


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = [(i, t, "clash", 7, "clash") for i, t in enumerate(texts(1))] + [(3, texts(1)[3], "clash", 8, "clash")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    found = got.collect()
    assert len(found) == len(rows)
    fps = {i: fingerprint(t) for i, t, *_ in rows}
    label = brute_components(fps)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found} == {(i, f"{fps[i]:016x}", label[i]) for i in fps}


@pytest.mark.parametrize("block", [1024, 100])
def test_links_join_all_within_the_radius(spark, block):
    draw = random.Random(5)
    fps = set()
    for _ in range(60):
        base = draw.getrandbits(64)
        fps.add(base)
        for _ in range(draw.choice([1, 1, 8, 60])):
            base ^= sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 6)))
            fps.add(base)
    heavy = draw.getrandbits(26)  # many that share two bands
    fps |= {heavy | draw.getrandbits(38) << 26 for _ in range(300)}
    order = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in order]
    got = {r["node"] & MASK: r["root"] & MASK for r in components(simhash.links(spark.createDataFrame(rows, "fp long"), block=block)).collect()}
    label = brute_components(dict(enumerate(order)))
    want, found = {}, {}
    for i, f in enumerate(order):
        want.setdefault(label[i], set()).add(f)
        found.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, found.values()))


def test_finer_masks_keep_what_is_within_the_radius():
    draw = random.Random(6)
    for mask in simhash.band_masks():
        finer = simhash.finer_masks(mask)
        assert len(set(finer)) == 10 and all(m & mask == mask and m >> 64 == 0 for m in finer)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(200):
            change = sum(1 << b for b in draw.sample(free, 3))
            assert any(not change & m for m in finer)


def test_a_frequent_key_is_joined_like_any_other(spark):
    from millrace.llm.common import join_counted

    rows = [(7, i) for i in range(1500)] + [(k, k) for k in range(10)]
    left = spark.createDataFrame(rows, "k long, v long")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "-k as w")
    got = join_counted(left, right, "k", "n", len(rows))
    assert sorted(map(tuple, got.select("k", "v", "w").collect())) == sorted((k, v, -k) for k, v in rows)


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c d", "", 1, ""), (5, "a b c d", "", 1, ""), (None, "q w e r t y", "", 1, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [(5, 5), (None, 5), (None, None)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_components_of_chains_and_cycles(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 302), (302, 300), (400, 400)] + [(500, 500 + i) for i in range(50)]
    draw.shuffle(edges)
    got: dict[int, set] = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(201)), [300, 301, 302], list(range(500, 550))]
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, node long, copies string"


def vectors(seed, dims=16):
    draw = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = draw.normal(size=dims)
            for _ in range(int(draw.integers(1, 6))):
                base = base + draw.normal(size=dims) * draw.choice([0.0, 0.03, 0.05, 0.2])
                rows.append((i, [float(np.float32(x)) for x in base * draw.choice([1.0, 3.0])], label, 1, "clash"))
                i += 1
    odd = [None, [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [], [1.0]]
    rows += [(i + k, v, 0, 1, "clash") for k, v in enumerate(odd)]
    rows.append((0, rows[0][1], 0, 1, "clash"))
    return rows


@pytest.mark.parametrize(("block", "codes"), [(2048, None), (5, None), (2048, 60)])
def test_embeddings_equal_brute_force(spark, block, codes):
    rows = vectors(2)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), block=block, codes=codes)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]

    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v) / np.linalg.norm(v) if label is not None and usable(v) else None for _, v, label, *_ in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    ]
    degree = [sum(i in p for p in links) for i in range(len(rows))]
    label = roots({r[0] for r in rows}, [(rows[i][0], rows[j][0]) for i, j in links])
    want = sorted((r[0], degree[k], label[r[0]], r[0] == label[r[0]]) for k, r in enumerate(rows))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("kind", ["double", "string", "decimal(6,2)", "tinyint"])
def test_labels_of_any_type_are_told_apart(spark, monkeypatch, kind):
    """Labels that a cast to a whole number would take for one; one vector that half of the rows hold."""
    monkeypatch.setattr("millrace.llm.common.HOT_ROWS", 5)
    labels = [1, 2, 1, None] if kind == "tinyint" else ["1.2", "1.7", "1.2", None]
    rows = [(i, [1.0, 0.0, float(i % 2) / 100], labels[i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {'int' if kind == 'tinyint' else 'string'}")
    got = embedding_dedup.near_duplicates(df.withColumn("label", F.col("label").cast(kind)))
    linked = {0: (19, 0), 1: (9, 1), 2: (19, 0), 3: (0, None)}  # twenty of the first label, ten of the second
    assert sorted(map(tuple, got.collect())) == [(i, linked[i % 4][0], i if i % 4 == 3 else linked[i % 4][1], i in (0, 1) or i % 4 == 3) for i in range(40)]


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_multi_sequence_is_in_order_and_complete():
    draw = np.random.default_rng(1)
    a, b = draw.random(7), draw.random(9)
    found = embedding_dedup.multi_sequence(a, b, 1.2)
    sums = [a[i] + b[j] for i, j in found]
    assert sums == sorted(sums) and set(found) == {(i, j) for i in range(7) for j in range(9) if a[i] + b[j] <= 1.2}


def test_the_grid_follows_the_largest_label():
    sides = [embedding_dedup.grid_side(n) for n in (0, 1, 16_384, 16_385, 1_000_000, 10**12)]
    assert sides == [16, 16, 16, 17, 125, 1024]
    assert all(n / embedding_dedup.grid_side(n) ** 2 <= embedding_dedup.CELL_ROWS for n in range(1, 3_000_000, 9973))


@pytest.mark.parametrize("falling", [1.0, 1.5])
def test_recall_where_the_variance_is_uneven(spark, falling):
    draw = np.random.default_rng(7)
    scale = np.arange(1, 97) ** (-falling / 2)
    base = draw.normal(size=(1500, 96)) * scale
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = draw.normal(size=base.shape) * scale
    step -= (step * base).sum(axis=1)[:, None] * base
    step /= np.linalg.norm(step, axis=1)[:, None]
    angle = np.arccos(draw.uniform(0.98, 0.99, len(base)))[:, None]
    x = np.concatenate([base, np.cos(angle) * base + np.sin(angle) * step])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), codes=64)
    links = x @ x.T >= 0.98
    degree = links.sum(axis=1) - 1
    n = np.zeros(len(x), int)
    for r in got.collect():
        n[r["vec_id"]] = r["n_links"]
    assert (n <= degree).all() and n.sum() >= 0.998 * degree.sum()


def test_many_lengths_of_vectors_and_low_rank(spark):
    """More lengths than codebooks are kept for, each with few vectors; and unit vectors of rank five in 64 dimensions, counted on both sides."""
    rows = [(d * 3 + k, [1.0] * (d + 1) if k < 2 else [1.0] + [-1.0] * d, 0) for d in range(1, 1200) for k in range(3)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    for i, v, _ in rows:
        want = 1 if i % 3 < 2 else 0
        assert (got[i]["n_links"], got[i]["component_id"]) == (want, i - 1 if i % 3 == 1 else i)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(4000, 5)) @ draw.normal(size=(5, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32).astype(float)
    found = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int"), codes=64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    degree = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    n = np.zeros(len(x), int)
    for r in found.collect():
        n[r["vec_id"]] = r["n_links"]
    assert (n <= degree).all() and n.sum() >= 0.998 * degree.sum()
