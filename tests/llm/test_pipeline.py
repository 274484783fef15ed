from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from millrace.llm import decontamination, mixing, secret_scan, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_keeps_what_a_plain_version_keeps(spark, documents):
    """The stages by hand, with sets and loops over what each operator says of every document."""
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r["doc_id"]: r for r in documents.collect()}
    stages = dict(corpus_pipeline.STAGES)

    scored = {r["doc_id"]: r["predicted"] for r in toxicity.fit(documents, labels).score(documents).select("doc_id", "predicted").collect()}
    after = stages["toxicity"](spark, documents, SF)
    assert after.columns == documents.columns
    assert ids(after) == sorted(i for i, p in scored.items() if not p)

    label = jaccard_groups([(r["doc_id"], r["text"]) for r in after.collect()])
    after = stages["SimHash near-dedup"](spark, after, SF)
    assert after.columns == documents.columns
    assert ids(after) == sorted(set(label.values()))

    leaked = {r["doc_id"] for r in decontamination.contaminated(after, items).collect()}
    kept = [i for i in ids(after) if i not in leaked]
    after = stages["benchmark decontamination"](spark, after, SF)
    assert after.columns == documents.columns and ids(after) == kept and leaked

    spans = {r["doc_id"]: [(s["value_start"], s["end"]) for s in r["base"] + r["format"]] for r in secret_scan.scan(after).collect()}
    after = stages["secret scans"](spark, after, SF)
    assert after.columns == documents.columns
    for r in after.collect():
        assert r["text"] == secret_scan.redacted(texts[r["doc_id"]]["text"], spans[r["doc_id"]], "[SECRET]")
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))

    last = stages["mixing sources to target weights"](spark, after, SF)
    assert sorted(map(str, last.collect())) == sorted(map(str, mixing.mix(after).collect())) and ids(last) == kept


def test_rows_without_an_id_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, "other words are here", "en", "s", 1), (3, None, None, None, None), (4, "", "de", None, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    after = stages["SimHash near-dedup"](spark, table, SF)
    assert sorted(map(str, (r["doc_id"] for r in after.collect()))) == ["1", "3", "None"]
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, table.limit(0), SF).count() == 0, name
        assert stage(spark, table, SF).count() > 0, name


def test_two_texts_under_one_id_and_clashing_columns(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    clash = ["_toxic", "toxicity", "key", "_key", "text_hash", "group", "component_id", "_gone_id"]
    rows = [(1, a), (5, a), (5, b), (7, f"{b} end"), (None, a), (8, None), (9, " ")]
    table = spark.createDataFrame([(i, t, "en", "s", 1, *["x"] * len(clash)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    stages = dict(corpus_pipeline.STAGES)
    after = stages["SimHash near-dedup"](spark, table, SF)
    assert after.columns == table.columns
    assert sorted((r["doc_id"], r["text"]) for r in after.collect() if r["text"]) == [(1, a), (5, b)] and after.filter("doc_id = 8").count() == 1
    for name in ("toxicity", "benchmark decontamination", "secret scans"):
        kept = stages[name](spark, table, SF)
        assert kept.columns == table.columns and kept.count() > 0, name
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leaked = spark.createDataFrame([(1, f"{a} {item} {b}"), (1, a), (None, item), (None, b), (2, None)], "doc_id long, text string")
    left = stages["benchmark decontamination"](spark, leaked, SF)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(str, [(1, a), (None, b), (2, None)]))


def test_run_writes_every_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "taken"} <= set(got.columns) and got.count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "SimHash near-dedup", "benchmark decontamination", "secret scans", "mixing sources to target weights"]


def jaccard_groups(rows):
    """The smallest id of each text's group, by the Jaccard similarity of all pairs of five-word shingle sets."""
    sets = {}
    for i, t in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode("utf-8", "surrogatepass").split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    label, order = {i: i for i in sets}, sorted(sets)
    with_shingle = {}
    for i in order:
        for s in sets[i] or {()}:
            with_shingle.setdefault(s, []).append(i)
    met = {i: {j for s in sets[i] or {()} for j in with_shingle[s] if j < i} for i in order}
    links = [(i, j) for i in order for j in met[i] if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


@pytest.mark.parametrize("block", [1024, 3])
def test_near_copies_are_the_groups_of_all_jaccard_pairs(spark, block):
    draw = random.Random(8)
    rows = []
    for _ in range(60):
        words = [draw.choice("Alpha beta gamma é".split()) + str(draw.randrange(60)) for _ in range(draw.choice([3, 5, 9, 10, 40, 200, 600]))]
        rows.append(" ".join(words))
        for _ in range(draw.randrange(4)):
            again = list(words)
            for _ in range(max(1, round(len(words) * draw.choice([0.01, 0.02, 0.03, 0.05])))):
                again[draw.randrange(len(again))] = "changed"
            rows.append("\n".join(again))
    boiler = " ".join(f"b{k}" for k in range(30))
    rows += [f"{boiler} {' '.join(str(draw.random()) for _ in range(20))}" for _ in range(30)] + [None, "", " \n"]
    rows = list(enumerate(rows))
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    label = jaccard_groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == label and len(set(label.values())) < len(rows) - 5


def test_texts_of_linked_fingerprints_are_joined_by_simhash_itself(spark, monkeypatch):
    """Without the candidates by shingles, what differs by up to three bits is found, and only if it is similar."""
    draw, rows = random.Random(5), []
    bits = lambda t: int(simhash.majority_bits([simhash.shingle_set(t, 5, 42)])[0])
    while len(rows) < 12:
        words = [f"w{draw.randrange(10_000)}" for _ in range(400)]
        a, b = " ".join(words), " ".join([*words[:-1], "changed"])
        if (bits(a) ^ bits(b)).bit_count() <= 3:
            rows += [a, b]
    monkeypatch.setattr(simhash, "_candidates", lambda *_: lambda batches: iter(()))
    found = simhash.near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i - i % 2 for i in range(12)} == jaccard_groups(list(enumerate(rows)))


def near_copies_of_one(n: int) -> list[tuple[int, str]]:
    """Texts of which few pairs have a similarity of 0.8, and nearly all some 0.76."""
    draw = random.Random(n)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(n):
        words = list(base)
        for k in (0, 1):
            words[draw.randrange(150)] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("n", [150, 600])
def test_a_group_gives_on_fewer_pairs_than_it_has_rows(n):
    sets = [simhash.shingle_set(text, 5, 42) for _, text in near_copies_of_one(n)]
    fps, sizes = simhash.majority_bits(sets).view(np.int64), np.array([len(h) for h in sets], np.int32)
    order = np.lexsort((fps, sizes))
    held = pa.array([(sets[i] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for i in order], pa.list_(pa.int32()))
    columns = {"s": pa.array(np.zeros(n, np.int64)), "node": pa.array(order), "root": pa.array(order), "n": pa.array(sizes[order]), "fp": pa.array(fps[order])}
    columns |= {"sketch": pa.array([simhash.bin_sketch(sets[i]) for i in order], pa.binary()), "shingles": held}
    assert sum(b.num_rows for b in simhash._candidates(["s"], 0.8)(iter([pa.RecordBatch.from_pydict(columns)]))) < n


def test_pairs_that_leave_a_group_of_near_copies_grow_with_it_and_not_with_its_square(spark, monkeypatch, tmp_path):
    """Few outliers have no partner and are compared with all of the group; that must not make rows."""
    plain, made = simhash._plausible, []
    for n in (150, 600):
        folder = tmp_path / str(n)
        folder.mkdir()

        def counting(similarity, folder=str(folder)):
            def scan(batches):
                with open(f"{folder}/{random.random()}", "w") as f:
                    for batch in batches:
                        f.write(f"{batch.num_rows}\n")
                        yield from plain(similarity)(iter([batch]))

            return scan

        monkeypatch.setattr(simhash, "_plausible", counting)
        rows = near_copies_of_one(n)
        found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc_id"]: r["component_id"] for r in found.collect()} == jaccard_groups(rows)
        made.append(sum(int(x) for f in folder.iterdir() for x in f.read_text().split()))
    assert 0 < made[1] < 5 * made[0], made


@pytest.mark.parametrize("exact,bits", [(512, 32), (140, 32), (512, 3)])
def test_shingles_in_a_group_find_what_all_pairs_find(spark, monkeypatch, exact, bits):
    """Also where some sets are too large to go with their rows, and where bits match by chance, so that pairs stand for others wrongly."""
    draw, rows = random.Random(3), near_copies_of_one(60)
    for i in range(60, 100):
        words = rows[draw.randrange(60)][1].split()
        rows.append((i, " ".join([*words[: draw.randrange(118, 150)], *(f"end{k}" for k in range(draw.randrange(8)))])))
    whole = simhash.shingle_set
    monkeypatch.setattr(simhash, "carried_bits", lambda *x: (whole(*x) & np.uint64((1 << bits) - 1)).astype(np.uint32))
    monkeypatch.setattr(simhash, "EXACT", exact)
    monkeypatch.setattr(simhash, "LARGE", 4)
    monkeypatch.setattr(simhash, "NEIGHBOURS", 1)
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=40)
    label = jaccard_groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == label and 1 < len(set(label.values())) < 90


def test_the_stage_leaves_one_text_of_each_jaccard_group(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    label = jaccard_groups([(r["doc_id"], r["text"]) for r in table.collect()])
    assert ids(dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, table, SF)) == sorted(set(label.values()))
