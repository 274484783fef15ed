from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, language_id, mixing, quality, secret_scan, toxicity, url_filter

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, "clash") for i, t in rows], DOCS)


# url filters


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        host, path, _ = re.match(r"([^/?#]*)([^?#]*)(.*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


@pytest.mark.parametrize("spread", [None, 3])
def test_urls_equal_a_loop_over_the_rules(spark, spread):
    draw = random.Random(1)
    hosts = ["net", "a.net", "example.net", "x.example.net", "example.com", "org", "b.org", "EXAMPLE.Net", "notexample.net", "", "net.", "a..net", "é.org"]
    paths = ["", "/", "/en/", "/en/x?y#z", "/de/", "/fr/a", "?q=/en/", "#/en/", "/EN/"]
    urls = [f"https://{h}{p}" for h in hosts for p in paths] + [None, "", "no url", "://", "a://b://net/", "x" * 5000 + "://net/" + "y" * 5000]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("example.net", "/", "allow"), ("x.example.net", "/e", "block"), ("ab.net", "/", "block")]
    rows = [(i, u, "h", "clash") for i, u in enumerate(urls)] + [(0, urls[0], "h", "clash")]
    draw.shuffle(rows)
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, key string, salt string"), given, spread=spread)
    assert sorted(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").fillna("", ["rule"]).collect()) == sorted(
        (i, *[x or "" if k == 2 else x for k, x in enumerate(judged(u, rules))]) for i, u, *_ in rows
    )
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), given).collect() == []


# secrets


def base_of(text):
    found = []
    for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans(spark):
    texts = [
        "password = abcdef, PASSWD:'x.y-z/9' token=short token='longer1'", "AKIA" + "A" * 16 + " AKIA123", "é" * 3 + "0" * 24 + "g" + "ab" * 12, None, "", "secret" * 3, "api_key==abcdef",
        "apiKey\n=abcdef", "ſecret=abcdef", "x" * 300_000 + " token:abcdef1",
    ]
    rows = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(docs(spark, *enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = base_of(t or "")
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        r, n = rows[i], Counter(k for _, _, k, _ in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest())
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))
    assert secret_scan.scan(docs(spark).limit(0)).collect() == []


def test_formats_find_bare_credentials_of_a_known_kind(spark):
    draw = random.Random(4)
    key = lambda: "sk" + "".join(draw.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(22))
    rows = [(i, f"some words and token={key()} here") for i in range(60)] + [(100 + i, f"plain talk about things number {i} and more of it") for i in range(60)]
    bare = key()
    rows.append((500, f"look at {bare} now"))
    got = {r["doc_id"]: r["format"] for r in secret_scan.scan(docs(spark, *rows)).collect()}
    assert [s["value"] for s in got[500]] == [bare] and not any(got[100 + i] for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs(spark, *rows)).collect()}
    assert clean[500] == "look at [SECRET] now" and clean[0] == "some words and token=[SECRET] here" and clean[100] == rows[60][1]


def test_formats_where_many_tokens_are_bare_credentials(spark):
    """A tenth of the tokens that could be one are keys of a known format; all are found, ordinary tokens and other ids stay."""
    draw = random.Random(14)
    vocabulary = ["".join(draw.choice(["ra", "to", "mi", "nel", "sta", "po", "ing", "er"]) for _ in range(draw.randrange(2, 7))) for _ in range(400)]
    key = lambda: "".join(draw.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(32))
    words = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    rows, bare = [], {}
    for i in range(600):
        if i % 10 == 0:
            bare[i] = key()
            rows.append((i, f"{words(20)} {bare[i]} {words(3)}"))
        elif i % 10 == 1:
            rows.append((i, f"{words(5)} secret: {key()} {words(5)}"))
        else:
            rows.append((i, f"{words(15)} {draw.choice(vocabulary)}-{draw.choice(vocabulary)}_{draw.choice(vocabulary)} 1234567890123 /usr/{draw.choice(vocabulary)}/{draw.choice(vocabulary)}"))
    got = {r["doc_id"]: [s["value"] for s in r["format"]] for r in secret_scan.scan(docs(spark, *rows)).collect()}
    assert {i: v for i, v in got.items() if v} == {i: [v] for i, v in bare.items()}


def test_letter_pairs_and_redaction_of_odd_rows(spark):
    texts = ["ab ab-é", "", "b"]
    pairs = Counter()
    for t in texts:
        for token in re.findall(r"[A-Za-z0-9+/_=-]+", t):
            pairs.update(zip(f"\0{token}", f"{token}\0", strict=True))
    place = {c: i + 1 for i, c in enumerate(secret_scan._LETTERS)} | {"\0": 0}
    want = np.zeros(len(place) ** 2, int)
    for (a, b), n in pairs.items():
        want[place[a] * len(place) + place[b]] = n
    assert np.array_equal(secret_scan.letter_pairs(texts), want)
    table = spark.createDataFrame([(1, "token=abcdef1", "x"), (1, "token=abcdef1", "x"), (2, None, None), (3, "", "x"), (None, "AKIA" + "B" * 16 + "=1", "y")], "doc_id long, text string, format string")
    got = sorted(map(tuple, secret_scan.redact(table).collect()), key=str)
    assert got == sorted([(1, "token=[SECRET]", "x"), (1, "token=[SECRET]", "x"), (2, None, None), (3, "", "x"), (None, "[SECRET]=1", "y")], key=str)
    assert secret_scan.redact(table.limit(0)).count() == 0 and len(secret_scan.scan(table).collect()) == 5
    assert list(secret_scan.candidates("aaaaaaaa token=abcdefgh-bbbbbbbb", secret_scan.base_spans("aaaaaaaa token=abcdefgh-bbbbbbbb"))) == [(0, 8)]


def test_automaton_merges_and_scores():
    words = ["ab" * n for n in range(1, 40)]
    automaton = secret_scan.Automaton.learned(words)
    form = {(s, c): (t, p) for s, c, t, p in automaton.rows()}
    assert len({s for s, _ in form}) < 80
    by_state = defaultdict(float)
    for (s, _), (_, p) in form.items():
        by_state[s] += math.exp(p)
    assert all(abs(total - 1) < 1e-9 for total in by_state.values())
    assert secret_scan.log_likelihood("abab", form) > secret_scan.log_likelihood("XX99", form)


# mixing


def test_mix_meets_its_targets(spark):
    draw = random.Random(2)
    rows = []
    for i in range(3000):
        source = draw.choice(["b", "b", "b", "a", "c", None, "d"])
        rows.append((i, " ".join(["w"] * draw.choice([0, 1, 30, 200, 2000])), source))
    rows += [(9001, None, "a"), (9002, "", "zero"), (5, "w w", "a"), (5, "w w", "a"), (9003, "w " * 50_000, "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[order.index(r["source"])])
        taken[r["source"]] += r["taken"]
    for s, g in zip(order, goal, strict=True):
        assert abs(taken[s] - g) <= 0.02 * g + 64 * 12
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(table.limit(0)).collect() == []


def taken_one_slot_after_the_other(spark, rows, block=64, seed=17):
    """What the mix takes of each row, by a walk over the schedule: a source's words in a row, cut into blocks that its slots take in turn."""
    ids = spark.createDataFrame([(r[0],) for r in rows], "id long").distinct()
    h = {r["id"]: r["h"] for r in ids.select("id", F.xxhash64(F.lit(seed), "id").alias("h")).collect()}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    own = {s: sorted(((h[i], i is not None, i, len((t or "").split()), k) for k, (i, t, x) in enumerate(rows) if x == s), key=lambda d: (d[0], d[1], d[2] or 0, d[3])) for s in sources}
    sizes = [sum(d[3] for d in own[s]) for s in sources]
    goal = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5, 2.0)
    blocks = [-(-n // block) for n in sizes]
    slots = [g * b / n if n else 0.0 for g, b, n in zip(goal, blocks, sizes)]
    edges = [round(sum(slots[:i]) / sum(slots) * 2**40) for i in range(len(slots) + 1)]
    rank, uses = [0] * len(sources), Counter()
    for n in range(round(sum(slots))):
        point = int(f"{n:040b}"[::-1], 2)
        at = next(i for i in range(len(sources)) if edges[i] <= point < edges[i + 1])
        if rank[at] < math.floor(2.0 * blocks[at]):
            uses[at, rank[at] % blocks[at]] += 1
        rank[at] += 1
    out = [0] * len(rows)
    for at, s in enumerate(sources):
        start = 0
        for *_, n, k in own[s]:
            out[k] = sum(uses[at, w // block] for w in range(start, start + n))
            start += n
    return out


def test_mix_takes_what_a_walk_over_the_schedule_takes(spark):
    draw = random.Random(12)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 5, 63, 64, 65, 400])), draw.choice(["b", "b", "a", "é", None])) for i in range(400)]
    rows += [(None, "w w w", "a"), (900, None, "a"), (901, "w " * 5000, "z"), (902, "", "none")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    want = sorted(zip((r[0] for r in rows), taken_one_slot_after_the_other(spark, rows)), key=str)
    assert sorted(((r["doc_id"], r["taken"]) for r in got), key=str) == want


def test_targets_share_what_the_full_ones_leave():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2.0) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([1, 0, 1000], [5, 2, 1], 1.5, 2.0) == pytest.approx([2, 0, 1499.5])
    assert mixing.targets([], [], 1.5, 2.0) == []


def test_schedule_points_are_counted_exactly():
    n = np.arange(300)
    points = mixing.reversed_bits(n).astype(np.int64)
    assert len(set(points)) == 300
    for bound in (0, 1, 1 << 39, (1 << 40) // 3, 1 << 40):
        want = [int((points[:k] < bound).sum()) for k in range(300)]
        assert mixing.points_below(n, np.full(300, bound)).tolist() == want


# decontamination


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)} or ({" ".join(words)} if words else set())


@pytest.mark.parametrize("bits", [24, 7])
def test_containment_equals_brute_force(spark, bits):
    draw = random.Random(6)
    word = lambda: draw.choice("ab cd ef gh".split()) + str(draw.randrange(60))
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 3, 5, 9, 40, 120])))) for i in range(60)]
    items += [(100, None), (101, " "), (0, items[0][1]), (None, "lone item of six words here")]
    rows = []
    for i in range(150):
        parts = [word() for _ in range(draw.randrange(200))]
        own = draw.choice(items)[1] or ""
        words = own.upper().split()
        for _ in range(draw.randrange(4)):
            if words:
                words[draw.randrange(len(words))] = "XX"
        rows.append((i, "\n".join([*parts, *words, *[word() for _ in range(20)]])))
    rows += [(500, None), (501, ""), (3, rows[3][1]), (None, items[5][1]), (502, "z " * 200_000 + items[7][1])]
    got = decontamination.contaminated(docs(spark, *rows), spark.createDataFrame(items, "item_id long, text string"), bits=bits)
    want = []
    for d, t in rows:
        have = shingles(t)
        for i, x in items:
            own = shingles(x)
            n = len(own & have)
            if own and n >= 0.8 * len(own) - 1e-9:
                want.append((d, i, len(own), n))
    assert sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert len(want) > 20
    assert decontamination.contaminated(docs(spark, (1, "a b")), spark.createDataFrame([], "item_id long, text string")).collect() == []


# quality


def kneser_ney(trained, order=4):
    """Interpolated modified Kneser-Ney by its definition, over characters."""
    pad = "\x02" * (order - 1)
    counts = [Counter() for _ in range(order + 1)]
    for t in trained:
        s = pad + t
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k in range(1, order + 1):
        n = [max(1, sum(v == i for v in counts[k].values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        discount[k] = [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        same = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        total = sum(same.values())
        spare = sum(discount[k][min(n, 3) - 1] for n in same.values())
        n = same.get(gram, 0)
        return (n - discount[k][min(n, 3) - 1] if n else 0) / total + spare / total * p(gram[1:])

    return lambda text: sum(math.log(p((pad + text)[i : i + order])) for i in range(len(text)))


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_perplexity_equals_the_definition(spark, most):
    trained = ["abracadabra", "abba cab", "a dab", "cadabra abra"]
    seen = [*trained, "zzz", "abz", "ba", "", None]
    tables = quality.model_tables(spark.createDataFrame([(t,) for t in trained], "text string"))
    given = spark.createDataFrame([(i, "en", t) for i, t in enumerate(seen)] + [(0, "en", seen[0])], "id long, lang string, text string")
    rows = quality.log_probabilities(given, tables, most).collect()
    assert len(rows) == len(seen) + 1
    exact = kneser_ney(trained)
    for r in rows:
        assert r["logp"] == pytest.approx(exact(seen[r["id"]] or ""), abs=1e-9)


def test_judgement_by_language(spark):
    good = [(i, f"the cat number {i} sat on the mat and then it went home", "en") for i in range(30)] + [(100 + i, f"der hund nummer {i} ging heim", "de") for i in range(30)]
    bad = [(200, "xq zvk jjj qqq wwx", "en"), (201, None, "en"), (202, "", "de"), (203, "zzzz", None), (204, good[3][1], "en")]
    table = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string")
    trusted = table.filter("doc_id < 200").select("doc_id")
    got = {r["doc_id"]: r for r in quality.judge(table, trusted).collect()}
    assert sum(got[i]["kept"] for i, *_ in good) >= 55
    assert not got[200]["kept"] and not got[201]["kept"] and got[201]["perplexity"] is None and not got[202]["kept"] and not got[203]["kept"] and got[204]["kept"]
    assert got[203]["lang"] == "und" and got[203]["bound"] is not None
    none = quality.judge(table, trusted.limit(0)).collect()
    assert len(none) == 65 and all(r["kept"] and r["perplexity"] is None for r in none)
    assert quality.judge(table.limit(0), trusted).collect() == []


def test_unseen_clean_texts_are_kept_and_long_ones_read_whole(spark):
    draw = random.Random(9)
    vocabulary = {lang: ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 5))) for _ in range(300)] for lang, parts in (("en", ["the", "ing", "er", "st", "on"]), ("fr", ["eau", "que", "ou", "le", "ai"]))}
    text = lambda lang, n: " ".join(draw.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, text(lang, draw.randrange(60, 120)), lang, "x", "x") for i, lang in enumerate(["en"] * 240 + ["fr"] * 60)]
    long = text("en", 260_000)
    rows += [(900, long, "en", "x", "x"), (901, "\u00e9\u4f60 zq " * 300, "en", "x", "x"), (3, rows[3][1], "en", "x", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity string, bound string")
    trusted = table.filter("doc_id < 300 and doc_id % 2 = 0").select("doc_id")
    got = quality.judge(table, trusted).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    for low, high in ((0, 240), (240, 300)):
        unseen = [i for i in range(low, high) if i % 2]
        assert sum(kept[i] for i in unseen) >= 0.9 * len(unseen)
    assert kept[900] and not kept[901]
    tables = quality.model_tables(table.filter("doc_id < 300").select("text"))
    whole = quality.log_probabilities(table.filter("doc_id = 900").select("doc_id", "lang", "text").toDF("id", "lang", "text"), tables).first()
    (shard,) = quality.shards(tables)
    assert len(long) > 1 << 20 and whole["logp"] == pytest.approx(float(shard.log_probability(quality.ngrams(long)).sum()), rel=1e-9)


# models


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_are_told_apart(spark, documents):
    model = language_id.fit(documents)
    odd = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "123 !!", "x"), (None, "the cat and the dog", "x"), (-4, "the " * 400_000, "x")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3 and got[None]["lang_pred"] == got[-4]["lang_pred"] == "en"
    found = language_id.predict(documents, model).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    rows = found.select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    nothing = language_id.fit(documents.limit(0))
    assert nothing is None and {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_the_language_model_equals_its_definition(spark):
    """Bucket counts against a loop over n-grams, FTRL against a plain one with dense weights, TF-IDF against sums, on a small table."""
    texts = ["Der Hund, 12 läuft", "the dog runs", "le chien  court!", "ÉTÉ"]

    def grams(text):
        m = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else " " for c in text)
        m = re.sub(" +", " ", f" {m} ")
        return m

    def hashed(text):
        out, m, mask = np.zeros(language_id.BUCKETS, int), [ord(c) for c in grams(text)], 0xFFFFFFFF
        for i in range(len(m)):
            one = m[i] * 0x9E3779B1 & mask
            two = (one * 31 + m[i + 1] * 0x85EBCA77) & mask if i + 1 < len(m) else None
            three = (two * 31 + m[i + 2] * 0xC2B2AE3D) & mask if i + 2 < len(m) else None
            for h in (one, two, three):
                if h is not None:
                    h ^= h >> 15
                    out[(h * 0x2C1B3C6D & mask) >> (32 - language_id.BITS)] += 1
        return out

    counts = [hashed(t) for t in texts]
    assert all(np.array_equal(language_id.bucket_counts(t), c) for t, c in zip(texts, counts, strict=True))
    n, df = language_id.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert n == 4 and np.array_equal(df, sum((c > 0).astype(int) for c in counts))
    idf = np.log((1 + n) / (1 + df)) + 1
    dense = [np.append(x / np.linalg.norm(x), 1.0) for x in (np.log1p(c) * idf for c in counts)]
    rows, y = [(np.flatnonzero(x), x[np.flatnonzero(x)], k % 2) for k, x in enumerate(dense)], [0, 1, 0, 1]
    z, s = np.zeros((language_id.BUCKETS + 1, 2)), np.zeros((language_id.BUCKETS + 1, 2))
    solved = lambda: np.where(np.abs(z) <= 0.02, 0.0, -(z - np.sign(z) * 0.02) / ((1 + np.sqrt(s)) / 0.5 + 0.02))
    order = np.random.default_rng(5)
    for _ in range(4):
        for k in order.permutation(4):
            w = solved()
            p = np.exp(dense[k] @ w)
            g = dense[k][:, None] * (p / p.sum() - np.eye(2)[y[k]])
            z += g - (np.sqrt(s + g * g) - np.sqrt(s)) / 0.5 * w
            s += g * g
    assert np.allclose(language_id.ftrl(rows, 2), solved())
    table = spark.createDataFrame([(1, texts[0], "x")] * 2 + [(2, None, "x")], "doc_id long, text string, score string")
    model = language_id.Model(["de", "en"], idf, solved(), 1.0)
    got = sorted(map(tuple, language_id.predict(table, model).collect()))
    assert len(got) == 3 and got[0] == got[1] and got[2][2] == "und" and language_id.predict(table.limit(0), model).collect() == []


def test_held_out_is_by_crc32_of_the_id(spark):
    rows = spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_toxic_texts_score_higher(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(documents, labels)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "you idiot " * 30_000)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in model.score(odd).collect())
    known = labels.filter(toxicity.held_out("doc_id")).filter("toxic is not null").groupBy("doc_id").max("toxic").toDF("doc_id", "y")
    rows = model.score(documents.select("doc_id", "text")).join(known, "doc_id").select("score", "y").collect()
    toxic, clean = [r["score"] for r in rows if r["y"]], [r["score"] for r in rows if not r["y"]]
    if toxic and clean:
        auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / len(toxic) / len(clean)
        assert auc >= 0.85
    with pytest.raises(ValueError, match="results"):
        model.score(odd.withColumnRenamed("text", "score"), text="score")
    constant = toxicity.fit(documents, labels.filter("toxic = 0"))
    assert {r["score"] for r in constant.score(odd).collect()} == {0.0}


def plain_features(text, learned):
    """The features by their definition, word by word."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    edge, leet = toxicity._EDGE, toxicity._LEET
    insults = veiled = you = known = odd = shouted = stretched = 0
    best, hits, called = 0.0, [], []
    for i, raw in enumerate(words):
        word = raw.strip(edge)
        low = word.lower()
        hit = False
        if low.isalpha():
            hit = low in toxicity.INSULTS
            insults += hit
        elif any(map(str.isalpha, low)):
            odd += 1
            low = "".join(filter(str.isalpha, low.translate(leet)))
            hit = low in toxicity.INSULTS
            veiled += hit
        weight = max(learned.get(t, 0.0) for t in (low, low[:4] + "*", low[:5] + "*", low[:6] + "*"))
        known += weight > 0
        best = max(best, weight)
        if hit or weight:
            hits.append(i)
        if low in toxicity.YOU:
            called.append(i)
        shouted += len(word) > 2 and word.isupper()
        stretched += bool(re.search(r"(.)\1\1", low))
    near = sum(any(abs(i - j) <= 5 for j in hits) for i in called)
    solid = "".join(words)
    capitals, letters, marks = sum(map(str.isupper, solid)), sum(map(str.isalpha, solid)), sum(c in edge for c in solid)
    return [
        insults / n, math.log1p(insults), known / n, math.log1p(known), best, veiled / n, len(called) / n, near / n, capitals / max(letters, 1),
        shouted / n, marks / len(text), text.count("!") / len(text), odd / n, stretched / n, math.log1p(n),
    ]


def test_features_equal_their_definition():
    draw = random.Random(12)
    learned = {"fine": 1.5, "terr*": 0.7, "awful*": 2.5}
    vocabulary = "you You! idiot IDIOT 1d10t fiiine fine, terrible awfully (crétin) 42 -- YOUR dich É\u2028x x\u00a0y sch…ade 𝒳 aaa".split(" ")
    texts = [None, "", " \n ", "é" * 10 + "!" * 3, "  you 1d10t!  ", "you idiot " * 3000]
    texts += [draw.choice([" ", "\n", "  "]).join(draw.choice(vocabulary) for _ in range(draw.randrange(60))) for _ in range(300)]
    got = toxicity.features(pa.array(texts, pa.string()), learned)
    assert np.allclose(got, [plain_features(t, learned) for t in texts], atol=1e-12)
    assert toxicity.features(pa.array(["", None], pa.string()), {}).tolist() == [[0.0] * len(toxicity.FEATURES)] * 2
    alone = [toxicity.features(pa.array([t], pa.string()), learned)[0] for t in texts]
    assert np.array_equal(alone, got)


def test_toxicity_judges_a_batch_in_parts_of_bounded_memory():
    draw = random.Random(8)
    words = ["you", "IDIOT!", "1d10t", "sooo", "community", *("".join(draw.choices("abcdefg", k=5)) for _ in range(3000))]
    texts = [None, "", *(" ".join(draw.choices(words, k=500)) for _ in range(2000)), "  "]
    learned = {"comm*": 2.5}
    batch, few = pa.array(texts, pa.string()), pa.array(texts[:5] + texts[-4:], pa.string())
    want = toxicity.features(few, learned)
    tracemalloc.start()
    got = toxicity.features(batch, learned)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (len(texts), len(toxicity.FEATURES))
    assert np.array_equal(got[[*range(5), *range(-4, 0)]], want)
    assert held < 2 * batch.nbytes


def test_toxicity_of_clashing_columns_and_empty_tables(spark):
    names = ["features", "margin", "probability", "prediction", "raw", "calibrated", "_features", "_id", "_h", "part", "toxic"]
    rows = [(i, f"you idiot number {i}" if i % 2 else f"a calm text number {i}") for i in range(400)]
    table = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(None, 1), (3, None), (5, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = model.score(table)
    assert got.columns == [*table.columns, "score", "predicted"]
    assert all(r["predicted"] == r["doc_id"] % 2 and [r[n] for n in names] == ["x"] * len(names) for r in got.collect())
    assert model.score(table.limit(0)).count() == 0
    for docs_, labels_ in ((table.limit(0), labels), (table, labels.limit(0))):
        none = toxicity.fit(docs_, labels_)
        assert {r["score"] for r in none.score(table).collect()} == {0.0}


def test_the_first_rows_by_hash(spark):
    from millrace.llm.common import first_by_hash

    table = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    assert [r["id"] for r in first_by_hash(table, "h", 70).collect()] == [r["id"] for r in table.orderBy("h").limit(70).collect()]
    assert first_by_hash(table.limit(0), "h", 5).count() == 0 and first_by_hash(table, "h", 9000).count() == 5000
