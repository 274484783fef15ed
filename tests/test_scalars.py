from __future__ import annotations

import hashlib
import json
import pickle
from datetime import UTC, datetime

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import retry
from millrace.functions.retry import Patience, SourceFailure
from millrace.functions import scalars as S


def column(spark, values, kind, make):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}").select("i", make(F.col("c")).alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


def iso(text):
    try:
        d = datetime.fromisoformat(text)
    except (ValueError, TypeError):
        return None
    return (d.replace(tzinfo=UTC) if d.tzinfo is None else d.astimezone(UTC)).isoformat()


def test_iso_texts(spark):
    texts = [
        "2026-03-02T09:00:00", "2026-03-02", "20260302T090000", "2026-03-02T09:00:00Z", "2026-03-02 09:00:00.123456+05:30", "2026-W10-1", "2026W101T10", "2026", "2026-3-2",
        "bad", "", None, "2026-03-02T09", "2026-03-02T09:00:00.1234567-0330", "2026-02-30", "2026-W54-1", "2026-03-02T25:00:00", "2026-03-02T09:00:00,5", " 2026-03-02",
    ]
    assert column(spark, texts, "string", lambda c: S.iso_text(S.utc_timestamp(c))) == [iso(t) for t in texts]


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from("\x00\x0b\x1a\x1f\x7f\x80\\\"u0B/"), max_size=30), min_size=1, max_size=40))
@example(texts=["a\x7fb", "a\x0bb", "a\x1fb", "\\u000B", "\\\x0b\x0b\\\\\x1a", "é\x7f\x1f\\u001F", "".join(map(chr, range(256))), "x" + "".join(map(chr, range(0x20))) + "x"])
def test_content_hash_is_that_of_sorted_ascii_json(spark, texts):
    found = column(spark, texts, "string", lambda c: S.content_hash(S.entries_of(F.create_map(F.lit("é"), c), subject=c, kind=F.lit(None).cast("string"))))
    want = [hashlib.sha256(json.dumps({"extra.é": t.strip(), "subject": t.strip(), "kind": ""}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for t in texts]
    assert found == want


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from("\x00\x0b\x1a\x1f\x7f\x80\\\"u0B/"), max_size=30), min_size=1, max_size=40))
@example(texts=["a\x7fb", "a\x0bb", "\\u000B", "\\\x0b\x0b\\\\\x1a", "é\x7f\x1f\\u001F", "".join(map(chr, range(256))), "plain \\ text", ""])
def test_the_hash_of_plain_fields_is_the_content_hash(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.strip(F.col("t")).alias("t"))
    rows = rows.withColumn("json", S.plain_json(subject=F.col("t"), body=F.lit(None).cast("string"))).select("i", S.plain_hash(F.col("json")), S.content_hash(S.entries_of(F.create_map().cast("map<string,string>"), subject=F.col("t"), body=F.lit(None).cast("string"))))
    want = [hashlib.sha256(json.dumps({"body": "", "subject": t.strip()}, separators=(",", ":")).encode()).hexdigest() for t in texts]
    assert [tuple(r) for r in sorted(rows.collect())] == [(i, w, w) for i, w in enumerate(want)]


def test_strip_and_case(spark):
    texts = [" a ", " b ", "\x1cc\n", "", None]
    assert column(spark, texts, "string", S.strip) == ["a", "b", "c", "", None]
    names = ["mary.ann", "o'neil-smith", "x1y", "ÉCOLE d", ""]
    assert column(spark, names, "string", S.title_case) == [n.title() for n in names]
    assert column(spark, ["a@B.c ", "a@@b", "none", "x@"], "string", S.domain_of) == ["b.c", "@b", "", ""]


def test_age_and_bands(spark):
    at = datetime(2026, 1, 10)
    hours = column(spark, [datetime(2026, 1, 9, 23), datetime(2026, 1, 11), None], "timestamp", lambda c: S.age_hours(c, F.lit(at)))
    assert hours == [1.0, 0.0, None]
    assert column(spark, [0.99, 1.0, 23.9, 24.0, 167.9, 168.0, None], "double", S.age_band) == ["under 1h", "1h to 24h", "1h to 24h", "1d to 7d", "1d to 7d", "over 7d", "unknown"]
    with pytest.raises(ValueError, match="unknown bucket"):
        S.bucket_start(F.lit(at), "week")


def test_hours_text_rounds_like_exact_arithmetic(spark):
    values = [i / 20 for i in range(20, 1000)] + [i / 8 for i in range(8, 400)] + [i / 24 for i in range(48 * 24, 60 * 24)] + [i / 120 for i in range(120)]
    want = [f"{v * 60:.0f} min" if v < 1 else f"{v:.1f} h" if v < 48 else f"{v / 24:.1f} d" for v in values]
    assert column(spark, values, "double", S.hours_text) == want


def test_money(spark):
    texts = ["1.005", "2.675", "abc", "", None, " 7 ", "NaN", "0.125"]
    assert column(spark, texts, "string", lambda c: S.money_text(S.exact_amount(c))) == ["1.00", "2.68", "0.00", "0.00", "0.00", "7.00", "0.00", "0.12"]


def test_backoff(spark):
    for n in (1, 2, 5, 9):
        assert column(spark, [n], "int", lambda c: S.backoff_delays(c, 0.5, 2.0, 3.0))[0] == Patience(tries=n, first=0.5, longest=3.0).waits()
    assert Patience(tries=4, longest=None).waits() == [0.5, 1.0, 2.0]
    with pytest.raises(ValueError):
        Patience(tries=0).waits()


def failing(*failures):
    left = list(failures)

    def ask():
        if left:
            raise left.pop(0)
        return {"ok": True}

    return ask


def test_pages_are_asked_for_again_as_told():
    waits, told = [], []
    asked = failing(SourceFailure(retry.OUTAGE, "x"), SourceFailure(retry.THROTTLED, "x", wait=7.0))
    assert Patience().fetch(asked, waits.append, lambda due, failure: told.append((due, failure.kind))) == {"ok": True}
    assert waits == [0.5, 7.0] and told == [(0.5, "outage"), (7.0, "throttled")]
    waits.clear()
    with pytest.raises(SourceFailure, match="third"):
        Patience(tries=3, first=1.0, scattered=True).fetch(failing(*(SourceFailure(retry.OUTAGE, n) for n in ("first", "second", "third"))), waits.append)
    assert len(waits) == 2 and 0 <= waits[0] <= 1 and 0 <= waits[1] <= 2
    with pytest.raises(SourceFailure, match="denied"):
        Patience().fetch(lambda: retry.answer("/p", 403, {}, {}), waits.append)
    assert len(waits) == 2


def test_what_a_status_stands_for():
    assert retry.answer("/p", 204, {}, {"x": 1}) == {"x": 1}
    for status, headers, kind, wait in (
        (429, {"retry-AFTER": "10"}, retry.THROTTLED, 10.0), (429, {"Retry-After": "soon"}, retry.THROTTLED, None), (429, {}, retry.THROTTLED, None),
        (500, {}, retry.OUTAGE, None), (401, {}, retry.DENIED, None), (404, {}, retry.REFUSED, None),
    ):
        with pytest.raises(SourceFailure) as e:
            retry.answer("/p", status, headers, {})
        assert (e.value.kind, e.value.wait, e.value.status) == (kind, wait, status)


def test_failures_carry_what_a_dead_letter_needs():
    bad = pickle.loads(pickle.dumps(SourceFailure(retry.BAD_RECORD, "no time", key="K-1")))
    assert (str(bad), bad.key, bad.category, bad.passes) == ("bad record: no time", "K-1", "poison", False)
    assert SourceFailure(retry.BAD_RECORD, "no key").category == "poison_no_key" and SourceFailure(retry.THROTTLED, "x").category == "transient_exhausted"
