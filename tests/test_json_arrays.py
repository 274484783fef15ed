from __future__ import annotations

import json
import random

import pytest

from millrace.sources import json_arrays
from millrace.sources.files import read_crm_export, read_milestones
from millrace.sources.json_arrays import read_json_arrays, write_json_arrays
from millrace.sources.readers import read_ticket_export

ODD = ['"},{"', "{", "}", "[{", '\\"', "\\", '\\\\"{', "é{", "\n", "", "]", "x" * 300, "{}" * 40, "\U0001f600\\"]


@pytest.fixture
def small_ranges(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def value(draw, depth=0):
    kind = draw.randrange(7 if depth < 4 else 4)
    if kind == 4 or kind == 5:
        return {draw.choice(ODD) + str(i): value(draw, depth + 1) for i in range(draw.randrange(4))}
    if kind == 6:
        return [value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return [draw.choice(ODD), draw.randrange(100), None, True][kind]


def written(folder, texts):
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"{i:03d}.json").write_text(text, encoding="utf-8")
    return str(folder)


def read(spark, path):
    rows = sorted(read_json_arrays(spark, path).collect(), key=lambda r: r["arrival"])
    assert len({r["arrival"] for r in rows}) == len(rows)
    return [json.loads(r["value"]) for r in rows]


@pytest.mark.parametrize("told", [1_000_000, 0])
def test_ranges_give_what_the_whole_gives(spark, tmp_path, small_ranges, monkeypatch, told):
    monkeypatch.setattr(json_arrays, "BROADCAST_ROWS", told)
    draw = random.Random(told)
    whole = [[value(draw) for _ in range(n)] for n in (0, 1, 140, 160)] + [{"a": [{"b": 1}]}, "[{", 5, [[{"x": 1}], {"y": [{}]}, "{", {"z": "}"}], []]
    texts = [json.dumps(w, indent=draw.choice([None, 2]), ensure_ascii=draw.random() < 0.5) for w in whole] + [""]
    path = written(tmp_path / "in", texts)
    assert json_arrays._pieces(spark, path).select("file", "start").distinct().count() > 60
    assert read(spark, path) == [o for w in whole if isinstance(w, list) for o in w if isinstance(o, dict)]


def test_an_object_over_many_ranges(spark, tmp_path, small_ranges):
    whole = [{"a": "{" * 500, "b": [{"c": i} for i in range(50)]}, 7, "}{", {"d": '"' * 300}, {"e": {"f": {}}}]
    assert read(spark, written(tmp_path / "in", [json.dumps(whole)])) == [whole[0], whole[3], whole[4]]


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": "x}]', '[{"a": 1]}', "]", '[{"a": 1}]]'])
def test_what_does_not_match_is_an_error(spark, tmp_path, text):
    with pytest.raises(Exception, match="is no JSON"):
        read(spark, written(tmp_path / "in", [text]))


def test_arrays_written_and_read(spark, tmp_path):
    texts = [json.dumps({"record_id": f"r{i}", "subject": ODD[i % len(ODD)], "occurred_at": f"2026-01-{i % 28 + 1:02d}T00:00:00Z", "contact_email": "a@B.c"}) for i in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "value string").repartition(7)
    write_json_arrays(rows, str(tmp_path / "out"))
    for part in (tmp_path / "out").glob("part-*"):
        assert isinstance(json.loads(part.read_text()), list)
    found = {r["natural_key"]: r for r in read_crm_export(spark, str(tmp_path / "out")).collect()}
    assert {k: r["subject"] for k, r in found.items()} == {f"r{i}": ODD[i % len(ODD)] for i in range(200)}
    write_json_arrays(rows.limit(0), str(tmp_path / "none"))
    assert read(spark, str(tmp_path / "none")) == []


def test_ticket_and_milestone_exports(spark, tmp_path, small_ranges):
    issues = [{"key": f"T-{i}", "fields": {"summary": "}{", "status": {"name": "Done"}, "updated": f"2026-01-0{i + 1}T00:00:00Z", "assignee": {"emailAddress": "a@b.c"}}} for i in range(5)]
    path = written(tmp_path / "in", [json.dumps([*issues, "x"], indent=2)])
    assert sorted((r["natural_key"], r["subject"]) for r in read_ticket_export(spark, path).collect()) == [(f"T-{i}", "}{") for i in range(5)]
    plan = [{"milestone_key": f"M{i}", "name": "{" * i, "planned_end": "2026-02-01", "depends_on": [f"M{i - 1}"] if i else []} for i in range(9)]
    found = sorted(read_milestones(spark, written(tmp_path / "plan", [json.dumps(plan)])).collect())
    assert [(r["milestone_key"], r["name"], r["depends_on"]) for r in found] == [(m["milestone_key"], m["name"], m["depends_on"]) for m in plan]
