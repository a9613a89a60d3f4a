"""Readers, writers and staleness on small files."""

from __future__ import annotations

import datetime
import json

import pytest

from dramaturg.sources import files


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "s": 2}\n\nbad\n{"id": null, "s": 3}\n{"id": 1, "s": 5}\n')
    schema = "id int, s int"
    assert files.json_lines(spark, str(tmp_path / "a.jsonl"), schema, strict=False).count() == 3
    assert files.bad_lines(spark, str(tmp_path / "a.jsonl"), schema).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    rows = files.keyed_last(files.json_lines(spark, str(tmp_path / "a.jsonl"), schema, strict=False), "id").collect()
    assert [(r["id"], r["s"]) for r in rows] == [(1, 5)]


def test_seasons_and_sessions(spark, tmp_path):
    for n in (1, 2):
        scene = {"scene_id": f"s{n}", "utterances": [{"speakers": ["A"], "transcript": "x"}, {"speakers": ["A", "B"], "transcript": "y"}]}
        (tmp_path / f"season_{n:02d}.json").write_text(json.dumps({"episodes": [{"episode_id": "e", "scenes": [scene]}]}))
    got = files.season_files(spark, str(tmp_path), [2]).collect()
    assert [(r["season"], r["scene_id"], r["turn"], len(r["speakers"])) for r in got] == [(2, "s2", 0, 1), (2, "s2", 1, 2)]
    (tmp_path / "map.json").write_text(json.dumps({"a": {"position": "Book1-chapter2", "dialogue": ["x: y"]}, "b": {"position": "Book12-chapter1", "dialogue": []}}))
    assert [r["session_id"] for r in files.session_map(spark, str(tmp_path / "map.json"), 1).collect()] == ["a"]


def test_discovery(spark, tmp_path):
    for method, body in (("m1", "{}\n"), ("m2", ""), ("_old", "{}\n")):
        d = tmp_path / f"track=t/method={method}/split=s"
        d.mkdir(parents=True)
        (d / "scores.jsonl").write_text(body)
    found = files.discovered(spark, str(tmp_path))
    assert [r["method"] for r in found.collect()] == ["m1"]
    later = datetime.datetime(2100, 1, 1)
    assert files.stale(found, spark.createDataFrame([("m1", later)], "method string, summarised_at timestamp")).count() == 0
    assert files.stale(found, spark.createDataFrame([], "method string, summarised_at timestamp")).count() == 1
