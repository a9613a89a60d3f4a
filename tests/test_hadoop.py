"""Discovery by the skip rules; overwriting that stops at each of its steps."""

from __future__ import annotations

import shutil

import pytest

from dramaturg.sources import hadoop as H


def test_discovery_skips_what_holds_no_results(spark, tmp_path):
    def put(*names, text="{}"):
        place = tmp_path.joinpath(*names)
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(text)

    put("shows", "dialogue", "main", "lora", "test", "judge_a.jsonl")
    put("shows", "dialogue", "main", "lora", "test", "judge_b.jsonl", text="{}{}")
    put("shows", "dialogue", "main", "lora", "val", "judge_a.jsonl", text="")
    put("shows", "dialogue", "main", "prompt", "test", "other.jsonl")
    for hidden in ("_old", ".git", "figures", "generated_loras"):
        put("shows", "dialogue", "main", hidden, "test", "judge_a.jsonl")
        put("shows", hidden, "main", "lora", "test", "judge_a.jsonl")
    put("shows", "judge_a.jsonl")
    rows = H.discovered_methods(spark, str(tmp_path)).collect()
    assert [(r["dataset"], r["track"], r["method"], r["split"], r["files"], r["bytes"]) for r in rows] == [("shows", "dialogue", "lora", "test", 2, 6)]
    assert H.discovered_methods(spark, str(tmp_path / "absent")).count() == 0


@pytest.fixture
def snap(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert H.overwritten(spark.range(3), path, "0") is None
    return path


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(path).collect())


def test_overwriting_keeps_the_old(spark, snap):
    # the new rows are read from the place that they overwrite
    backup = H.overwritten(spark.read.parquet(snap).filter("id > 0"), snap, "20240101")
    assert backup == f"{snap}.20240101" and ids(spark, snap) == [1, 2] and ids(spark, backup) == [0, 1, 2]
    with pytest.raises(FileExistsError):
        H.overwritten(spark.range(1), snap, "20240101")
    assert ids(spark, snap) == [1, 2]


@pytest.mark.parametrize("stop", [0, 1])
def test_an_interrupted_overwrite_is_finished(spark, snap, monkeypatch, stop):
    real, calls = H._moved, []

    def moved(spark, old, new):
        if len(calls) == stop:
            raise KeyboardInterrupt
        calls.append(old)
        real(spark, old, new)

    monkeypatch.setattr(H, "_moved", moved)
    with pytest.raises(KeyboardInterrupt):
        H.overwritten(spark.range(5), snap, "1")
    monkeypatch.undo()
    # before the old one is moved it stays; after that the new one, which is complete, takes its place
    assert H.recovered(spark, snap) == ("whole" if stop == 0 else "finished")
    assert ids(spark, snap) == ([0, 1, 2] if stop == 0 else [0, 1, 2, 3, 4]) and not H.exists(spark, f"{snap}.new")
    assert H.recovered(spark, snap) == "whole"


def test_without_a_complete_new_one_the_old_comes_back(spark, snap, tmp_path):
    shutil.move(snap, f"{snap}.1")
    (tmp_path / "snap.new").mkdir()
    assert H.recovered(spark, snap) == "taken_back" and ids(spark, snap) == [0, 1, 2] and not H.exists(spark, f"{snap}.new")
    assert H.recovered(spark, str(tmp_path / "absent")) == "nothing"
