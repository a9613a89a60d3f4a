"""Readers of varying layouts, report sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from dramaturg.operators import reports as R
from dramaturg.sources import layouts as L


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_session_archives_of_every_shape(spark, tmp_path):
    row = lambda i: {"session_id": f"s{i}", "episode": "S01E01", "significance": "high", "summary": "x"}
    put(tmp_path / "Ann_session_archive.json", [row(1), row(2)])
    put(tmp_path / "Bo_session_archive.json", {"sessions": [row(3)]})
    put(tmp_path / "Cy_session_archive.json", {"archive": [row(4)]})
    put(tmp_path / "Di_session_archive.json", {"Di": [row(5)], "Ed": [row(6)]})
    put(tmp_path / "other.json", [row(7)])
    got = sorted((r["character"], r["session_id"]) for r in L.session_archives(spark, str(tmp_path)).collect())
    assert got == [("Ann", "s1"), ("Ann", "s2"), ("Bo", "s3"), ("Cy", "s4"), ("Di", "s5"), ("Di", "s6")]
    assert L.session_archives(spark, str(tmp_path / "none")).count() == 0


def test_ratings_logs_and_summaries(spark, tmp_path):
    for name, body in (("a", [{"id": 1}]), ("b", {"ratings": [{"id": 2}]}), ("c", {"items": [{"id": 3}]}), ("d", {"x": {"id": 4}, "y": {"id": 5}})):
        put(tmp_path / f"{name}.json", body)
    ids = [sorted(r["id"] for r in L.ratings(spark, str(tmp_path / f"{n}.json"), "struct<id int>").collect()) for n in "abcd"]
    assert ids == [[1], [2], [3], [4, 5]]
    put(tmp_path / "log.json", {"updates": [{"id": 9}]})
    assert [r["id"] for r in L.optional_log(spark, str(tmp_path / "log.json"), "struct<id int>", ["updates", "audits"]).collect()] == [9]
    assert L.optional_log(spark, str(tmp_path / "gone.json"), "struct<id int>", ["updates"]).count() == 0
    put(tmp_path / "summary.json", {"n": 3})
    put(tmp_path / "broken.json", "{not json")
    assert [r["n"] for r in L.earlier_summary(spark, str(tmp_path / "summary.json"), "n int").collect()] == [3]
    assert L.earlier_summary(spark, str(tmp_path / "broken.json"), "n int").count() == 0 == L.earlier_summary(spark, str(tmp_path / "no.json"), "n int").count()


def test_layout_fallback_and_kinds(spark, tmp_path):
    put(tmp_path / "m" / "train" / "scores.jsonl", '{"id": 1}\n{"id": 2}\n')
    put(tmp_path / "m" / "scores.jsonl", '{"id": 3}\n')
    got = {(r["split"], r["id"]) for r in L.split_or_flat_scores(spark, str(tmp_path / "m"), ["train", "ood"], "scores.jsonl", "id int").collect()}
    assert got == {("train", 1), ("train", 2)}
    flat = L.split_or_flat_scores(spark, str(tmp_path / "m"), ["random"], "scores.jsonl", "id int").collect()
    assert [(r["split"], r["id"]) for r in flat] == [("all", 3)]
    assert L.split_or_flat_scores(spark, str(tmp_path / "no"), ["train"], "scores.jsonl", "id int").columns == ["id", "split"]
    put(tmp_path / "x.json", [{"id": 4}])
    put(tmp_path / "x.csv", "id\n5\n")
    spark.range(3).write.parquet(str(tmp_path / "set"))
    assert [L.local_dataset(spark, str(tmp_path / n), s).count() for n, s in (("m/scores.jsonl", "id int"), ("x.json", "id int"), ("x.csv", "id int"), ("set", None))] == [1, 1, 1, 3]


def test_profiles_by_method_and_tasks(spark, tmp_path):
    sources = {"tree": ("trees_{split}.json", "text"), "plain": ("plain.json", "text"), "context": None}
    put(tmp_path / "trees_train.json", {"Ann": {"text": "calm"}, "Bo": {"other": 1}})
    put(tmp_path / "plain.json", {"Ann": "quiet"})
    read = lambda m: {r["key"]: r["profile_text"] for r in L.profile_texts(spark, str(tmp_path), m, "train", sources).collect()}
    assert read("tree") == {"Ann": "calm"} and read("plain") == {"Ann": "quiet"} and read("context") == {}
    put(tmp_path / "tasks" / "b.yaml", "metric: rouge\nname: 'two'\n# note\n")
    put(tmp_path / "tasks" / "a.yaml", "metric: f1\n")
    rows = L.task_registry(spark, str(tmp_path / "tasks")).collect()
    assert [r["task_name"] for r in rows] == ["a", "b"] and rows[1]["settings"] == {"metric": "rouge", "name": "two"}


def test_caches_and_commits(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(4)

    for key in ("k1", "k1", "k2"):
        assert L.cached(spark, str(tmp_path / "cache"), key, build).count() == 4
    assert len(made) == 2
    rows = spark.range(100)
    L.checkpointed_write(rows, str(tmp_path / "out"), "id", 3)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    L.checkpointed_write(rows, str(tmp_path / "out"), "id", 3)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(100))
    assert L.backed_up_path("/x/snap/", "20240101") == "/x/snap.20240101"


def test_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a_b", 1.5, None), ("c", 2.0, 3)], "method string, mean double, n int").orderBy("method")
    assert R.rendered_markdown(rows, ["method", "mean", "n"]) == "| method | mean | n |\n| --- | --- | --- |\n| a_b | 1.500 | - |\n| c | 2.000 | 3 |\n"
    tex = R.rendered_latex(rows, ["method", "mean", "n"])
    assert r"a\_b & 1.500 & -- \\" in tex and tex.startswith(r"\begin{tabular}{lll}")
    R.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert json.loads(L.json_report(rows, str(tmp_path / "json")))[1] == {"method": "c", "mean": 2.0, "n": 3}


def test_weighted_draws_are_as_asked(spark):
    sizes = spark.createDataFrame([("a", 10, 3.0), ("b", 1000, 1.0)], "name string, n bigint, w double")
    rows = R.drawn_with_replacement(sizes, "name", "n", "w", 20_050, 100, 3).collect()
    share = sum(r["name"] == "a" for r in rows) / len(rows)
    assert len(rows) == 20_000 and abs(share - 0.75) < 0.02 and {r["row"] for r in rows if r["name"] == "a"} == set(range(10))
    assert max(r["row"] for r in rows) < 1000 and max(r["batch"] for r in rows) == 199
    again = R.drawn_with_replacement(sizes, "name", "n", "w", 20_050, 100, 3).filter(F.col("draw") < 5).collect()
    assert sorted(again) == sorted(rows)[:5]
    many = spark.range(2000).select(F.col("id").cast("string").alias("name"), (F.col("id") % 7).alias("n"), (F.col("id") % 3).cast("double").alias("w"))
    found = R.drawn_with_replacement(many, "name", "n", "w", 30_000, 100, 3).collect()
    assert len(found) == 30_000 and len({r["name"] for r in found}) == sum(i % 7 > 0 and i % 3 > 0 for i in range(2000))
    assert R.first_rows(many, ["name"], 3).count() == 3
