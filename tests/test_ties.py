"""Results that don't hang on the order of rows: sums that tie, updates told twice."""

from __future__ import annotations

from dramaturg.operators import pool
from dramaturg.plans import evaluation


def test_equal_samples_in_another_order_tie(spark, tmp_path):
    rows = [(1, "click", v) for v in (0.1, 0.2, 0.3)] + [(1, "view", v) for v in (0.3, 0.2, 0.1)]
    # 20.3 - 20.2 and 10.1 - 10.2 are as far from zero as each other
    rows += [(2, "click", 20.3), (2, "view", 20.2), (3, "click", 10.1), (3, "view", 10.2), (4, "click", 5.0), (4, "view", 0.0)]
    spark.createDataFrame(rows, "user_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert evaluation.paired_comparison(spark, str(tmp_path)).first()["ties"] == 1
    got = evaluation.wilcoxon_w(spark, str(tmp_path)).first()
    assert (got["n"], got["w_plus"], got["w_minus"]) == (3, 4.5, 1.5)


def test_an_update_told_twice_has_all_that_was_cited(spark):
    told = [("a", [3, 9]), ("a", [3, 1]), ("b", [2, 2]), ("c", [])]
    scenes = spark.createDataFrame([(1, "one", "s"), (2, "two", "s"), (3, "three", "s")], "scene_id bigint, summary string, significance string")
    want = {"a": [(3, False), (1, False), (9, True)], "b": [(2, False), (2, False)], "c": []}
    for rows in (told, told[::-1]):
        got = pool.with_evidence(spark.createDataFrame(rows, "update_id string, evidence_ids array<bigint>").repartition(2), scenes).collect()
        assert len(got) == 4
        assert all([(e["scene_id"], e["missing"]) for e in r["evidence"]] == want[r["update_id"]] for r in got)
