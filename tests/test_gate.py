"""Ids in every way of writing, and what each tier may cite."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dramaturg.operators import gate as G


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("s01_e02_c03", ["s01_e02_c03"]), ("S1E2_c3", ["s01_e02_c03"]), ("Scene s01-e12-c10", ["s01_e12_c10"]), ("S01E22, scene=s01_e22_c02", ["s01_e22_c02"]), ("s1 e2 c123 and s0010_e1_c1", ["s01_e02_c123", "s10_e01_c01"]),
        ("none", []), ("", []),
    ],
)
def test_scene_ids(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(G.scene_ids(F.col("t")).alias("x")).first()["x"] == want


def told(spark, rows):
    return spark.createDataFrame([("d", "a", f"s01_e{ep:02d}_c{i:02d}", ep, sig, status) for i, ep, sig, status in rows], "dataset string, character string, scene_id string, ep int, significance string, status string")


def asked(spark, rows):
    schema = "dataset string, character string, ep int, proposal_id int, field string, resistance string, updated_at int, old_value string, new_value string, merge_type string, cited array<string>"
    return spark.createDataFrame([("d", "a", ep, i, "f", r, at, old, new, merge, ids) for i, ep, r, at, old, new, merge, ids in rows], schema)


def test_what_each_tier_may_cite(spark):
    evidence = told(spark, [(1, 1, "high", "consumed"), (2, 1, "medium", "expired"), (3, 2, "high", "active"), (4, 9, "high", "active"), (5, 2, "low", "active")])
    ids = [f"s01_e{e:02d}_c{i:02d}" for i, e in ((1, 1), (2, 1), (3, 2), (4, 9), (5, 2), (3, 2))]
    rows = asked(spark, [(0, 5, "low", None, "", "x", None, ids), (1, 5, "moderate", None, "", "x", None, ids), (2, 9, "core", None, "", "x", None, ids), (3, 5, None, None, "", "x", None, ids), (4, 5, "low", None, "", "x", None, [])])
    out = {}
    for r in G.citable(rows, evidence).orderBy("place").collect():
        out.setdefault(r["proposal_id"], []).append(int(r["scene_id"][-2:]))
    assert out == {0: [3], 1: [1, 3], 2: [1, 3, 4], 3: [3]}
    assert {r["proposal_id"]: r["decision"] for r in G.decided(rows, evidence, {"low": (0, 1, 2), "moderate": (2, 0, 3), "core": (3, 4, 3)}).collect()} == {
        0: "accepted", 1: "accepted", 2: "few_high", 3: "no_field", 4: "no_evidence",
    }


def test_only_the_latest_medium_evidence_counts(spark):
    evidence = told(spark, [(i, 1 + i // 10, "medium", "active") for i in range(30)])
    ids = [f"s01_e{1 + i // 10:02d}_c{i:02d}" for i in range(30)]
    rows = asked(spark, [(0, 3, "low", None, "", "x", None, ids), (1, 2, "low", None, "", "x", None, ids)])
    found = G.citable(rows, evidence).groupBy("proposal_id").agg(F.min("scene_id").alias("first"), F.count("*").alias("n")).collect()
    assert {r["proposal_id"]: (r["first"], r["n"]) for r in found} == {0: ("s01_e02_c10", 20), 1: ("s01_e01_c00", 20)}


def test_the_value_is_checked_in_order(spark):
    evidence = told(spark, [(1, 1, "high", "active")])
    one, old = ["s01_e01_c01"], "walks along the harbour"
    rows = [
        (0, 3, "low", 2, old, "x", None, one), (1, 3, "low", 1, old, None, None, one), (2, 3, "low", 1, old, "walks", None, one), (3, 3, "low", 1, old, "something else altogether", None, one),
        (4, 3, "low", 1, old, f" {old} ", None, one), (5, 3, "low", 1, old, "chess", "replacement", one), (6, 3, "low", None, None, "chess", None, one), (7, 3, "odd", None, "", "chess", None, one),
    ]
    got = [r["decision"] for r in G.decided(asked(spark, rows), evidence).orderBy("proposal_id").collect()]
    assert got == ["cooldown", "empty", "too_short", "forgets", "no_change", "accepted", "accepted", "accepted"]
