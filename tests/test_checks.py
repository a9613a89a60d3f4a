"""Edge rows of parsers, gates and timelines."""

from __future__ import annotations

from helpers import DATA
from pyspark.sql import functions as F

from dramaturg.functions import parsers as P
from dramaturg.operators import agreement, checks, dialogue, evaluate, profiles, retrieval, sampling, state
from dramaturg.streaming.windows import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_parsers(spark):
    assert one(spark, P.scene_id(F.lit("S01E12_c10"))) == "s01_e12_c10" and one(spark, P.scene_id(F.lit("x"))) is None
    assert one(spark, P.key_values(F.lit("junk\nA: 1\nmore\n\n姓名：李\nA: 2"))) == {"A": "1 more", "姓名": "李"}
    assert one(spark, P.key_values(F.lit(""))) == {}
    assert one(spark, F.size(P.turns(F.lit("Ann (thinking): hm<|eot|>junk<|eot|>")))) == 1


def test_context_and_samples(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "ALL", " "), (1, 2, "assistant", "a b c"), (1, 3, "assistant", "a\nb c"), (1, 4, "assistant", "a b"), (2, 0, "assistant", "a b c d")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = dialogue.next_utterance_samples(turns, ["assistant"]).collect()
    assert [(r["input"], r["output"]) for r in got] == [("user: hi\nassistant: a b c", "a b c")]
    assert [r["turn"] for r in dialogue.last_target_samples(turns, "assistant").collect()] == [4]


def test_as_of_is_strict(spark):
    samples = spark.createDataFrame([(1, 5), (1, 4), (2, 1)], "k int, t int")
    snapshots = spark.createDataFrame([(1, 4, "p01"), (1, 5, "p02")], "k int, t int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in state.as_of(samples, snapshots, "k", "t", "v", "p00").collect()}
    assert got == {(1, 5): "p01", (1, 4): "p00", (2, 1): "p00"}


def test_gate_bounds(spark):
    base = {"resistance": "low", "episodes": 20, "high": 9, "medium": 0, "since_update": 20, "old_value": "x" * 10, "new_value": "y" * 8, "recall": 0.5, "merge_type": "merge", "field_exists": True}
    cases = [({}, "accepted"), ({"new_value": "y" * 7}, "too_short"), ({"recall": 0.49}, "forgets"), ({"since_update": 1}, "cooldown"), ({"since_update": 2}, "accepted"), ({"high": 0, "medium": 1}, "threshold"), ({"new_value": "y", "merge_type": "replacement"}, "accepted"), ({"resistance": "core", "since_update": 15}, "cooldown"), ({"new_value": " "}, "empty"), ({"field_exists": False}, "no_field")]
    schema = "resistance string, episodes int, high int, medium int, since_update int, old_value string, new_value string, recall double, merge_type string, field_exists boolean, want string"
    rows = spark.createDataFrame([(*(base | c).values(), w) for c, w in cases], schema)
    assert rows.withColumn("got", state.update_gate()).filter("got <> want").count() == 0


def test_evidence_age(spark):
    rows = spark.createDataFrame([("medium", 1), ("medium", 2), ("high", 1)], "significance string, ep int")
    got = [r[0] for r in rows.select(state.evidence_status(F.lit(10), F.lit(False))).collect()]
    assert got == ["expired", "active", "active"]


def test_gaps(spark):
    days = [(1, e, "a" if e in (1, 10, 20) else None) for e in range(1, 21)]
    got = {r["ep"]: r["filled"] for r in state.fill_gaps(spark.createDataFrame(days, "k int, ep int, v string"), "k", "ep", "v", 8).collect()}
    assert got[5] == "a" and got[15] is None and got[20] == "a"


def test_statistics_of_small_groups(spark):
    deltas = spark.createDataFrame([("m", 0.0), ("m", 0.0), ("n", 1.0)], "method string, delta double")
    got = {r["method"]: r for r in evaluate.paired_comparison(deltas, "method").collect()}
    assert got["m"]["cohen_d"] == 0 and got["m"]["ties"] == 2 and got["m"]["t"] is None and got["n"]["wins"] == 1
    votes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "a"), (2, "b")], "i int, l string")
    assert {r["i"]: r["consensus"] for r in agreement.majority(votes, "i", "l").collect()} == {1: "partial", 2: "a"}
    flat = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0)], "g int, x double, y double")
    assert agreement.pearson(flat, ["g"], "x", "y").first()["r"] is None


def test_top_k_ties_and_zero_vectors(spark):
    pool = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    got = retrieval.top_k(pool, pool.filter("vec_id = 1"), 3).orderBy("place").collect()
    assert [(r["vec_id"], round(r["similarity"], 6)) for r in got] == [(2, 1.0), (3, 1.0), (4, 0.0)]
    blocks = retrieval.top_k(pool, pool, 1, block=2).collect()
    assert {r["query_id"] for r in blocks} == {1, 2, 3, 4}
    assert one(spark, retrieval.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0


def test_quotas_add_up(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 50), ("c", 49)], "g string, n bigint")
    got = {r["g"]: r["quota"] for r in sampling.proportional_quotas(counts, "g", "n", 10).collect()}
    assert sum(got.values()) == 10 and got["a"] == 1


def test_strongest_role(spark):
    rows = spark.createDataFrame([(1, "friend is Ann, ex-wife is Ann, sister is Bo, friend is Bo")], "k int, t string")
    got = profiles.rendered(profiles.strongest(profiles.edges(rows, "k", "t"), "k"), "k").first()
    assert got["relationships"] == "ex-wife is Ann, sister is Bo"


def test_rater_mismatch(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(1,)], "i int")
    assert [tuple(r) for r in checks.rater_mismatch({"a": a, "b": b}, "i").collect()] == [(2, "a")]


def test_sessions(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "u int, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in sessions(e, "u", "t").collect()) == [1, 2]


def test_top_k_is_bounded_in_memory_and_keeps_ties_over_tiles():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    base = np.random.default_rng(1).normal(size=(500, 8))
    vectors = np.tile(base, (8, 1))  # each vector comes eight times
    ids, queries = np.arange(4000), np.arange(0, 4000, 4)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(vectors))], names=["vec_id", "embedding"])
    matrix = vectors[queries] / np.linalg.norm(vectors[queries], axis=1, keepdims=True)
    tracemalloc.start()
    got = list(retrieval._best(iter([batch]), queries, matrix, None, 5))[0].to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6  # all products at once are 32 MB, their order as much again
    found = got.groupby("query_id")["vec_id"].apply(sorted)
    assert all(found[q] == [i for i in range(q % 500, 4000, 500) if i != q][:5] for q in queries)
