"""Every pipeline stage on awkward rows: clashing and null ids, repeats, null and long texts, more columns, no rows."""

from __future__ import annotations

import collections

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from dramaturg.llm import sharding


def spelled(c, n=60):
    return " ".join(f"{c}{i}" for i in range(n))


def stages():
    import corpus_pipeline as P

    return dict(P.STAGES)


def test_no_text_is_lost_for_its_id(spark):
    a, b, c = spelled("a"), spelled("b"), spelled("c")
    rows = [(7, a), (7, b), (1, a + " z"), (2, b + " z"), (3, c), (3, c), (4, c), (None, c + " z"), (None, spelled("d")), (None, None), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [tuple(r) for r in stages()["near_duplicates"](spark, docs, DATA).collect()]
    # of each family one text stays: an id with several texts, or none, comes first
    assert collections.Counter(kept) == collections.Counter([(7, a), (7, b), (None, c + " z"), (None, spelled("d")), (None, None), (9, ""), (9, None)])


def test_repeated_rows_stay_together(spark):
    docs = spark.createDataFrame([(3, spelled("c")), (3, spelled("c")), (4, spelled("c")), (5, spelled("e"))], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in stages()["near_duplicates"](spark, docs, DATA).collect()) == [3, 3, 5]


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "mixing", "sharding"])
def test_awkward_rows_and_no_rows(spark, awkward, nothing, name):
    docs = awkward.withColumn("_score", F.lit("own")).withColumn("_key", F.lit(1)).withColumn("_items", F.lit("x")).withColumn("shard", F.lit("y"))
    out = stages()[name](spark, docs, DATA)
    if name == "sharding":
        assert set(out.columns) == {*docs.columns, "slot"} and out.count() == docs.count()
    else:
        assert out.columns == docs.columns
        texts = {r["text"] for r in docs.collect()}
        assert {r["text"] for r in out.collect()} <= texts
    assert stages()[name](spark, nothing, DATA).count() == 0


@pytest.mark.parametrize("key", [None, 5])
def test_one_row_repeated_fills_all_shards(spark, key):
    docs = spark.range(20_000).select(F.lit(key).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text"))
    rows = sharding.shard(docs, 24).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["_shard"]].append(r["_slot"])
    assert len(rows) == 20_000 and len(by) == 24 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.02 * min(map(len, by.values()))
