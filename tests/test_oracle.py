"""Every query of the core library that SQL can say equals its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from helpers import DATA, canonical

from dramaturg.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


WITHOUT_SQL = {
    "method_summary_ci": "method", "paired_p_values": "method", "kmeans_three_way_split": "vec_id", "weighted_draws": "draw", "episode_fold": "seq", "correction_pipeline": "owner",
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_queries_without_sql_are_known_and_give_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).filter(f"{WITHOUT_SQL[name]} is not null").count() > 0


def test_three_way_split_takes_whole_clusters(spark):
    rows = registry.QUERIES["kmeans_three_way_split"](spark, DATA).toPandas()
    n = len(rows) // 5
    sizes = rows.split.value_counts()
    assert sizes["ood"] == n and n <= sizes["random"] <= n + 5 and rows.vec_id.is_unique and sizes.sum() == len(rows)
    shares = rows[rows.split == "ood"].groupby("cluster").size() / rows.groupby("cluster").size()
    assert (shares.dropna() < 1).sum() <= 1  # at most one cluster in part


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
