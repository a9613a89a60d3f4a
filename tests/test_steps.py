"""The correction steps in order, against each step alone; choice of steps."""

from __future__ import annotations

import pytest
from helpers import DATA

from dramaturg.operators import steps as S
from dramaturg.plans import relations as P


def rows(df):
    return sorted(tuple(r) for r in df.select("dataset", "owner", "ep", "partner", "role").collect())


def test_steps_run_in_order_and_log(spark):
    claims, steps = P.claims(spark, DATA), P._steps(spark, DATA)
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    want = claims
    for name in ("status_tiers", "short_stays"):
        want = keep(dict(steps)[name](want))
    got, log = S.run_steps(claims, steps, keep, only=["short_stays", "status_tiers"])
    assert rows(got) == rows(want) and [x["step"] for x in log] == ["status_tiers", "short_stays"] and log[1]["rows"] == len(rows(want))
    same, plan = S.run_steps(claims, steps, keep, skip=["continuity"], dry_run=True)
    assert same is claims and len(plan) == len(steps) - 1 and all(x["dry_run"] for x in plan)
    with pytest.raises(ValueError):
        S.run_steps(claims, steps, keep, only=["none"])


def test_corrections_leave_no_short_stay_or_unbacked_tier(spark):
    found = P.QUERIES["correction_pipeline"](spark, DATA).collect()
    assert found and all(r["old_role"] != r["new_role"] for r in found)
    assert any(r["old_role"] is None for r in found) and any(r["new_role"] is None for r in found)


def test_corrections_make_the_claims_once(spark):
    """The comparison at the end reads the claims as they were made for the first step."""
    assert P.QUERIES["correction_pipeline"](spark, DATA).inputFiles() == []
