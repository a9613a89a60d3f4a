"""Bonds over season ends, roles apart, decay rule by rule, gaps that may and may not be filled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dramaturg.operators import relations as R


def claims(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "dataset string, owner string, ep int, partner string, role string")


def seen(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


SEASONS = [123, 124, 201, 202, 203, 204]


def test_a_bond_over_a_season_end_is_one_run(spark):
    told = claims(spark, [("a", ep, "b", "girlfriend") for ep in SEASONS])
    assert seen(R.stays(told), "start", "stop", "length") == [(1, 6, 6)]
    assert R.short_stays(told).count() == 0
    short = claims(spark, [("a", 123, "b", "girlfriend"), ("a", 124, "b", "girlfriend"), ("a", 201, "c", "friend"), ("a", 202, "c", "friend")])
    assert seen(R.without_short_stays(short).filter("partner = 'b'"), "ep", "role") == [(123, "friend"), (124, "friend")]


def test_roles_are_runs_of_their_own(spark):
    told = claims(spark, [("a", 1, "b", "girlfriend"), ("a", 2, "b", "wife"), ("a", 3, "b", "girlfriend"), ("a", 4, "b", "Girlfriend")])
    assert seen(R.stays(told), "role", "start", "stop") == [("girlfriend", 1, 1), ("girlfriend", 3, 4), ("wife", 2, 2)]
    # each ends in a state without its role, or with the timeline
    assert seen(R.short_stays(told), "role", "start") == [("girlfriend", 1), ("girlfriend", 3), ("wife", 2)]


def test_a_stay_longer_than_three_or_returned_is_none(spark):
    long = claims(spark, [("a", ep, "b", "girlfriend") for ep in (1, 2, 3, 4)] + [("a", 5, "c", "friend")])
    returned = claims(spark, [("a", 1, "b", "girlfriend"), ("b", 1, "a", "boyfriend"), ("a", 2, "c", "friend")])
    held = claims(spark, [("a", ep, "b", "girlfriend") for ep in (1, 3, 4, 5)] + [("a", 2, "b", "friend")])
    assert R.short_stays(long).count() == 0
    assert seen(R.short_stays(returned), "owner") == [("b",)] or R.short_stays(returned).count() == 0
    assert seen(R.short_stays(held), "start", "stop") == [(1, 1), (3, 5)]


def test_propagation_follows_the_owner_over_the_season_end(spark):
    told = claims(spark, [("a", 124, "b", "girlfriend"), ("a", 201, "b", "girlfriend"), ("b", 124, "x", "friend"), ("b", 201, "a", "friend")])
    assert seen(R.propagated(told).filter("added"), "owner", "ep", "role") == [("b", 124, "boyfriend"), ("b", 201, "boyfriend")]


def gap(spark, rows, **how):
    return seen(R.gap_filled(claims(spark, rows), **how).filter("filled"), "owner", "ep", "partner", "role")


def test_gaps(spark):
    other = [("a", ep, "z", "friend") for ep in (124, 201, 202)]
    bond = [("a", 123, "o", "girlfriend"), ("a", 203, "o", "girlfriend"), *other]
    filled = [("a", 124, "o", "girlfriend"), ("a", 201, "o", "girlfriend"), ("a", 202, "o", "girlfriend")]
    assert gap(spark, bond) == filled and gap(spark, bond, longest=2) == []
    # what else is listed of the partner there gives way
    assert gap(spark, [*bond, ("a", 201, "o", "ex-girlfriend")]) == filled
    # up to three states after the gap count, a role of a lower tier doesn't
    higher = [("a", 1, "o", "wife"), ("a", 2, "z", "friend"), ("a", 3, "o", "girlfriend"), ("a", 4, "o", "girlfriend"), ("a", 5, "o", "wife")]
    assert gap(spark, higher) == [("a", 2, "o", "wife")] and gap(spark, higher[:-1]) == []
    assert gap(spark, [*higher[:-1], ("a", 5, "z", "friend"), ("a", 6, "o", "wife")]) == [("a", 5, "o", "girlfriend")]
    # a main partner must have been there and come back too
    main = [("a", 1, "b", "girlfriend"), ("a", 2, "z", "friend"), ("a", 3, "b", "girlfriend"), ("b", 1, "a", "boyfriend"), ("b", 2, "z", "friend")]
    assert gap(spark, main) == [] and gap(spark, [*main, ("b", 3, "a", "boyfriend")]) == [("a", 2, "b", "girlfriend"), ("b", 2, "a", "boyfriend")]
    broken = spark.createDataFrame([("d", "a", "o", 201)], "dataset string, a string, b string, ep int")
    assert gap(spark, bond, broken=broken) == [] and gap(spark, bond, broken=broken.withColumn("ep", F.lit(123))) == filled


PAIR = "dataset string, owner string, partner string, ep int"


@pytest.mark.parametrize(
    ("rows", "mentions", "settled", "want"),
    [
        # spouses and the engaged never fade, nor does what was never named
        ([("a", 1, "o", "wife"), ("a", 50, "o", "wife")], [("a", "o", 1)], [], [None, None]),
        ([("a", 50, "o", "girlfriend")], [], [], [None]),
        ([("a", 7, "o", "girlfriend"), ("a", 8, "o", "girlfriend")], [("a", "o", 1)], [], [None, "ex-girlfriend forgotten"]),
        ([("a", 8, "o", "one-time encounter")], [("a", "o", 1)], [], ["former one-time encounter forgotten"]),
        ([("a", 8, "o", "girlfriend")], [("a", "o", 1)], [("a", "o", 5)], [None]),
        # main characters are asked, by their latest state
        ([("a", 8, "b", "girlfriend"), ("b", 3, "a", "ex-boyfriend")], [], [], ["ex-girlfriend listed_as_ex", None]),
        ([("a", 1, "b", "girlfriend"), ("a", 11, "b", "girlfriend")], [("a", "b", 1)], [], [None, "ex-girlfriend not_returned"]),
        ([("a", 1, "b", "girlfriend"), ("a", 11, "b", "girlfriend"), ("b", 2, "a", "husband")], [], [], [None, None, None]),
        # one-sided roles ask nobody
        ([("a", 8, "b", "crush"), ("b", 3, "a", "ex-boyfriend")], [("a", "b", 1)], [], ["ex-crush forgotten", None]),
        # a couple role in both neighbouring states shields
        ([("a", 20, "o", "girlfriend"), ("a", 21, "o", "girlfriend"), ("a", 22, "o", "girlfriend")], [("a", "o", 1)], [], ["ex-girlfriend forgotten", None, "ex-girlfriend forgotten"]),
        ([("a", 20, "o", "former lover"), ("a", 20, "p", "ex-wife"), ("a", 20, "q", "friend")], [("a", "o", 1), ("a", "p", 1), ("a", "q", 1)], [], [None, None, None]),
    ],
)
def test_decay(spark, rows, mentions, settled, want):
    cast = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset string, name string")
    told = lambda xs: spark.createDataFrame([("d", *x) for x in xs], PAIR)
    out = {(r["owner"], r["ep"], r["partner"]): f"{r['role']} {r['rule']}" if r["rule"] else None for r in R.decayed(claims(spark, rows), cast, told(mentions), told(settled)).collect()}
    assert [out[r[0], r[1], r[2]] for r in rows] == want


def test_auto_ex_leaves_the_cast(spark):
    told = claims(spark, [("a", 5, "b", "girlfriend"), ("a", 5, "o", "girlfriend"), ("a", 5, "p", "crush")])
    events = spark.createDataFrame([("d", "a", x, 4) for x in "bop"], PAIR)
    cast = spark.createDataFrame([("d", "b")], "dataset string, name string")
    out = R.auto_downgraded(told, events, F.lit(True), F.lit(False), cast)
    assert seen(out, "partner", "role") == [("b", "girlfriend"), ("o", "ex-girlfriend"), ("p", "crush")]
