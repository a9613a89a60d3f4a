"""The episode fold: one scene for each rule, and laws over the tables."""

from __future__ import annotations

from helpers import DATA

from dramaturg.operators import fold as F
from dramaturg.plans import registry


def seen(i, ep, significance="high", character=1, partner=9, happening="other"):
    return {"dataset": 0, "character": character, "ep": ep, "event_id": i, "significance": significance, "partner": partner, "happening": happening}


def wish(ep, value, cited, field="hobby", resistance="low", character=1, merge="replacement", i=0):
    return {"dataset": 0, "character": character, "ep": ep, "proposal_id": i, "field": field, "resistance": resistance, "new_value": value, "merge_type": merge, "cited": cited}


def outcomes(evidence, proposals):
    return [(r[0], r[1], r[5], r[7]) for r in F.folded(evidence, proposals)]


def test_gate_in_its_order():
    ev = [seen(1, 1), seen(2, 1, "medium"), seen(3, 2, "low"), seen(4, 6), seen(5, 6), seen(6, 6), seen(7, 6), seen(8, 6), seen(9, 30)]
    got = outcomes(ev, [
        wish(1, "x", [77], i=0), wish(1, "x", [2], i=1), wish(1, "", [1], i=2), wish(1, "x", [1], resistance="none", i=3), wish(1, "long walks at night", [1], i=4),
        wish(2, "y", [4], i=5), wish(6, "walks", [4], merge="incremental", i=6), wish(6, "entirely different pastimes", [4], merge="incremental", i=7),
        wish(6, " long walks at night ", [4], i=8), wish(6, "long walks at night, chess", [4], merge="incremental", i=9), wish(7, "z", [5], i=10),
        wish(30, "calm", [9], field="style", resistance="moderate", i=11), wish(30, "calm", [1, 4, 9], field="style", resistance="moderate", i=12), wish(30, "kind", [1, 4, 9], field="traits", resistance="core", i=13),
    ])
    assert [g[2] for g in got] == [
        "no_evidence", "threshold", "empty", "no_field", "accepted", "no_evidence", "too_short", "forgets", "no_change", "accepted", "cooldown", "threshold", "accepted", "threshold",
    ]


def test_evidence_expires_and_is_consumed():
    ev = [seen(1, 1, "medium"), seen(2, 1, "medium"), seen(3, 1), seen(4, 20)]
    got = outcomes(ev, [wish(9, "a", [1, 2], i=0), wish(10, "b", [1, 2], field="food", i=1), wish(10, "c", [3], field="food", i=2), wish(20, "d", [3], field="music", i=3)])
    assert [g[2] for g in got] == ["accepted", "no_evidence", "accepted", "no_evidence"]


def test_only_what_could_be_cited_is_consumed():
    ev = [seen(i, 1, "medium") for i in range(25)]
    line = F.Timeline(ev, {1})
    line.go_to(1)
    assert line.citable(list(range(25)), 1, 1, "low") == list(range(5, 25))
    # the first five weren't among the latest twenty, so they are left for the next proposal
    got = outcomes(ev, [wish(1, "a", list(range(25)), i=0), wish(1, "b", list(range(25)), field="food", i=1), wish(1, "c", list(range(25)), field="music", i=2)])
    assert [g[2] for g in got] == ["accepted", "accepted", "no_evidence"]


def test_time_grows_with_the_rows():
    import time

    def took(n):
        ev = [seen(i, i // 20, "medium" if i % 3 else "high", i % 7, i % 5, ("romance", "breakup")[i % 2]) for i in range(n)]
        asked = [rel(e, f"girlfriend is U{e % 5}, friend is U{e % 7}", list(range(20 * e, 20 * e + 5)), (20 * e) % 7, e) for e in range(n // 20)]
        began = time.process_time()
        F.folded(ev, asked)
        return time.process_time() - began

    took(2000)
    assert took(32_000) < 8 * took(8_000) + 1


def rel(ep, value, cited, character=1, i=0):
    return wish(ep, value, cited, "relationships", "low", character, "replacement", i)


def test_relationship_guards():
    ev = [seen(1, 1), seen(2, 5), seen(3, 9), seen(4, 13), seen(5, 1, character=2), seen(6, 13, partner=9, happening="breakup"), seen(7, 14), seen(8, 18), seen(9, 18, partner=9, happening="breakup")]
    got = outcomes(ev, [
        rel(1, "friend is U9, wife is U9, sister is Ann, girlfriend is U2", [1], i=0),  # duplicate; nothing tells of U2
        rel(5, "boss is Bo", [2], i=1),  # family and wife come back
        rel(9, "sister is Ann, ex-wife is U9, boss is Bo", [3], i=2),  # no breakup: as before, so no change
        rel(13, "sister is Ann, ex-wife is U9, boss is Bo", [4], i=3),
    ])
    assert got[0][3] == "wife is U9, sister is Ann" and got[1][3] == "boss is Bo, wife is U9, sister is Ann"
    # the wife comes back as she is, so only the order differs
    assert got[2][2] == "accepted" and got[2][3] == "sister is Ann, wife is U9, boss is Bo"
    assert got[3][3] == "sister is Ann, ex-wife is U9, boss is Bo"


def test_borrowed_partners_and_order_within_an_episode():
    told = [seen(1, 1, character=1, partner=3, happening="romance"), seen(2, 1, character=2, partner=3, happening="romance"), seen(3, 1, character=3)]
    got = outcomes(told, [rel(1, "girlfriend is U3", [1], 1, 0), rel(1, "girlfriend is U3, friend is U1", [2], 2, 1)])
    assert got == [(1, 1, "accepted", "girlfriend is U3"), (2, 1, "accepted", "friend is U1")]  # the first of the episode has her


def test_auto_ex_and_decay():
    ev = [seen(1, 1), seen(2, 3, happening="breakup"), seen(3, 1, character=2, partner=1, happening="romance"), seen(4, 1, character=2, partner=1), seen(5, 11, character=2), seen(6, 12, character=2)]
    got = outcomes(ev, [rel(1, "wife is U9", [1], 1, 0), rel(1, "girlfriend is U1", [4], 2, 1)])
    assert (1, 3, "auto_ex", "ex-wife is U9") in got
    assert [g for g in got if g[2] == "decay"] == [(2, 11, "decay", "ex-girlfriend is U1")]


def test_fold_of_the_tables_keeps_its_laws(spark):
    log = registry.QUERIES["episode_fold"](spark, DATA).toPandas()
    assert {"accepted", "threshold", "cooldown", "no_evidence"} <= set(log.outcome)
    made = log[log.version.notna()].sort_values(["dataset", "seq"])
    for _, rows in made.groupby(["dataset", "character"]):
        assert rows.version.tolist() == list(range(1, len(rows) + 1))  # versions have no gaps
    gate = {"hobby": 2, "style": 3, "traits": 16, "relationships": 2}
    for (_, _, field), rows in log[log.outcome == "accepted"].groupby(["dataset", "character", "field"]):
        assert (rows.sort_values("seq").ep.diff().dropna() >= gate[field]).all()
    assert log.groupby("dataset").seq.apply(lambda s: sorted(s) == list(range(len(s)))).all()
