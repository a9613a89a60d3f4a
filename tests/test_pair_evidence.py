"""Golden sentences for each predicate, with every discard."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dramaturg.functions import pair_evidence as E

CASES = {
    "has_breakup": (
        [
            "Ann broke up with Bob.", "After lunch Bob dumped  Ann.", "She finally ended her relationship with Bob.", "Ann and Bob are no longer together.", "He mourns his breakup with Bob.", "Bob walked out on Ann in May.",
            "Ann experienced a painful breakup as Bob moved away.", "It was the end of their romance; sad. Ann and Bob face the end of their engagement.", "Ann is leaving for Paris without Bob.",
            "Cid made the difficult decision to end their relationship with Bob.", "Ann stood by, encouraging Cid to pursue Bob.", "Ann called it off with Bob.", "ANN SPLIT UP WITH BOB",
        ],
        [
            "Ann comforted Bob after the end of their game.", "Ann told Bob of the end of their trial and of his relationship with Julie; the end of the romance.", "Ann decided to leave the dinner to be with her friend, Bob.", "Ann met Bob. They broke up the party.",
            "Joann broke up with Bobby.", "Ann left. Bob stayed.", "Ann ended her relationship with Julie for Bob.", "", "Ann and Bob sang.",
        ],
    ),
    "has_reconciliation": (
        ["Ann and Bob got back together.", "Bob reunited with Ann.", "Ann proposes to Bob!", "Bob and Ann move in together.", "Happy, Ann told Bob that she reaffirmed her commitment.", "Ann marries Bob."],
        ["Ann rekindles with Cid while Bob looks on.", "They got back together. Ann and Bob watched.", "Cid and Bob got back together.", "Ann alone got married"],
    ),
    "has_engagement": (
        [
            "Ann and Bob got engaged.", "She became engaged to Bob while Ann slept.", "Ann popped the question and Bob said yes.", "The engagement between Bob and Ann was told.", "Ann proposes to Bob. Everyone hears of their engagement to be; Ann is happy about their engagement.",
            "Bob got a marriage proposal from Ann. Bob accepted the proposal.",
        ],
        [
            "Ann proposes to Bob.", "Ann proposes to Bob on a dice roll. Ann and Bob got tired.", "Ann is planning to propose to Bob. Ann is newly engaged in work.", "Ann was pressured by Cid to propose to Bob. Bob is newly engaged.", "Bob rejected Ann, who proposed to Bob. Bob is newly engaged.", "Ann proposes to Bob. Cid and Dot are newly engaged.",
        ],
    ),
    "has_marriage": (
        [
            "Ann marries Bob.", "Bob and Ann are now married.", "Ann, watched by all, becomes Bob's wife.", "Ann spoke of her marriage to Bob.", "Ann loves her husband Bob.", "Ann smiled as Bob married her in Rome.",
            "Ann and Bob exchanged vows. They go on their honeymoon.", "Ann and Bob tied the knot. Newlyweds!",
        ],
        [
            "Ann is planning to marry Bob.", "Ann and Bob exchanged vows.", "Ann and Bob choose a wedding venue.", "Ann and Bob exchanged vows at a wedding cake tasting. Honeymoon later.", "Ann did not marry Bob, who married her sister.", "Cid and Dot tied the knot. Ann and Bob go on their honeymoon.", "Ann and Bob pretended to be married and exchanged vows; honeymoon",
        ],
    ),
    "has_settled": (["Ann and Bob move in together.", "On their wedding day Ann kissed Bob.", "Ann and Bob said their vows."], ["Ann and Bob got engaged.", "They got married. Ann met Bob."]),
    "owned_by": (
        ["Cid helped Ann's new friend Bob.", "Cid supported Ann through her breakup with Bob.", "Ann's long relationship with poor Bob", "Bob and Ann dined", "Ann told of a kiss at night with Bob"],
        ["Ann saw Bob.", "Cid's friend Bob met Ann.", "Ann went home. Her date with Bob was off."],
    ),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_golden_sentences(spark, name):
    yes, no = CASES[name]
    rows = [(t, True) for t in yes] + [(t, False) for t in no]
    frame = spark.createDataFrame(rows, "text string, want boolean").withColumn("got", getattr(E, name)(F.col("text"), F.lit("Ann"), F.lit("Bob")))
    assert [r["text"] for r in frame.filter("got <> want").collect()] == []


def test_names_of_the_row(spark):
    rows = [
        ("C++ broke up with A.B", "C++", "A.B", True), ("C++ broke up with AxB", "C++", "A.B", False), ("Zoë broke up with D'Arcy\\E", "zoë", "d'arcy\\E", True), ("Ann Lee broke up with Ann", "Ann Lee", "Ann", True),
        ("Ann broke up with Ann", "Ann", "Ann", False), (None, "Ann", "Bob", False), ("Ann broke up with Bob", None, "Bob", False), ("Ann broke up with Bob", "", "Bob", False), ("Zoëy went; they broke up with Bob", "Zoë", "Bob", True), ("Zoë left Bobby", "Zoë", "Bob", False),
    ]
    frame = spark.createDataFrame(rows, "text string, a string, b string, want boolean")
    assert frame.filter(E.has_breakup(F.col("text"), F.col("a"), F.col("b")) != F.col("want")).collect() == []
    assert frame.select(E.names(F.lit("So zoë came"), F.col("a")).alias("x")).filter("x").count() == 3
