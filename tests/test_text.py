"""Golden rows for text rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dramaturg.functions import narration as N
from dramaturg.functions import text as T
from dramaturg.functions.special import normal_two_sided, t_quantile, t_two_sided


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.speaker_of(F.lit("Ann: a: b")), "Ann"),
        (lambda: T.speech_of(F.lit("Ann: a: b")), "a: b"),
        (lambda: T.speaker_of(F.lit("no colon")), ""),
        (lambda: T.without_parentheses(F.lit("a (b) c（d） e")), "a c e"),
        (lambda: T.flattened(F.lit("a \n\n b")), "a b"),
        (lambda: T.truncated(F.lit("abcdef ghi"), 7), "abcdef …"),
        (lambda: T.truncated(F.lit("abc"), 7), "abc"),
        (lambda: T.slug(F.lit("!!")), "role"),
        (lambda: T.slug(F.lit("Dr. Who & co")), "Dr._Who_co"),
        (lambda: T.character_id(F.lit(""), F.lit("Ann Lee")), "ann_lee"),
        (lambda: T.entry_language(F.lit("")), "zh"),
        (lambda: T.is_chinese(F.lit("你好 ab")), True),
        (lambda: T.is_chinese(F.lit("")), True),
        (lambda: T.position_number(F.lit("Book3-chapter12"), "chapter"), 12),
        (lambda: T.position_number(F.lit("none"), "chapter"), None),
        (lambda: T.episode_ordinal(F.lit("S02E05")), 205),
        (lambda: T.episode_ordinal(F.lit("x")), -1),
        (lambda: T.time_bucket(F.lit(None).cast("int")), "mid"),
        (lambda: T.normalised_label(F.lit("It is unsupported.")), "unsupported"),
        (lambda: T.normalised_label(F.lit("fully supported")), "supported"),
        (lambda: T.after_thinking(F.lit("<think>x</think> y")), "y"),
        (lambda: T.next_version(F.lit("p09")), "p10"),
        (lambda: T.known(F.lit(" Unknown ")), None),
        (lambda: T.word_recall(F.lit("the red house"), F.lit("red"), ["the"]), 0.5),
        (lambda: T.word_recall(F.lit("a b"), F.lit("c"), []), 1.0),
        (lambda: T.judged(F.lit('```json\n{"s": 4,}\n```'), "s"), 4),
        (lambda: T.judged(F.lit("s: 9"), "s"), None),
        (lambda: T.significance_mark(F.lit(0.004)), "**"),
        (lambda: F.size(T.relationship_entries(F.lit("wife is Ann (met, once), friends are Bob, junk"))), 3),
        (lambda: T.relationship_entries(F.lit("wife is Ann (met, once)"))[0]["name"], "Ann"),
        (lambda: N.clean_narration(F.lit('"Yes," she said, "go." He said nothing')), "Yes, go."),
        (lambda: N.clean_narration(F.lit("plain")), "plain"),
        (lambda: N.third_person(F.lit("I love my dog. I am Ann."), F.lit("female")), "She loves her dog. She is Ann.".replace("loves", "love")),
        (lambda: N.pair_event(F.lit("Ann left. Bob married Cy."), F.lit("Ann"), F.lit("Bob"), ["married"]), False),
        (lambda: N.pair_event(F.lit("Ann married Bob."), F.lit("Ann"), F.lit("Bob"), ["married"]), True),
    ],
)
def test_text(spark, column, want):
    assert value(spark, column()) == want


def test_tails():
    assert t_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)
    assert normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
