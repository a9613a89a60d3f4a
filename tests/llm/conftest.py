"""Documents with every awkward case."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, key int, size string, label int, bucket int, near int, tokens int"
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30", "other")
ROWS = [
    (1, BASE, "en"), (2, BASE, "en"), (3, NEAR, "fr"), (4, "", None), (5, None, "en"), (6, "  \n\t ", "de"), (7, "one two", "en"), (7, "one two", "en"),
    (8, "One  two", "en"), (9, "long " + "x" * 300_000 + " tail", "en"), (10, "12 34 !!", "es"), (None, "no id here", "en"), (None, BASE, None),
    (11, "alpha beta gamma delta epsilon\nalpha beta gamma delta epsilon\nunlike this line at all\n\nalpha beta gamma delta zeta", "en"),
    (12, "Alpha  beta gamma delta epsilon\nzeta eta", "fr"), (13, "été où ça <|endoftext|> 日本語 😀", "fr"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, lang, "s", None, "h", 1, "z", None, 3, 4, 5) for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
