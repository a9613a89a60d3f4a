"""Text rules that need loops or names of the row: Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs that end a quotation, and first-person words with their third-person forms.
SAID = "said|says|asked|asks|replied|replies|whispered|murmured|shouted"
THIRD_PERSON = {
    "male": {"i am": "he is", "i'm": "he's", "i was": "he was", "i": "he", "me": "him", "my": "his", "mine": "his", "myself": "himself"},
    "female": {"i am": "she is", "i'm": "she's", "i was": "she was", "i": "she", "me": "her", "my": "her", "mine": "hers", "myself": "herself"},
    "other": {"i am": "they are", "i'm": "they're", "i was": "they were", "i": "they", "me": "them", "my": "their", "mine": "theirs", "myself": "themselves"},
}


def clean_narration(text: Column) -> Column:
    """Speech alone: ``"A," he said, "b."`` becomes ``A, b.``; texts without a quotation mark stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        middle = re.compile(rf'([,.!?])"\s+[^"]*?\b(?:{SAID})\b[^"]*?"\s*')
        tail = re.compile(rf'([,.!?])"\s+[^"]*?\b(?:{SAID})\b[^"]*$')

        def one(t):
            if t is None or '"' not in t:
                return t
            before = None
            while before != t:
                before, t = t, middle.sub(r"\1 ", t)
            t = tail.sub(r"\1", t)
            return re.sub(r" {2,}", " ", t.replace('"', "")).strip()

        return texts.map(one, na_action="ignore")

    return clean(text)


def third_person(text: Column, gender: Column) -> Column:
    """First person to third by the gender of the row; capital at the start of a sentence."""

    @F.pandas_udf("string")
    def turn(texts: pd.Series, genders: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(texts, genders, strict=True):
            if t is None:
                out.append(None)
                continue
            forms = THIRD_PERSON.get((g or "").lower(), THIRD_PERSON["other"])
            words = "|".join(sorted(map(re.escape, forms), key=len, reverse=True))

            def put(m, forms=forms, t=t):
                new = forms[m[0].lower()]
                start = m.start() == 0 or re.search(r"[.!?]\s+$", t[: m.start()])
                return new[0].upper() + new[1:] if start else new

            out.append(re.sub(rf"(?i)(?<![A-Za-z'])(?:{words})(?![A-Za-z'])", put, t))
        return pd.Series(out)

    return turn(text, gender)


def pair_event(text: Column, a: Column, b: Column, words: list[str]) -> Column:
    """Whether a sentence of the text names both and has one of the words (the names are the row's)."""

    @F.pandas_udf("boolean")
    def test(texts: pd.Series, ones: pd.Series, twos: pd.Series) -> pd.Series:
        verb = re.compile(r"(?i)\b(?:" + "|".join(words) + r")\b")
        out = []
        for t, x, y in zip(texts, ones, twos, strict=True):
            names = [re.compile(rf"(?i)\b{re.escape(n)}\b") for n in (x, y) if n]
            sentences = re.split(r"(?<=[.!?])\s+", t or "")
            out.append(len(names) == 2 and any(verb.search(s) and all(n.search(s) for n in names) for s in sentences))
        return pd.Series(out, dtype=bool)

    return test(text, a, b)
