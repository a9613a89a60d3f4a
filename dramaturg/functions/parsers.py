"""Parsers of semi-structured dialogue texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scene_id(text: Column) -> Column:
    """``S01E12_c10`` and the like as ``s01_e12_c10``; null if season, episode or scene is missing."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"(?i)s(\d+)[_\s]*e(\d+)[_\s]*c(\d+)", i), F.lit("")).cast("int")
    return F.when(part(1).isNotNull(), F.format_string("s%02d_e%02d_c%02d", part(1), part(2), part(3)))


def key_values(text: Column) -> Column:
    """``key: value`` lines as a map; lines without a key continue the value before, joined by a space.

    Keys begin with a letter and have up to 36 characters; the colon may be full-width. The first
    value of a key that comes twice stays.
    """
    key = r"^\s*([A-Za-z\p{IsHan}][^:：]{0,35})[:：]\s*(.*)$"
    none = F.array().cast("array<struct<key string, value string>>")

    def add(done: Column, line: Column) -> Column:
        name = F.trim(F.regexp_extract(line, key, 1))
        fresh = F.struct(name.alias("key"), F.trim(F.regexp_extract(line, key, 2)).alias("value"))
        last = F.element_at(done, -1)
        longer = F.struct(last["key"].alias("key"), F.concat_ws(" ", F.nullif(last["value"], F.lit("")), F.trim(line)).alias("value"))
        return (
            F.when(name != "", F.concat(done, F.array(fresh)))
            .when((F.size(done) > 0) & (F.trim(line) != ""), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))
            .otherwise(done)
        )

    pairs = F.aggregate(F.split(text, "\n"), none, add)
    first = F.filter(pairs, lambda e, i: F.array_position(F.transform(pairs, lambda p: p.key), e.key) == i + 1)
    return F.map_from_entries(first)


def turns(text: Column, end: str = "<\\|eot\\|>") -> Column:
    """``speaker, action, content`` of turns like ``Ann (thinking): hm``; others are dropped."""
    pattern = r"^\s*([^():]+?)\s*\((speaking|thinking)\)\s*:\s*(.*)$"
    parts = F.transform(
        F.split(text, end),
        lambda p: F.struct(*[F.regexp_extract(p, "(?s)" + pattern, i).alias(n) for i, n in ((1, "speaker"), (2, "action"), (3, "content"))]),
    )
    return F.filter(parts, lambda t: t.speaker != "")


def protagonist(text: Column) -> Column:
    """The name after ``You are``, ``Your name is`` or ``Act as``; the first pattern that matches."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"You are ([^,.]+)[,.]", r"Your name is ([^,.]+)[,.]", r"Act as ([^,.]+)[,.]")]
    return F.coalesce(*found)


def age(text: Column) -> Column:
    """Years from ``34 years old``, ``34-year-old`` or ``age: 34``."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)(\d{1,3})[- ]years?[- ]old", r"(?i)\bage:?\s*(\d{1,3})\b")]
    return F.coalesce(*found).cast("int")


def gender(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(r"\b(woman|female|girl)\b"), "Female").when(low.rlike(r"\b(man|male|boy)\b"), "Male")
