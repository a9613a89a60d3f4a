"""Text expressions over columns: Column in, Column out, no Python in the rows' path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column, digits: int = 12) -> Column:
    """``prefix`` and the first hex digits of the MD5 of the parts joined with ``_``."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]).cast("binary")), 1, digits))


def digest_id(prefix: str, *parts: Column, digits: int = 10) -> Column:
    """As :func:`stable_id` with parts joined by ``|``."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, digits))


def speaker_of(line: Column) -> Column:
    """What stands before the first colon; empty without one."""
    return F.when(F.instr(line, ":") > 0, F.trim(F.substring_index(line, ":", 1))).otherwise("")


def speech_of(line: Column) -> Column:
    at = F.instr(line, ":")
    return F.when(at > 0, F.trim(F.substring(line, at + F.lit(1), F.length(line)))).otherwise(F.trim(line))


def without_parentheses(text: Column) -> Column:
    """Half- and full-width parenthesised spans go, white space is squeezed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), r"（[^）]*）", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def flattened(text: Column) -> Column:
    """Line breaks with the white space around them become one space."""
    return F.trim(F.regexp_replace(text, r"\s*\n\s*", " "))


def without_quotes(text: Column) -> Column:
    return F.trim(F.translate(text, '「」"', ""))


def truncated(text: Column, n: int) -> Column:
    """Blank lines collapse; beyond ``n`` characters the text is cut and ends in `` …``."""
    text = F.trim(F.regexp_replace(text, r"\n\s*\n+", "\n"))
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n)), F.lit(" …"))).otherwise(text)


def slug(text: Column, default: str = "role") -> Column:
    made = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(made == "", default).otherwise(made)


def character_id(*names: Column) -> Column:
    """The first non-empty name in lower case, spaces and middle dots as ``_``, other signs gone."""
    first = F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names], F.lit("unknown"))
    return F.regexp_replace(F.regexp_replace(F.lower(first), "[ ·]+", "_"), r"[^\w]", "")


def ascii_letter_share(text: Column) -> Column:
    """Share of ASCII letters among all characters; null for an empty text."""
    return F.regexp_count(text, F.lit("[a-zA-Z]")) / F.nullif(F.length(text), F.lit(0))


def entry_language(text: Column) -> Column:
    """``en`` if over half of the characters are ASCII letters, else ``zh``."""
    return F.when(ascii_letter_share(text) > 0.5, "en").otherwise("zh")


def cjk_share(text: Column) -> Column:
    dense = F.regexp_replace(text, r"\s", "")
    return F.regexp_count(dense, F.lit("[一-鿿]")) / F.nullif(F.length(dense), F.lit(0))


def is_chinese(text: Column) -> Column:
    return F.coalesce(cjk_share(text) > 0.3, F.lit(True))


def position_number(position: Column, word: str) -> Column:
    """The number after ``word`` in a position such as ``Book3-chapter12``; null without one."""
    return F.nullif(F.regexp_extract(position, f"{word}(\\d+)", 1), F.lit("")).cast("int")


def episode_ordinal(tag: Column) -> Column:
    """``S02E05`` as 205; -1 for anything else."""
    season, episode = (F.regexp_extract(tag, r"S(\d+)E(\d+)", i) for i in (1, 2))
    return F.when(season == "", F.lit(-1)).otherwise(F.nullif(season, F.lit("")).cast("int") * 100 + F.nullif(episode, F.lit("")).cast("int"))


def episode_tag(season: Column, episode: Column) -> Column:
    return F.format_string("S%02dE%02d", season, episode)


def time_bucket(episode: Column) -> Column:
    """early up to 2, mid up to 5, late beyond; unknown is mid."""
    return F.when(episode.isNull(), "mid").when(episode <= 2, "early").when(episode <= 5, "mid").otherwise("late")


def field_stratum(field: Column) -> Column:
    return (
        F.when(field.isin("personality", "speaking_style"), "core")
        .when(field == "relationships", "relationships")
        .when(field == "behavioral_tendencies", "behavioral")
        .otherwise("factual")
    )


def normalised_label(text: Column) -> Column:
    """supported, partial or unsupported; the longer word is tested first; null if none fits."""
    low = F.lower(F.trim(text))
    return (
        F.when(low.isin("supported", "partial", "unsupported"), low)
        .when(low.contains("unsupported"), "unsupported")
        .when(low.contains("partial"), "partial")
        .when(low.contains("supported"), "supported")
    )


def after_thinking(text: Column) -> Column:
    """The text after the first closing thinking mark; all of it without one."""
    at = F.instr(text, "</think>")
    return F.when(at > 0, F.ltrim(F.substring(text, at + F.lit(8), F.length(text)))).otherwise(text)


def significance_mark(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def next_version(version: Column) -> Column:
    """``p07`` becomes ``p08``."""
    return F.format_string("p%02d", F.regexp_extract(version, r"p(\d+)", 1).cast("int") + 1)


def bullets(attributes: Column, none: str = "(none)") -> Column:
    """``- key: value`` lines of the non-empty entries of a map."""
    entries = F.filter(F.map_entries(attributes), lambda e: e.value.isNotNull() & (F.trim(e.value) != ""))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e.key, F.lit(": "), e.value)), "\n")
    return F.when(F.size(entries) > 0, lines).otherwise(none)


def known(value: Column) -> Column:
    """Null for the usual ways to write that a value isn't known."""
    # fixed values
    unknown = ["", "unknown", "n/a", "none", "null", "无", "未知"]
    return F.when(F.lower(F.trim(value)).isin(unknown), F.lit(None)).otherwise(F.trim(value))


def distinctive_words(text: Column, stop_words: list[str]) -> Column:
    """Distinct words of three or more ASCII letters that aren't stop words."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), 1)), F.array(*map(F.lit, stop_words)))


def word_recall(old: Column, new: Column, stop_words: list[str]) -> Column:
    """Share of the old text's distinctive words that the new one keeps; 1 if there is none."""
    words = distinctive_words(old, stop_words)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, distinctive_words(new, stop_words))), F.size(words)), F.lit(1.0))


def relationship_entries(text: Column) -> Column:
    """``<role> is <Name> (note)`` parts of a comma list as structs; commas in parentheses don't split."""
    parts = F.filter(F.transform(F.split(text, r",(?![^()]*\))"), lambda x: F.trim(x)), lambda p: p != "")
    pattern = r"^(.+?)\s+(?:is|are)\s+([^(]+?)\s*(?:\(.*\))?$"
    return F.transform(
        parts,
        lambda p: F.struct(F.lower(F.regexp_extract(p, pattern, 1)).alias("role"), F.regexp_extract(p, pattern, 2).alias("name"), p.alias("raw")),
    )


def json_body(text: Column) -> Column:
    """The JSON object in a model's answer: out of its fence, without trailing commas."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def judged(text: Column, field: str, least: int = 1, most: int = 5) -> Column:
    """A score from a judge's answer: the JSON field, else the number after its name; null outside its range."""
    parsed = F.get_json_object(json_body(text), f"$.{field}")
    loose = F.nullif(F.regexp_extract(text, rf'"?{field}"?\s*[:=]\s*"?(\d+)', 1), F.lit(""))
    value = F.coalesce(parsed.try_cast("int"), loose.try_cast("int"))
    return F.when(value.between(least, most), value)
