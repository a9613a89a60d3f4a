"""Cleaning, naming and rendering of texts for prompts and reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that only say that someone spoke, and third-person tails of spoken lines.
STUBS = ["he said.", "she said.", "he said", "she said", "said he.", "said she."]
TAIL_NAMES = "Harry|Ron|Hermione|Dumbledore|Hagrid|Snape|He|She"
TAIL_VERBS = "thought|noticed|stared|felt|saw|looked|remembered|realized|wondered"
# Names that stand for nobody in particular.
NOISE_NAMES = [
    "", "旁白", "Narrator", "观众", "学生", "Student", "百姓A", "保安", "经理", "警察", "顾客", "囚犯", "士兵", "访客", "老人", "老僧", "陌生人", "女子",
    "年轻书生", "大哥", "和尚", "那人", "蒙面人", "黑衣女郎", "青衣少女", "沙溢吕秀才", "大聪明",
]
# Fixed value: what the text embedding of a profile is told to look for.
PROFILE_INSTRUCTION = (
    "Extract and represent key character features that reflect the character's unique traits, preferences, and behavioral patterns from the provided "
    "character profile. Focus on personality, speaking style, relationships, behavioral tendencies, and other attributes that can inform "
    "character-specific response generation."
)
# Labels of a persona's fields in a summary, in their order.
SUMMARY_LABELS = {
    "en": {
        "name": "Name", "gender": "Gender", "backstory": "Backstory", "personality": "Personality", "speaking_style": "Speaking style",
        "behavioral_tendencies": "Behavioral tendencies", "hobbies": "Hobbies", "relationships": "Relationships", "occupation": "Occupation", "demographics": "Demographics",
    },
    "zh": {
        "name": "名字", "gender": "性别", "backstory": "背景", "personality": "性格", "speaking_style": "说话风格",
        "behavioral_tendencies": "行为倾向", "hobbies": "爱好", "relationships": "关系", "occupation": "职业", "demographics": "人口特征",
    },
}


def spoken(text: Column) -> Column:
    """A spoken line without its narrated tail; null for stubs and for lines with nothing left."""
    cut = F.regexp_replace(F.trim(text), rf"(?s)\s+(?:{TAIL_NAMES})\s+(?:{TAIL_VERBS})\s+[^\n]{{10,}}.*$", "")
    cut = F.when(cut != F.trim(text), F.rtrim(cut, F.lit(" ,;"))).otherwise(cut)
    stub = F.lower(F.trim(text, F.lit("\"'"))).isin(STUBS)
    return F.when(~stub & (F.trim(cut) != ""), F.trim(cut))


def before_marker(text: Column, marker: str) -> Column:
    """What stands before the marker; all of the text if it isn't there or comes first."""
    at = F.instr(text, marker)
    return F.trim(F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text))


def plain_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A name without notes in parentheses (full or half width), then by its alias if it has one."""
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, "（[^）]*）", "")), r"\([^)]*\)", ""))
    if not aliases:
        return bare
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), bare), bare)


def is_noise_name(name: Column) -> Column:
    return name.isin(NOISE_NAMES) | (F.length(name) > 15) | name.rlike("^('''|Apologies|对不起|抱歉)")


def is_mostly_ascii(name: Column) -> Column:
    """More than half of the characters are ASCII; false for null and empty names."""
    ascii_ = F.length(F.regexp_replace(name, r"[^\x00-\x7F]", ""))
    return F.coalesce(ascii_ > F.length(name) * 0.5, F.lit(False))


def without_last_signs(text: Column) -> Column:
    """Without punctuation of full or half width and spaces at the end."""
    return F.rtrim(text, F.lit("。，、；.， "))


def prefixed(prefix: str, value: Column, synonyms: list[str]) -> Column:
    """The prefix before a value that doesn't begin with it or with a word that means it."""
    value = without_last_signs(value)
    said = F.lit(False)
    for word in synonyms:
        said = said | value.startswith(word)
    return F.when(said, value).otherwise(F.concat(F.lit(prefix), value))


def score_file_name(model: Column) -> Column:
    """The file of a judge's scores; the default judge keeps the plain name."""
    return F.when(model == "gpt-4.1", "judge_scores.jsonl").otherwise(F.concat(F.lit("judge_scores_"), F.regexp_replace(model, r"[^\w.-]+", "_"), F.lit(".jsonl")))


def persona_summary(fields: dict[str, Column], english: Column) -> Column:
    """A labelled line for each field that isn't empty, in the fixed order."""
    lines = []
    for name in SUMMARY_LABELS["en"]:
        if name in fields:
            label = F.when(english, SUMMARY_LABELS["en"][name]).otherwise(SUMMARY_LABELS["zh"][name])
            lines.append(F.when(F.coalesce(fields[name], F.lit("")) != "", F.concat(label, F.lit(": "), fields[name])))
    return F.concat_ws("\n", *lines)


def retrieval_text(role: Column, context: Column) -> Column:
    return F.concat(F.lit("Character: "), F.coalesce(role, F.lit("")), F.lit("\nContext: "), F.coalesce(context, F.lit("")))


def normal_entries(value: Column) -> Column:
    """The distinct entries of a comma list, in lower case with single spaces; commas in parentheses don't split."""
    parts = F.transform(F.split(value, r",(?![^()]*\))"), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", " "))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != ""))), F.array().cast("array<string>"))


def full_stop(text: Column) -> Column:
    """With a full stop if the last character is a letter."""
    return F.regexp_replace(F.trim(text), r"(\p{L})$", "$1.")


def embedding_prompt(profile: Column, task: str | None = None) -> Column:
    told = PROFILE_INSTRUCTION + (f" Pay special attention to features relevant for the following task: {task}" if task else "")
    return F.concat(F.lit(f"# Instruct:\n{told}\n\n# Character Profile:\n"), F.trim(F.coalesce(profile, F.lit(""))))


def role_prompt(character: Column, context: Column, profile: Column, demos: Column | None = None) -> Column:
    """A prompt of a character, its profile (or a note that there is none), examples and the scene."""
    known = F.coalesce(F.nullif(F.trim(profile), F.lit("")), F.lit("(profile not available)"))
    parts = [F.concat(F.lit("You are "), character, F.lit(".")), F.concat(F.lit("Profile: "), known)]
    if demos is not None:
        parts.append(F.when(F.coalesce(demos, F.lit("")) != "", F.concat(F.lit("Examples:\n"), demos)))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Scene:\n"), context, F.lit("\n"), character, F.lit(":")))


def scene_text(utterances: Column, most: int = 30) -> Column:
    """The first utterances (structs of speaker and text) as lines."""
    return F.array_join(F.transform(F.slice(utterances, 1, most), lambda u: F.concat(u.speaker, F.lit(": "), u.text)), "\n")


def with_interval(mean: Column, low: Column, high: Column, digits: int = 3) -> Column:
    """``mean (low–high)``; a dash where there is no mean."""
    kind = f"%.{digits}f (%.{digits}f–%.{digits}f)"
    return F.when(mean.isNull(), "—").otherwise(F.format_string(kind, mean, low, high))


def descriptors(value: Column) -> Column:
    """The phrases of a comma list, without inner ``and`` and full stops at the end."""
    parts = F.transform(F.split(F.rtrim(F.trim(value), F.lit(".")), ","), lambda p: F.rtrim(F.trim(F.regexp_replace(F.trim(p), r"(?i)\s+and\s+", " ")), F.lit(".")))
    return F.filter(parts, lambda p: p != "")


def joined_descriptors(phrases: Column, original: Column) -> Column:
    """Phrases as a comma list, with a full stop if the original had one."""
    text = F.array_join(F.filter(F.transform(phrases, lambda p: F.rtrim(F.trim(p), F.lit("."))), lambda p: p != ""), ", ")
    return F.when(F.trim(original).endswith("."), F.concat(text, F.lit("."))).otherwise(text)


def coerced_update(update: Column) -> Column:
    """A scene update (JSON text) with defaults for what is missing and the intensity within 1 to 10."""
    got = F.from_json(
        update,
        "session struct<learned_info array<string>, attitude_shifts map<string,string>, commitments array<string>, stance_changes array<string>>, "
        "moment struct<emotion string, emotion_intensity string, scene_context string>",
    )
    words = lambda c: F.coalesce(F.filter(got["session"][c], lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
    strength = F.coalesce(F.nullif(got["moment"]["emotion_intensity"].try_cast("int"), F.lit(0)), F.lit(3))
    return F.struct(
        words("learned_info").alias("learned_info"),
        F.coalesce(got["session"]["attitude_shifts"], F.create_map().cast("map<string,string>")).alias("attitude_shifts"),
        words("commitments").alias("commitments"),
        words("stance_changes").alias("stance_changes"),
        F.coalesce(F.nullif(got["moment"]["emotion"], F.lit("")), F.lit("neutral")).alias("emotion"),
        F.greatest(F.lit(1), F.least(F.lit(10), strength)).alias("emotion_intensity"),
        got["moment"]["scene_context"].alias("scene_context"),
    )


def field_value(tree: Column, field: str) -> Column:
    """A persona field from a JSON tree, whether it is an object with ``value`` or a plain scalar."""
    raw = F.get_json_object(tree, f"$.persona.{field}")
    return F.when(F.ltrim(raw).startswith("{"), F.get_json_object(tree, f"$.persona.{field}.value")).otherwise(raw)


def archive_line(tag: Column, scene: Column, significance: Column, summary: Column) -> Column:
    shown = lambda c: F.coalesce(c, F.lit("?"))
    return F.concat(F.lit("- ["), tag, F.lit(", session_id="), shown(scene), F.lit(", sig="), shown(significance), F.lit("] "), F.coalesce(summary, F.lit("")))


def drifting(surface_count: Column, surface_last: Column, deep_last: Column, least: int = 3) -> Column:
    """A surface field updated often, and since the deep field it belongs to was last."""
    return (F.coalesce(surface_count, F.lit(0)) >= least) & ~F.coalesce(surface_last <= deep_last, F.lit(False))
