"""Profiles, relationships and attribute trees as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dramaturg.functions.text import relationship_entries
from dramaturg.operators.relations import is_former, role_priority


def edges(rows: DataFrame, key: str, relationships: str) -> DataFrame:
    """One row for each relationship: ``key, place, role, name, raw``; entries that don't parse go."""
    out = rows.select(key, F.posexplode(relationship_entries(F.col(relationships))).alias("place", "e"))
    return out.select(key, "place", "e.role", "e.name", "e.raw").filter("role <> '' and name <> ''")


def legacy_role(role: Column) -> Column:
    """Plural to singular, ``engaged to`` to fiancé."""
    role = F.when(role.startswith("engaged"), "fiancé").otherwise(role)
    return F.regexp_replace(role, "^(friend|sister|brother|colleague)s$", "$1")


def strongest(edges_: DataFrame, key: str) -> DataFrame:
    """One entry for each name: a former role if there is one, else the role of the highest priority; place breaks ties."""
    order = Window.partitionBy(key, "name").orderBy(is_former(F.col("role")).desc(), role_priority(F.col("role")).desc(), "place")
    return edges_.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def rendered(edges_: DataFrame, key: str) -> DataFrame:
    """Entries back as one text in their order."""
    entry = F.struct("place", F.concat_ws(" is ", "role", "name").alias("t"))
    return edges_.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.t), ", ").alias("relationships"))


def tree(row_id: Column, name: Column, gender: Column, persona: Column, learned: Column, emotion: Column, intensity: Column) -> Column:
    """The attribute tree of four layers, with version ``p00`` and tracking defaults."""
    tracked = F.transform_values(
        persona, lambda k, v: F.struct(v.alias("value"), F.lit("moderate").alias("resistance"), F.lit(None).cast("string").alias("last_updated_at"), F.lit(0).alias("update_count"))
    )
    return F.struct(
        row_id.alias("tree_id"),
        F.struct(name.alias("name"), gender.alias("gender")).alias("identity"),
        F.lit("p00").alias("persona_version"),
        tracked.alias("persona"),
        F.struct(learned.alias("learned_info")).alias("session"),
        F.struct(emotion.alias("emotion"), F.greatest(F.lit(1), F.least(F.lit(10), intensity)).alias("emotion_intensity")).alias("moment"),
    )


def cleared(tree_: Column) -> Column:
    """The static profile: session and moment emptied."""
    empty = F.struct(F.array().cast("array<string>").alias("learned_info"))
    return tree_.withField("session", empty).withField("moment", F.struct(F.lit("neutral").alias("emotion"), F.lit(1).alias("emotion_intensity")))


def tree_text(tree_: Column) -> Column:
    """The tree in words: identity, persona, session, and the emotion if it is one and 3 or stronger."""
    fields = F.transform(F.sort_array(F.map_entries(F.transform_values(tree_["persona"], lambda k, v: v["value"]))), lambda e: F.concat(e.key, F.lit(": "), e.value))
    moment = tree_["moment"]
    feels = F.when((moment["emotion"] != "neutral") & (moment["emotion_intensity"] >= 3), F.concat(F.lit("Feels "), moment["emotion"]))
    session = F.when(F.size(tree_["session"]["learned_info"]) > 0, F.concat(F.lit("Knows "), F.array_join(tree_["session"]["learned_info"], ", ")))
    return F.concat_ws(". ", F.concat(tree_["identity"]["name"], F.lit(" ("), tree_["identity"]["gender"], F.lit(")")), F.array_join(fields, "; "), session, feels)


def updated(persona: Column, field: str, value: Column, episode: Column) -> Column:
    """A persona with one field's value replaced and its tracking moved on."""
    return F.transform_values(
        persona,
        lambda k, v: F.when(k == field, v.withField("value", value).withField("last_updated_at", episode).withField("update_count", v["update_count"] + 1)).otherwise(v),
    )
