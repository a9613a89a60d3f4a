"""Audits of core traits: which descriptors may change, and the change carried on to later snapshots.

An audit is ``dataset, character, field, at`` (the episode), ``descriptors`` (the value's parts),
``response`` (a list of ``descriptor, status, replacement, evidence_ids``), ``protected`` (words that
a character is known by), ``locked`` (descriptors changed by one of the last audits) and ``new_high``,
the high events since the audit before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AUDIT = ["dataset", "character", "field", "at"]
LEAST_HIGH, LEAST_CITED, MOST_LETTERS, MOST_WORDS = 4, 2, 80, 12


def _plain(text: Column) -> Column:
    return F.lower(F.trim(text))


def _holds(text: Column, words: Column) -> Column:
    """A protected word is in the text, in upper or lower case; a leading "and" isn't looked at."""
    told = F.trim(F.regexp_replace(F.lower(text), r"^\s*and\s+", ""))
    return F.exists(F.coalesce(words, F.array().cast("array<string>")), lambda w: told.contains(F.lower(w)))


def judged(audits: DataFrame, archive: DataFrame, changes: int = 1) -> DataFrame:
    """``AUDIT, place, descriptor, decision, replacement, evidence_ids``: a row for each descriptor of each audit.

    ``skipped`` (under four new high events), ``kept`` (no change asked), ``locked``, ``protected``,
    ``too_many`` (an earlier descriptor of the audit changes already), ``ungrounded`` (under two cited
    ids in the character's archive: ``dataset, character, scene_id``), ``empty``, ``collides`` (the
    replacement is a protected word), ``duplicate`` (the value has it already), ``too_long``, else
    ``changed``. Of a descriptor that is named twice the last answer counts.
    """
    rows = audits.select(*AUDIT, "protected", "locked", "new_high", "descriptors", "response", F.posexplode("descriptors").alias("place", "descriptor"))
    asked = F.filter("response", lambda r: F.trim(r["descriptor"]) == F.trim(F.col("descriptor")))
    rows = rows.withColumn("a", F.get(asked, F.size(asked) - 1))
    cited = rows.select(*AUDIT, "place", F.posexplode("a.evidence_ids").alias("_i", "scene_id"))
    known = cited.join(archive.select("dataset", "character", "scene_id").distinct(), ["dataset", "character", "scene_id"])
    known = known.groupBy(*AUDIT, "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "scene_id"))), lambda s: s["scene_id"]).alias("evidence_ids"))
    rows = rows.join(known, [*AUDIT, "place"], "left")
    new = F.regexp_replace(F.trim(F.coalesce("a.replacement", F.lit(""))), r"\.+$", "")
    others = F.exists(F.transform("descriptors", lambda d, i: F.struct(d.alias("d"), i.alias("i"))), lambda x: (x["i"] != F.col("place")) & (_plain(x["d"]) == F.lower(new)))
    first = (
        F.when(F.col("new_high") < LEAST_HIGH, "skipped")
        .when(F.col("a").isNull() | (F.coalesce("a.status", F.lit("still_accurate")) == "still_accurate"), "kept")
        .when(F.exists(F.coalesce("locked", F.array().cast("array<string>")), lambda x: _plain(x) == _plain(F.col("descriptor"))), "locked")
        .when(_holds(F.col("descriptor"), F.col("protected")), "protected")
    )
    rest = (
        F.when(F.coalesce(F.size("evidence_ids"), F.lit(0)) < LEAST_CITED, "ungrounded").when(new == "", "empty").when(_holds(new, F.col("protected")), "collides").when(others, "duplicate")
        .when((F.length(new) > MOST_LETTERS) | (F.size(F.split(new, r"\s+")) > MOST_WORDS), "too_long").otherwise("changed")
    )
    rows = rows.withColumns({"_first": first, "_rest": rest, "_new": new})
    before = Window.partitionBy(*AUDIT).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.count_if(F.col("_first").isNull() & (F.col("_rest") == "changed")).over(before), F.lit(0))
    decision = F.coalesce("_first", F.when(done >= changes, "too_many").otherwise(F.col("_rest")))
    out = rows.withColumn("decision", decision)
    none = F.array().cast(f"array<{cited.schema['scene_id'].dataType.simpleString()}>")
    return out.select(*AUDIT, "place", "descriptor", "decision", F.when(F.col("decision") == "changed", F.col("_new")).alias("replacement"), F.coalesce("evidence_ids", none).alias("evidence_ids"))


def audited_values(judged_: DataFrame, sign: str = ", ") -> DataFrame:
    """``AUDIT, new_value`` of the audits that change something: their descriptors with the replacements."""
    parts = F.sort_array(F.collect_list(F.struct("place", F.coalesce("replacement", "descriptor").alias("d"))))
    made = judged_.groupBy(*AUDIT).agg(F.array_join(F.transform(parts, lambda p: p["d"]), sign).alias("new_value"), F.max(F.col("decision") == "changed").alias("_c"))
    return made.filter("_c").drop("_c")


def carried_on(snapshots: DataFrame, values: DataFrame) -> DataFrame:
    """``snapshots`` (``dataset, character, field, ep, value``) with ``audited``: from an audit's episode on its new
    value, until a snapshot had another value than the one audited. Of several audits the latest up to then holds.

    Runs of equal values are numbered, so every audit of a table is carried on in one pass.
    """
    key = ["dataset", "character", "field"]
    w = Window.partitionBy(*key).orderBy("ep")
    turned = F.coalesce((~F.col("value").eqNullSafe(F.lag("value").over(w))).cast("int"), F.lit(1))
    runs = snapshots.withColumn("_turned", turned).withColumn("_run", F.sum("_turned").over(w)).drop("_turned")
    seen = runs.join(values.select(*key, F.col("at").alias("ep"), "new_value"), [*key, "ep"], "left")
    since = Window.partitionBy(*key, "_run").orderBy("ep").rowsBetween(Window.unboundedPreceding, 0)
    return seen.withColumn("audited", F.coalesce(F.last("new_value", ignorenulls=True).over(since), F.col("value"))).drop("_run", "new_value")
